"""What the queries must return, as DuckDB SQL over the same tables.

Documents are rendered from known values, so most statements give these values directly instead of
reading the rendered document again.
"""

from ledgerline import constants as K
from ledgerline.functions.text import BLANKS
from ledgerline.plans.corpora import (
    GRID_HEADINGS, ORDERS_PER_SHEET, SHEET_HEADING, TABLE_HEADINGS)

ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else _quoted(v) for v in values) + "]"


def _strip(x: str) -> str:
    return f"trim({x}, {_quoted(BLANKS)})"


def _round(x: str, digits: int) -> str:
    """printf rounds the binary value, half to even, like the reference's language."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _money(cents: str) -> str:
    return f"(({cents}) // 100 || '.' || lpad((({cents}) % 100)::VARCHAR, 2, '0'))"


def _exact(values: str) -> str:
    """Sum of a list of doubles with at most four digits after the point."""
    return f"list_sum(list_transform({values}, lambda x: x::DECIMAL(18,4)))::DOUBLE"


# --- ledger of orders and order lines ----------------------------------------------------

NUMBERED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                          l_quantity, l_extendedprice) - 1 AS line_pos
FROM lineitem"""

ORACLES["line_positions"] = NUMBERED

LEDGER_LINES = f"""
numbered AS ({NUMBERED}),
lines AS (
  SELECT l_orderkey::VARCHAR AS doc_id, line_pos,
         CASE WHEN l_partkey % 17 <> 0 THEN 'Part ' || l_partkey END AS raw_description,
         CASE WHEN l_partkey % 5 = 0 THEN 'Title ' || l_partkey END AS title,
         CASE WHEN l_suppkey % 41 = 0 THEN 0 WHEN l_suppkey % 43 <> 0 THEN l_quantity END
           AS quantity,
         {_round('l_extendedprice / l_quantity', 2)} AS unit_price,
         CASE WHEN l_partkey % 10 <> 0 THEN l_extendedprice END AS stated,
         (l_partkey * 7 % 51 + 50)::DOUBLE / 100 AS match_confidence
  FROM numbered)"""

FILLED = f"""
filled AS (
  SELECT *, coalesce(stated, expected) AS total_price
  FROM (SELECT *, {_round('quantity * unit_price', 2)} AS expected FROM lines)),
summed AS (
  SELECT doc_id, count(*) AS n,
         sum(coalesce(total_price, 0)::DECIMAL(18,2))::DOUBLE AS items_total
  FROM filled GROUP BY doc_id)"""

LEDGER_DOCS = f"""
docs AS (
  SELECT doc_id, document_number, customer_id, tax_amount, shipping_amount, confidence,
         CASE WHEN o % 5 = 0 THEN NULL WHEN o % 7 = 0 THEN o_totalprice
              ELSE {_round('coalesce(items_total, 0) + coalesce(tax_amount, 0) + coalesce(shipping_amount, 0)', 2)}
         END AS stated
  FROM (SELECT o_orderkey AS o, o_orderkey::VARCHAR AS doc_id, o_totalprice,
               CASE WHEN o_orderkey % 22 = 0 THEN ''
                    WHEN o_orderkey % 11 <> 0 THEN 'PO-' || o_orderkey END AS document_number,
               CASE WHEN o_orderkey % 13 <> 0 THEN 'CM-' || o_orderkey END AS customer_id,
               CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 500)::DOUBLE / 100 END
                 AS tax_amount,
               CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 900)::DOUBLE / 100 END
                 AS shipping_amount,
               (o_orderkey % 41 + 60)::DOUBLE / 100 AS confidence
        FROM orders) LEFT JOIN summed USING (doc_id))"""

FILLED_DOCS = f"""
filled_docs AS (
  SELECT *, coalesce(stated, CASE WHEN n_items > 0 THEN expected END) AS total_amount,
         CASE WHEN n_items > 0 AND abs(expected - stated) > {K.ARITHMETIC_TOLERANCE} THEN
           'Grand total mismatch: document header is ' || printf('%.2f', stated)
           || ', sum of line items (' || printf('%.2f', items_total) || ') + tax ('
           || printf('%.2f', coalesce(tax_amount, 0)) || ') + shipping ('
           || printf('%.2f', coalesce(shipping_amount, 0)) || ') is '
           || printf('%.2f', expected) END AS message
  FROM (SELECT *, {_round('items_total + coalesce(tax_amount, 0) + coalesce(shipping_amount, 0)', 2)}
                    AS expected
        FROM (SELECT docs.*, coalesce(n, 0) AS n_items, coalesce(items_total, 0) AS items_total
              FROM docs LEFT JOIN summed USING (doc_id))))"""

LINE_MESSAGE = f"""
CASE WHEN abs(expected - stated) > {K.ARITHMETIC_TOLERANCE} THEN
  'Line item ' || (line_pos + 1) || ' (' || coalesce(nullif(raw_description, ''), 'Unknown')
  || '): total mismatch. Expected ' || printf('%.2f', expected) || ', got '
  || printf('%.2f', stated) END"""

REASONS = f"""
every_reason AS (
  SELECT doc_id, 0 AS rank, -1 AS line_pos, 0 AS step, {LINE_MESSAGE} AS reason FROM filled
  UNION ALL SELECT doc_id, 0, -1, 0, message FROM filled_docs
  UNION ALL SELECT doc_id, 1, -1, 0, 'Missing mandatory document number.'
    FROM filled_docs WHERE coalesce(document_number, '') = ''
  UNION ALL SELECT doc_id, 2, -1, 0, 'Customer/Supplier could not be matched to Master Data.'
    FROM filled_docs WHERE coalesce(customer_id, '') = ''
  UNION ALL SELECT doc_id, 3, -1, 0, 'No line items extracted.' FROM filled_docs WHERE n_items = 0
  UNION ALL SELECT doc_id, 4, line_pos, 0, 'Item ' || line_pos || ': Missing or invalid quantity.'
    FROM filled WHERE quantity IS NULL OR quantity <= 0
  UNION ALL SELECT doc_id, 4, line_pos, 1,
      'Item ' || line_pos || ' (''' || coalesce(nullif(title, ''), raw_description, 'None')
      || '''): Math inconsistency (' || quantity || ' * ' || unit_price || ' = ' || expected
      || ', but document has ' || {_round('total_price', 2)} || ').'
    FROM filled WHERE abs(expected - {_round('total_price', 2)}) > {K.RULE_TOLERANCE}
  UNION ALL SELECT doc_id, 4, line_pos, 2,
      'Item ''' || coalesce(nullif(title, ''), nullif(raw_description, ''), 'Index ' || line_pos)
      || ''': Low match confidence (' || printf('%.2f', match_confidence) || ').'
    FROM filled WHERE match_confidence < {K.CONFIDENCE_FLOOR}
  UNION ALL SELECT doc_id, 5, -1, 0,
      'Low overall document confidence (' || printf('%.2f', confidence) || ').'
    FROM filled_docs WHERE confidence < {K.CONFIDENCE_FLOOR}),
reasons AS (
  SELECT doc_id, reason, min(rank) AS rank, min(line_pos) AS line_pos,
         min(line_pos * 10 + step) AS place
  FROM every_reason WHERE reason IS NOT NULL GROUP BY doc_id, reason)"""

JOINED_REASONS = """
joined AS (
  SELECT doc_id, count(*) AS n_reasons, string_agg(reason, ' | ' ORDER BY rank,
           CASE WHEN rank = 0 THEN reason ELSE '' END, place) AS reasons
  FROM reasons GROUP BY doc_id)"""

LEDGER = f"WITH {LEDGER_LINES}, {FILLED}, {LEDGER_DOCS}, {FILLED_DOCS}, {REASONS}, {JOINED_REASONS}"

ORACLES["validate_line_math"] = f"""
WITH {LEDGER_LINES}, {FILLED}
SELECT doc_id, line_pos, total_price, {LINE_MESSAGE} AS message FROM filled"""

ORACLES["validate_grand_total"] = f"""
WITH {LEDGER_LINES}, {FILLED}, {LEDGER_DOCS}, {FILLED_DOCS}
SELECT doc_id, n_items, items_total, expected AS expected_total, total_amount, message
FROM filled_docs"""

ORACLES["business_rules"] = f"{LEDGER} SELECT doc_id, rank, line_pos, reason FROM reasons"

ORACLES["route_documents"] = f"""{LEDGER}
SELECT doc_id, n_reasons IS NOT NULL AS needs_review, coalesce(n_reasons, 0) AS n_reasons
FROM docs LEFT JOIN joined USING (doc_id)"""

ORACLES["published_results"] = f"""{LEDGER}
SELECT if(n_reasons IS NULL, 'approved', 'review') AS side, doc_id,
       coalesce(n_reasons, 0) AS n_reasons, CAST(NULL AS INTEGER) AS rank,
       CAST(NULL AS BIGINT) AS line_pos, CAST(NULL AS VARCHAR) AS reason
FROM docs LEFT JOIN joined USING (doc_id)
UNION ALL SELECT 'queue', doc_id, NULL, rank, line_pos, reason FROM reasons"""

ORACLES["result_files"] = f"""{LEDGER},
shown AS (SELECT doc_id, string_agg(coalesce(raw_description, '-'), ';' ORDER BY line_pos) AS items
          FROM lines GROUP BY doc_id)
SELECT doc_id || '_result.json' AS file, document_number, total_amount, n_items,
       coalesce(items, '') AS items, n_reasons IS NOT NULL AS needs_review,
       coalesce(reasons, '') AS reasons
FROM filled_docs LEFT JOIN joined USING (doc_id) LEFT JOIN shown USING (doc_id)"""

ORACLES["review_reasons"] = f"""{LEDGER}
SELECT doc_id, 0 AS part, n_items, n_reasons IS NOT NULL AS needs_review,
       coalesce(reasons, '') AS reasons
FROM filled_docs LEFT JOIN joined USING (doc_id)"""

ORACLES["csv_sheets"] = f"""
WITH rows AS (
  SELECT l_orderkey // {ORDERS_PER_SHEET} AS sheet, row_number() OVER (
           PARTITION BY l_orderkey // {ORDERS_PER_SHEET}
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT) AS row_idx,
         l_orderkey::VARCHAR AS c0, l_linenumber::VARCHAR AS c1, CASE l_partkey % 4
           WHEN 0 THEN p_name || ', size ' || l_partkey % 7
           WHEN 1 THEN p_name || chr(10) || l_partkey || ' pieces' || chr(13) || chr(10)
           WHEN 2 THEN '5" ' || p_name || ',"' ELSE p_name || ' 3" long' END AS c2,
         l_quantity::BIGINT::VARCHAR AS c3, CAST(NULL AS VARCHAR) AS c4
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT sheet, row_idx, 5 AS width, c0, c1, c2, c3, c4 FROM rows
UNION ALL SELECT DISTINCT sheet, 0, 5, {', '.join(map(_quoted, SHEET_HEADING))} FROM rows"""

ORACLES["doc_confidence"] = f"""
WITH {LEDGER_LINES}, sums AS (
  SELECT doc_id, list(match_confidence) AS c FROM lines GROUP BY doc_id),
terms AS (
  SELECT o_orderkey::VARCHAR AS doc_id,
         list_prepend((o_orderkey % 51 + 50)::DOUBLE / 100, coalesce(c, [])) AS t
  FROM orders LEFT JOIN sums ON doc_id = o_orderkey::VARCHAR)
SELECT doc_id, {_round(_exact('t') + ' / len(t)', 4)} AS confidence FROM terms"""

# --- scalar functions ------------------------------------------------------------------------

ORACLES["parse_numbers"] = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_orderkey % 10 WHEN 0 THEN p WHEN 1 THEN '$1,' || p WHEN 2 THEN replace(p, '.', ',')
    WHEN 3 THEN ' (' || p || ') EUR' WHEN 4 THEN '-' || p WHEN 5 THEN 'n/a' WHEN 6 THEN p || '-1'
    WHEN 7 THEN '1,234,567' WHEN 8 THEN '1.' || replace(p, '.', ',') END AS raw,
  CASE WHEN l_orderkey % 10 IN (0, 2, 3) THEN p::DOUBLE WHEN l_orderkey % 10 = 1 THEN ('1' || p)::DOUBLE
    WHEN l_orderkey % 10 = 4 THEN -p::DOUBLE
    WHEN l_orderkey % 10 = 8 THEN ('1.' || replace(p, '.', ''))::DOUBLE ELSE 0 END AS parsed
FROM (SELECT *, printf('%.2f', l_extendedprice) AS p FROM lineitem)"""


def _first(pattern: str) -> str:
    return f"nullif(regexp_extract(text, {_quoted(pattern)}, 1, 'i'), '')"


def _number(x: str) -> str:
    """Text of digits, commas and points as a number."""
    return (f"CASE WHEN {x} IS NOT NULL THEN coalesce(TRY_CAST(CASE WHEN contains({x}, '.') "
            f"THEN replace({x}, ',', '') ELSE replace({x}, ',', '.') END AS DOUBLE), 0) END")


OWN = f"'(?i)(?:{'|'.join(K.OWN_COMPANY_PATTERNS)})'"

ORACLES["header_document_number"] = \
    f"SELECT doc_id, {_first(K.DOCUMENT_NUMBER)} AS document_number FROM documents"

ORACLES["header_tax"] = f"""
SELECT doc_id, {_number('m')} AS tax_amount
FROM (SELECT doc_id, {_first(K.TAX)} AS m FROM documents)"""

ORACLES["counterparty_native"] = f"""
SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(text, {_quoted(K.COUNTERPARTY)}, 1, 'i'),
    lambda c: {_strip("regexp_replace(" + _strip('c') + ", '^[''\"]|[''\"]$', '', 'g')")}),
  lambda c: c <> '' AND NOT regexp_matches(c, {OWN}))[1] AS customer_raw
FROM documents"""

LINES_OF_TEXT = f"""list_filter(list_transform(string_split(text, chr(10)),
    lambda x: {_strip('x')}), lambda x: x <> '')"""

ORACLES["letterhead_native"] = f"""
SELECT doc_id, list_filter(({LINES_OF_TEXT})[1:{K.LETTERHEAD_LINES}],
  lambda x: lower(x) NOT IN ({', '.join(map(_quoted, K.LETTERHEAD_TITLES))})
    AND NOT regexp_matches(x, {OWN}) AND length(x) > {K.LETTERHEAD_MIN_CHARS})[1] AS letterhead
FROM documents"""

# RE2 classes are ASCII: spell out letters, digits and their borders.
EMAIL = r"[\pL\pN_.-]+@[\pL\pN_.-]+\.[\pL\pN_]"
ADDRESS = r"(?i)(^|[^\pL\pN_])\d{5}([^\pL\pN_]|$)|avenue|street|broadway|road"

ORACLES["line_predicates"] = f"""
WITH split AS (SELECT doc_id, {LINES_OF_TEXT} AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM split),
flags AS (
  SELECT doc_id, pos, regexp_matches(lower(line), '{'|'.join(K.FOOTER_WORDS)}') AS footer,
         regexp_matches(line, {_quoted(EMAIL)}) AS email,
         regexp_matches(line, {_quoted(ADDRESS)}) AS address,
         lower(line) IN ({', '.join(map(_quoted, K.JUNK_DESCRIPTIONS))}) AS junk,
         regexp_matches(line, {OWN}) AS own FROM lines)
SELECT *, NOT (email OR address OR junk) AS valid FROM flags"""

# --- rendered documents ------------------------------------------------------------------------

BASE = f"""
base AS (
  SELECT o_orderkey AS o, c_name, (o_orderkey * 3) % 900 AS tax, (o_orderkey * 11) % 1500 AS shipping
  FROM orders JOIN customer ON o_custkey = c_custkey),
items AS (
  SELECT *, CASE (o + k) % 10 WHEN 3 THEN name || ' kit' WHEN 5 THEN left(name, length(name) - 1)
              WHEN 7 THEN 'sales@shop.example' WHEN 9 THEN 'Main Street 12' ELSE name END
              AS description
  FROM (SELECT o, c_name, k, 'SK-' || l_partkey AS sku, (o + k) % 10 NOT IN (7, 9) AS valid,
               quantity, price, quantity * price + CASE WHEN (o + k) % 19 = 0 THEN 100 ELSE 0 END
                 AS total, p_name AS name
        FROM base JOIN (
          SELECT *, l_quantity::BIGINT AS quantity,
                 greatest(round(l_extendedprice * 100)::BIGINT // l_quantity::BIGINT, 1) AS price,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                   l_suppkey, l_quantity, l_extendedprice) AS k
          FROM lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o)),
orders_with_total AS (
  SELECT base.*, CASE WHEN o % 5 <> 0 THEN tax + shipping + CASE WHEN o % 7 = 0 THEN 500 ELSE 0 END
                   + coalesce(s, 0) END AS total
  FROM base LEFT JOIN (SELECT o, sum(total) AS s FROM items WHERE valid GROUP BY o) USING (o)),
good AS (
  SELECT *, row_number() OVER (PARTITION BY o ORDER BY k) - 1 AS line_pos FROM items WHERE valid)"""

NUMBER = "CASE WHEN o % 11 <> 0 THEN 'INV-' || o END"
PARTY = """CASE WHEN o % 9 = 3 THEN lower(c_name) WHEN o % 9 = 4 THEN 'Zzz' ELSE c_name END"""
TEXT_PARTY = f"CASE WHEN o % 9 = 0 THEN c_name || ' Trading' ELSE {PARTY} END"
GRID_PARTY = f"""CASE WHEN o % 9 = 0 THEN 'UNKNOWN' WHEN o % 9 = 2 THEN '''' || c_name || ''''
                 ELSE {PARTY} END"""

ORACLES["header_shipping_total"] = f"""WITH {BASE}
SELECT 'T' || o AS doc_id, shipping::DOUBLE / 100 AS shipping_amount,
       total::DOUBLE / 100 AS total_amount FROM orders_with_total"""

ORACLES["counterparty_text"] = f"""WITH {BASE}
SELECT 'T' || o AS doc_id, {NUMBER} AS document_number, 'unknown' AS document_type,
       {TEXT_PARTY} AS customer_raw, tax::DOUBLE / 100 AS tax_amount FROM base"""

ORACLES["page_header_fields"] = f"""WITH {BASE}
SELECT 'T' || o AS doc_id, {NUMBER} AS document_number, 'unknown' AS document_type,
       {TEXT_PARTY} AS customer_raw, tax::DOUBLE / 100 AS tax_amount,
       shipping::DOUBLE / 100 AS shipping_amount, total::DOUBLE / 100 AS total_amount
FROM orders_with_total"""

CELLS = [f"description", "quantity::VARCHAR", _money("price"), _money("total")]
ORACLES["text_lines"] = f"""WITH {BASE}
SELECT 'T' || o AS doc_id, k - 1 AS pos,
       CASE WHEN o % 2 = 0 THEN '| ' || {" || ' | ' || ".join(CELLS)} || ' |'
            ELSE {" || ' ' || ".join(CELLS)} END AS line
FROM items"""


def _items(prefix: str, extra: str = "") -> str:
    return f"""WITH {BASE}
SELECT '{prefix}' || o AS doc_id, line_pos, description AS raw_description,
       quantity::DOUBLE AS quantity, price::DOUBLE / 100 AS unit_price,
       total::DOUBLE / 100 AS total_price{extra} FROM good"""


ORACLES["text_line_items"] = _items("T")
ORACLES["page_line_items"] = _items("T")
ORACLES["table_or_text_items"] = _items("")
ORACLES["pdf_table_items"] = _items(
    "P", ", CASE WHEN o % 3 <> 2 THEN sku END AS item_number")

FULL_MAPPING = "item_number,raw_description,quantity,unit_price,total_line_amount"
ORACLES["pdf_header_mapping"] = f"""
SELECT 'P' || o_orderkey AS doc_id, page, CASE WHEN o_orderkey % {len(TABLE_HEADINGS)} = 2
    THEN 'raw_description,quantity,unit_price,total_line_amount,-' ELSE '{FULL_MAPPING}' END
    AS fields
FROM orders, unnest(range(3)) AS t(page)"""

ORACLES["grid_header_rows"] = f"""
SELECT 'G' || o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 3 END AS header_row,
       CASE WHEN o_orderkey % {len(GRID_HEADINGS)} = 3 THEN 4 ELSE 5 END AS score, false AS ambiguous
FROM orders"""

ORACLES["grid_header_mapping"] = f"""
SELECT 'G' || o_orderkey AS doc_id, CASE o_orderkey % 4
    WHEN 1 THEN 'raw_description,quantity,unit_price,total_line_amount,item_number'
    WHEN 3 THEN 'raw_description,quantity,unit_price,total_line_amount,-'
    ELSE '{FULL_MAPPING}' END AS fields
FROM orders"""

ORACLES["counterparty_grid"] = f"""WITH {BASE}
SELECT 'G' || o AS doc_id, CASE WHEN o % 3 = 2 THEN 'Unnamed' ELSE {NUMBER} END AS document_number,
       'unknown' AS document_type, {GRID_PARTY} AS customer_raw, tax::DOUBLE / 100 AS tax_amount,
       shipping::DOUBLE / 100 AS shipping_amount, total::DOUBLE / 100 AS total_amount
FROM orders_with_total"""

# A grid line without description is kept as ""; one without total gets quantity x price.
GRID_GOOD = f"""
grid_good AS (
  SELECT *, row_number() OVER (PARTITION BY o ORDER BY k) - 1 AS line_pos,
         CASE WHEN (o + k) % 23 = 0 THEN '' ELSE description END AS raw_description,
         price::DOUBLE / 100 AS unit_price,
         CASE WHEN (o + k) % 4 <> 0 THEN total::DOUBLE / 100
              ELSE {_round('quantity * (price::DOUBLE / 100)', 2)} END AS total_price,
         CASE WHEN o % 4 <> 3 THEN sku END AS item_number
  FROM items WHERE valid OR (o + k) % 23 = 0)"""

ORACLES["grid_line_items"] = f"""WITH {BASE}, {GRID_GOOD}
SELECT 'G' || o AS doc_id, line_pos, raw_description, quantity::DOUBLE AS quantity, unit_price,
       total_price, item_number FROM grid_good"""

_NUMBERED = "CASE WHEN o % 11 <> 0 THEN ['INVOICE', 'INV-' || o, NULL, NULL, NULL] " \
            "ELSE ['Statement', NULL, NULL, NULL, NULL] END"
_PARTY_ROW = f"""CASE
  WHEN o % 9 = 0 THEN [NULL, NULL, 'Ship To:', 'Small Book Store, Munich', NULL]
  WHEN o % 9 = 1 THEN ['Ship To:', 'Small Book Store, Munich', 'Customer:', c_name || ', Boston', NULL]
  ELSE [CASE WHEN o % 9 = 3 THEN 'Vendor:' WHEN o % 9 IN (2, 4) THEN 'Supplier:' ELSE 'Customer:' END,
        {GRID_PARTY} || CASE WHEN o % 9 IN (2, 3, 4) THEN '' ELSE ', Boston' END,
        'Ship To:', 'Small Book Store, Munich', NULL] END"""
_HEADING = f"([{', '.join(map(_list, GRID_HEADINGS))}])[o % 4 + 1]"
_VALUES = f"""CASE WHEN (o + k) % 23 <> 0 THEN description END, quantity::VARCHAR, {_money('price')},
  CASE WHEN (o + k) % 4 <> 0 THEN {_money('total')} END"""

GRID_ROWS = f"""
grid_items AS (
  SELECT o, list(CASE o % 4 WHEN 1 THEN [{_VALUES}, sku] WHEN 3 THEN [{_VALUES}, NULL]
                 ELSE [sku, {_VALUES}] END ORDER BY k) AS item_rows FROM items GROUP BY o),
grids AS (
  SELECT o, list_concat(
    CASE o % 3 WHEN 0 THEN [] WHEN 1 THEN [{_NUMBERED}, {_PARTY_ROW}, [NULL, NULL, NULL, NULL, NULL]]
      ELSE [['PURCHASE ORDER', NULL, NULL, NULL, NULL], {_PARTY_ROW}, [NULL, NULL, NULL, NULL, NULL]] END,
    [{_HEADING}], coalesce(item_rows, []),
    [[NULL, NULL, NULL, 'Subtotal:', {_money('100 + tax')}],
     [NULL, NULL, NULL, 'Tax:', {_money('tax')}],
     [NULL, NULL, NULL, 'Shipping:', {_money('shipping')}]],
    CASE WHEN total IS NULL THEN [] ELSE [[NULL, NULL, NULL, 'Grand Total:', {_money('total')}]] END,
    CASE WHEN o % 3 = 0 THEN [{_NUMBERED}, {_PARTY_ROW}] ELSE [] END) AS r
  FROM orders_with_total LEFT JOIN grid_items USING (o)),
grid_rows AS (SELECT o, unnest(range(len(r))) AS row_idx, unnest(r) AS c FROM grids)"""

ORACLES["grid_text_assembly"] = f"""WITH {BASE}, {GRID_ROWS},
named AS (
  SELECT o, row_idx, CASE WHEN row_idx = 0 THEN list_transform(c,
      lambda x, i: coalesce(x, 'Unnamed: ' || (i - 1))) ELSE list_filter(c, lambda x: x IS NOT NULL)
    END AS c FROM grid_rows)
SELECT 'G' || o AS doc_id, 0 AS part,
       string_agg(array_to_string(c, chr(10)), chr(10) ORDER BY row_idx) AS text
FROM named WHERE len(c) > 0 GROUP BY o"""

ORACLES["grid_cells"] = f"""WITH {BASE}, {GRID_ROWS},
cut AS (SELECT o, row_idx, c[1:list_max(list_transform(c, lambda x, i:
          CASE WHEN x IS NULL THEN 0 ELSE i END))] AS c FROM grid_rows)
SELECT 'G' || o AS doc_id, row_idx, array_to_string(list_transform(c, lambda x, i:
         coalesce(x, CASE WHEN row_idx = 0 THEN 'Unnamed: ' || (i - 1) ELSE '' END)), '~') AS line
FROM cut WHERE len(c) > 0"""

ORACLES["header_row_finder"] = f"""
SELECT 'G' || o_orderkey AS doc_id,
       CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN 3 ELSE 0 END AS header_row
FROM orders"""

# --- similarity and matching ---------------------------------------------------------------------


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence of two texts, by rows of the usual table."""
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_reduce(list_prepend(
  list_transform(range(len({b}) + 1), lambda z: 0),
  list_transform(range(1, len({a}) + 1), lambda i: [i])),
  lambda prev, ch: list_reduce(list_prepend([0], list_transform(range(1, len({b}) + 1), lambda j: [j])),
    lambda cur, jj: list_append(cur, CASE WHEN {b}[jj[1]] = {a}[ch[1]] THEN prev[jj[1]] + 1
                                     ELSE greatest(prev[jj[1] + 1], cur[-1]) END)))[-1] END"""


def _scored(pairs: str) -> str:
    """CTEs up to scored(a, b, score) from a relation of distinct pairs (a, b)."""
    return f"""
toks AS (SELECT a, b, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS ta,
                list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS tb
         FROM {pairs}),
rests AS (SELECT *, list_filter(ta, lambda x: list_contains(tb, x)) AS i,
                 array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS ab,
                 array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS ba
          FROM toks),
sizes AS (SELECT *, len(ab) AS la, len(ba) AS lb, length(array_to_string(i, ' ')) AS s FROM rests),
common AS (SELECT *, CASE WHEN s > 0 THEN 1 ELSE 0 END AS g, {_lcs('ab', 'ba')} AS lcs FROM sizes),
scored AS (
  SELECT a, b, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0::DOUBLE
      WHEN s > 0 AND (la = 0 OR lb = 0) THEN 100::DOUBLE
      ELSE greatest(100 - 100 * (la + lb - 2 * lcs)::DOUBLE / (2 * s + 2 * g + la + lb),
        CASE WHEN s > 0 THEN 100 - 100 * (1 + la)::DOUBLE / (2 * s + 1 + la) ELSE 0 END,
        CASE WHEN s > 0 THEN 100 - 100 * (1 + lb)::DOUBLE / (2 * s + 1 + lb) ELSE 0 END) END AS score
  FROM common)"""


def _noisy(name: str, kind: str) -> str:
    return f"""CASE {kind} WHEN 0 THEN {name} WHEN 1 THEN left({name}, length({name}) - 1)
  WHEN 2 THEN upper({name}) WHEN 3 THEN {name} || ' pack'
  WHEN 4 THEN array_to_string(list_reverse(string_split({name}, ' ')), ' ')
  ELSE 'vvvv jjjj' END"""


QUERY_LINES = f"""
query_lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, p_name,
    CASE l_orderkey % 8 WHEN 0 THEN ' src-' || l_partkey * 10 || ' ' WHEN 1 THEN l_partkey::VARCHAR
      WHEN 2 THEN 'NON-EXISTENT' END AS item_number,
    {_noisy('p_name', 'l_orderkey % 6')} AS raw_description
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ORACLES["token_set_ratio_pairs"] = f"""WITH {QUERY_LINES},
pairs AS (SELECT DISTINCT raw_description AS a, p_name AS b FROM query_lines), {_scored('pairs')}
SELECT a, b, round(score, 9) AS score FROM scored"""

ORACLES["partial_ratio_pairs"] = f"""
WITH pairs AS (SELECT DISTINCT lower(p_type) AS a, p_name AS b FROM part),
sides AS (SELECT *, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s,
                 CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM pairs),
both_ways AS (SELECT a, b, s, l FROM sides UNION SELECT a, b, l, s FROM sides WHERE len(s) = len(l)),
windows AS (
  SELECT DISTINCT a, b, s, substr(l, greatest(e - len(s) + 1, 1), least(len(s), e)) AS w
    FROM both_ways, unnest(range(1, len(l) + 1)) AS t(e)
  UNION SELECT DISTINCT a, b, s, substr(l, e, len(s)) FROM both_ways, unnest(range(1, len(l) + 1)) AS t(e)),
cut AS (SELECT DISTINCT s, w FROM windows),
ratios AS (SELECT s, w, 100 - 100 * (len(s) + len(w) - 2 * lcs)::DOUBLE / (len(s) + len(w)) AS r
           FROM (SELECT s, w, {_lcs('s', 'w')} AS lcs FROM cut))
SELECT a, b, round(max(r), 9) AS score FROM windows JOIN ratios USING (s, w) GROUP BY a, b"""

ORACLES["item_search_text"] = """
SELECT p_partkey AS row_pos, CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE p_type || ' ' || p_name END
       || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_brand ELSE '' END AS search_text
FROM part"""

ORACLES["customer_id_pick"] = """
SELECT c_custkey AS row_pos, c_name AS text,
       CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey WHEN c_custkey % 3 = 0 THEN 'S' || c_custkey
            WHEN c_custkey % 5 <> 0 THEN 'M' || c_custkey END AS customer_id
FROM customer"""

ITEM_KEYS = """
item_keys AS (
  SELECT key, arg_min(p_partkey::VARCHAR, (priority, p_partkey)) AS item_id,
         arg_min(p_name, (priority, p_partkey)) AS description
  FROM (SELECT p_partkey::VARCHAR AS key, 0 AS priority, p_partkey, p_name FROM part
        UNION ALL SELECT 'src-' || p_partkey * 10, 1, p_partkey, p_name FROM part) GROUP BY key)"""

ORACLES["match_items_exact"] = f"""WITH {QUERY_LINES}, {ITEM_KEYS}
SELECT DISTINCT item_number, item_id, description
FROM query_lines LEFT JOIN item_keys ON key = lower(trim(item_number))
WHERE item_number IS NOT NULL"""


def _best_parts(probes: str) -> str:
    """CTEs up to best_part(a, score, item_id, name) for a relation of distinct texts (a)."""
    return f"""
names AS (SELECT p_name AS b, min(p_partkey) AS first_key FROM part GROUP BY p_name),
pairs AS (SELECT a, b FROM {probes}, names), {_scored('pairs')},
best_part AS (
  SELECT a, max(score) AS score, arg_max(first_key, (score, -first_key))::VARCHAR AS item_id,
         arg_max(b, (score, -first_key)) AS name
  FROM scored JOIN names USING (b) WHERE score >= {K.ITEM_CUTOFF} GROUP BY a)"""


MATCHED_ITEMS = f"""{QUERY_LINES}, {ITEM_KEYS},
asked AS (SELECT DISTINCT coalesce(item_number, '') AS item_number, raw_description FROM query_lines),
keyed AS (SELECT * FROM asked LEFT JOIN item_keys ON key = lower(trim(item_number))),
probes AS (SELECT DISTINCT raw_description AS a FROM keyed WHERE item_id IS NULL),
{_best_parts('probes')},
matched AS (
  SELECT item_number, raw_description, coalesce(keyed.item_id, best_part.item_id) AS item_id,
         coalesce(description, name) AS matched_description,
         CASE WHEN keyed.item_id IS NOT NULL THEN 1 WHEN score IS NULL THEN 0
              ELSE {_round('score / 100', 4)} END AS match_confidence
  FROM keyed LEFT JOIN best_part ON a = raw_description)"""

ORACLES["match_items_fuzzy"] = f"WITH {MATCHED_ITEMS} SELECT * FROM matched"

ORACLES["resolve_and_write_back"] = f"""WITH {MATCHED_ITEMS}
SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber AS line_pos, l_partkey,
       coalesce(nullif(m.item_id, ''), q.item_number) AS item_number, matched_description,
       match_confidence
FROM query_lines q LEFT JOIN matched m
  ON m.item_number = coalesce(q.item_number, '') AND m.raw_description = q.raw_description"""

NAMES = f"""
raw_names AS (
  SELECT DISTINCT CASE WHEN l_orderkey % 7 = 0 THEN 'Vendor: ''' || name || ''', Ship To: Us'
                       ELSE name END AS customer_raw,
         trim(regexp_replace(name, '(?i)(supplier|vendor):?', '', 'g')) AS cleaned
  FROM (SELECT l_orderkey, {_noisy('s_name', 'l_orderkey % 6')} AS name
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey))"""

ORACLES["clean_names"] = f"WITH {NAMES} SELECT * FROM raw_names"

ORACLES["match_customers_fuzzy"] = f"""WITH {NAMES},
pairs AS (SELECT DISTINCT cleaned AS a, s_name AS b FROM raw_names, supplier), {_scored('pairs')},
best AS (
  SELECT a, max(score) AS score, arg_max(s_suppkey, (score, -s_suppkey))::VARCHAR AS customer_id,
         arg_max(b, (score, -s_suppkey)) AS customer_matched
  FROM scored JOIN supplier ON b = s_name WHERE score >= {K.CUSTOMER_CUTOFF} GROUP BY a)
SELECT customer_raw, customer_id, customer_matched, {_round('score / 100', 4)} AS customer_confidence
FROM raw_names JOIN best ON a = cleaned"""

# --- sources, fallback -----------------------------------------------------------------------------

ORACLES["item_master_load"] = """
SELECT p_partkey + 2 AS row_pos, 'SRC-' || p_partkey AS source_no, 'IM-' || p_partkey AS item_id,
       p_name AS name, p_type AS kind
FROM part WHERE p_partkey % 4 <> 0"""

ORACLES["master_load"] = """
SELECT s_suppkey + 3 AS row_pos, lpad(s_suppkey::VARCHAR, 7, '0') AS supplier_no,
       'CM-' || s_suppkey AS master_id, s_name AS legal_name
FROM supplier WHERE s_suppkey % 4 <> 0"""

ORACLES["route_files"] = """
WITH named AS (
  SELECT 'doc ' || o_orderkey || (['.csv', '.XLSX', '.xls', '.pdf', '.png', '.Jpg', '.jpeg', '.tiff',
                                   '.bmp', ''])[o_orderkey % 10 + 1] AS filename, o_orderkey % 10 AS e,
         (['.csv', '.xlsx', '.xls', '.pdf', '.png', '.jpg', '.jpeg', '.tiff', '.bmp', ''])
           [o_orderkey % 10 + 1] AS ext
  FROM orders)
SELECT 'in.box/' || filename AS path, CASE WHEN e < 8 THEN filename END AS filename,
       CASE WHEN e < 8 THEN ext END AS extension,
       CASE WHEN e < 3 THEN 'spreadsheet' WHEN e = 3 THEN 'pdf' WHEN e < 8 THEN 'image' END AS file_type,
       CASE WHEN e >= 8 THEN 'Unsupported file extension: ' || ext END AS error
FROM named"""

ORACLES["fallback_documents"] = f"""
WITH words AS (
  SELECT doc_id::VARCHAR AS doc_id, list_filter(string_split_regex(text,
           {_quoted('[' + BLANKS + ']+')}), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'blank-' || doc_id, [] FROM documents WHERE doc_id % 50 = 0),
kinds AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 'blank' WHEN len(w) % 7 = 0 THEN 'failed'
            WHEN len(w) % 5 = 0 THEN 'unread' ELSE 'read' END AS kind FROM words)
SELECT doc_id, CASE WHEN kind = 'read' THEN 'W-' || n END AS document_number,
       CASE WHEN kind = 'read' THEN 'invoice' WHEN kind = 'blank' THEN 'unknown' END AS document_type,
       CASE WHEN kind = 'read' THEN w[1] WHEN kind = 'blank' THEN 'UNKNOWN' END AS customer_raw,
       CASE WHEN kind = 'read' THEN n::DOUBLE END AS total_amount,
       CASE WHEN kind = 'read' THEN least(n, 2) END AS n_lines,
       CASE WHEN kind = 'read' THEN least(n, 2) - 1 END AS last_line,
       CASE WHEN kind = 'read' THEN w[least(n, 2)] END AS last_description,
       CASE kind WHEN 'failed' THEN 'ValueError: no answer'
                 WHEN 'unread' THEN 'reply does not fit the result schema' END AS error
FROM kinds"""

# --- the whole chain ----------------------------------------------------------------------------------

def _chain(read_lines: str, every_doc: str) -> str:
    """Results of documents from the lines that the routes read and the header fields of all."""
    return f"""
WITH {BASE}, {GRID_GOOD},
read_lines AS ({read_lines}),
found AS (SELECT DISTINCT doc_id FROM read_lines),
every_doc AS ({every_doc}),
heads AS (
  SELECT doc_id, CASE WHEN f THEN document_number ELSE 'F-1' END AS document_number,
         CASE WHEN f THEN 'unknown' ELSE 'invoice' END AS document_type,
         CASE WHEN f THEN customer_raw END AS customer_raw,
         CASE WHEN f AND known THEN c_name END AS customer_matched,
         CASE WHEN f AND known THEN CASE WHEN o % 9 = 3 THEN 0.9444 ELSE 1 END ELSE 0 END::DOUBLE
           AS customer_confidence,
         CASE WHEN f THEN tax::DOUBLE / 100 END AS tax_amount,
         CASE WHEN f THEN shipping::DOUBLE / 100 END AS shipping_amount,
         CASE WHEN f THEN total::DOUBLE / 100 END AS stated
  FROM (SELECT every_doc.*, found.doc_id IS NOT NULL AS f
        FROM every_doc LEFT JOIN found USING (doc_id))),
all_lines AS (
  SELECT * FROM read_lines
  UNION ALL SELECT doc_id, 0, 'red rod', 2, 1.5, NULL, NULL
  FROM every_doc ANTI JOIN found USING (doc_id)),
probes AS (SELECT DISTINCT raw_description AS a FROM all_lines), {_best_parts('probes')},
lines AS (
  SELECT doc_id, line_pos, raw_description, NULL AS title, quantity, unit_price, stated,
         coalesce(item_id, item_number) AS item_number, name AS matched_description,
         CASE WHEN score IS NULL THEN 0 ELSE {_round('score / 100', 4)} END AS match_confidence
  FROM all_lines LEFT JOIN best_part ON a = raw_description),
{FILLED},
terms AS (SELECT doc_id, list(match_confidence) AS c FROM lines GROUP BY doc_id),
docs AS (
  SELECT heads.* EXCLUDE (customer_confidence), c_custkey::VARCHAR AS customer_id,
         {_round(_exact('list_prepend(customer_confidence, c)') + ' / (len(c) + 1)', 4)} AS confidence
  FROM heads JOIN terms USING (doc_id) LEFT JOIN customer ON c_name = customer_matched),
{FILLED_DOCS}, {REASONS}, {JOINED_REASONS},
shown AS (
  SELECT doc_id, string_agg(coalesce(item_number, '-') || '~' || raw_description || '~'
           || coalesce(matched_description, '-') || '~' || (quantity * 100)::BIGINT || '~'
           || round(total_price * 100)::BIGINT || '~' || round(match_confidence * 10000)::BIGINT,
           ';' ORDER BY line_pos) AS items FROM filled GROUP BY doc_id)
SELECT doc_id, 0 AS part, document_number, document_type, customer_raw, customer_id,
       customer_matched, tax_amount, shipping_amount, total_amount, confidence,
       n_reasons IS NOT NULL AS needs_review, n_items, items, coalesce(reasons, '') AS reasons
FROM filled_docs JOIN shown USING (doc_id) LEFT JOIN joined USING (doc_id)"""


_READ_TEXT = """o, line_pos, description AS raw_description, quantity::DOUBLE AS quantity,
         price::DOUBLE / 100 AS unit_price, total::DOUBLE / 100 AS stated"""
_TEXT_HEAD = f"""o, {NUMBER} AS document_number, {TEXT_PARTY} AS customer_raw,
         o % 9 <> 4 AS known, c_name, tax, shipping, total FROM orders_with_total"""

ORACLES["process_documents"] = _chain(f"""
  SELECT 'T' || o AS doc_id, * EXCLUDE (o), NULL AS item_number FROM (SELECT {_READ_TEXT} FROM good)
  UNION ALL SELECT 'G' || o, line_pos, raw_description, quantity::DOUBLE, unit_price, total_price,
                   item_number FROM grid_good""", f"""
  SELECT 'T' || o AS doc_id, {_TEXT_HEAD}
  UNION ALL
  SELECT 'G' || o, o, CASE WHEN o % 3 = 2 THEN 'Unnamed' ELSE {NUMBER} END, {GRID_PARTY},
         o % 9 NOT IN (0, 4), c_name, tax, shipping, total FROM orders_with_total""")

# Only tables of odd orders hold item numbers; of images nothing is read without the fallback.
ORACLES["process_scans"] = _chain(f"""
  SELECT 'P' || o AS doc_id, * EXCLUDE (o, sku),
         CASE WHEN o % 2 = 1 AND o % 3 <> 2 THEN sku END AS item_number
  FROM (SELECT {_READ_TEXT}, sku FROM good)""", f"""
  SELECT 'P' || o AS doc_id, {_TEXT_HEAD}
  UNION ALL SELECT 'I' || o, {_TEXT_HEAD}""")
