"""Business documents written out of the order tables.

The given tables hold orders, not documents, so each order row is rendered as a document: as text,
as a spreadsheet grid, or as decoded tables, with all its lines in `lineitem` and their names in
`part`, so the work grows with the tables. `oracles` states what reading them must
return.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.numbers import round_binary
from ledgerline.operators.lineage import collected, written
from ledgerline.operators.positions import number_copies
from ledgerline.operators.totals import exact_sum
from ledgerline.operators.validation import fill_line_totals
from ledgerline.sources.masters import master_from_table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
GRID_HEADINGS = [
    ["SKU", "Item Description", "Quantity", "Unit Price ($)", "Total ($)"],
    ["Description", "Qty", "Price", "Amount", "Code"],
    ["Part Number", "Product", "Count", "Rate", "Line Total"],
    ["Details", "Pieces", "Rate", "Amount EUR", None],
]
TABLE_HEADINGS = [
    ["SKU", "Description", "Qty", "Unit Price", "Total"],
    ["Item Description", "Product Name", "Count", "Rate", "Amount EUR"],
    ["Description", "Quantity", "Price", "Line Total", ""],
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows on all cores where the input file has too few splits for the work per row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _array(values) -> str:
    """SQL text of an array of strings and nulls."""
    return "array(" + ", ".join("null" if v is None else f"'{v}'" for v in values) + ")"


def _money(cents: str) -> str:
    return f"concat(({cents}) div 100, '.', lpad(({cents}) % 100, 2, '0'))"


# Line k of order o, from its row x of lineitem and part: the name as it stands, with an extra word,
# cut short, or in its place an e-mail or an address. Amounts are in cents.
_CENTS = "greatest(bigint(round(x.l_extendedprice * 100)) div bigint(x.l_quantity), 1L)"
_TURN = "(o + i + 1)"
_LINE = f"""
named_struct(
  'k', i + 1L, 'sku', concat('SK-', y.x.l_partkey), 'valid', {_TURN} % 10 not in (7, 9),
  'quantity', bigint(y.x.l_quantity), 'price', y.cents,
  'total', bigint(y.x.l_quantity) * y.cents + if({_TURN} % 19 = 0, 100, 0),
  'description', case {_TURN} % 10
    when 3 then concat(y.x.p_name, ' kit') when 5 then left(y.x.p_name, length(y.x.p_name) - 1)
    when 7 then 'sales@shop.example' when 9 then 'Main Street 12' else y.x.p_name end)"""


def order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: key o, customer name, its lines, tax, shipping and total in cents; written
    once. A document is a text or a sheet of one order, so the lines of an order meet in its row."""
    orders = table(spark, folder, "orders").selectExpr("o_orderkey as o", "o_custkey")
    customer = table(spark, folder, "customer").selectExpr("c_custkey as o_custkey", "c_name")
    names = table(spark, folder, "part").selectExpr("p_partkey as l_partkey", "p_name")
    named = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o"), *LINE_ORDER)\
        .join(names, "l_partkey")
    raw = collected(named, ["o"], F.sort_array(
        F.collect_list(F.struct(*LINE_ORDER, "p_name"))).alias("raw"))
    priced = f"transform(raw, x -> named_struct('x', x, 'cents', {_CENTS}))"
    lines = f"coalesce(transform({priced}, (y, i) -> {_LINE}), array())"
    docs = orders.join(customer, "o_custkey").join(raw, "o", "left").selectExpr(
        "o", "c_name", f"{lines} as lines", "(o * 3) % 900 as tax", "(o * 11) % 1500 as shipping")
    return spread(written(docs.selectExpr("*", """if(o % 5 != 0, tax + shipping
        + if(o % 7 = 0, 500, 0) + aggregate(filter(lines, x -> x.valid), 0L,
                                            (t, x) -> t + x.total), null) as total""")))


def text_documents(spark: SparkSession, folder: str,
                   orders: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): bar-separated lines for even orders, blank-separated ones for odd orders."""
    cells = f"x.description, x.quantity, {_money('x.price')}, {_money('x.total')}"
    orders = orders or order_documents(spark, folder)
    return orders.selectExpr("concat('T', o) as doc_id", f"""
        concat_ws('\n',
          if(o % 9 = 0, concat(c_name, ' Trading'), null),
          if(o % 11 != 0, concat('INVOICE #: INV-', o), null),
          case when o % 9 = 1 then
              concat('Ship To: Small Book Store, Munich\nCustomer: ', c_name, ', Boston')
            when o % 9 = 2 then concat("Supplier: '", c_name, "'")
            when o % 9 = 3 then concat('Vendor: ', lower(c_name))
            when o % 9 = 4 then 'Supplier: Zzz'
            when o % 9 > 4 then concat('Customer: ', c_name, ', Boston') end,
          '  ', 'Item Description Qty Price Total',
          transform(lines, x -> if(o % 2 = 0, concat('| ', concat_ws(' | ', {cells}), ' |'),
                                   concat_ws(' ', {cells}))),
          concat('Subtotal: ', {_money('100 + tax')}), concat('Tax (8%): ', {_money('tax')}),
          concat('Shipping & Handling: $', {_money('shipping')}),
          concat('Grand Total: ', {_money('total')})) as text""")


def _headings(headings) -> str:
    return f"get(array({', '.join(map(_array, headings))}), cast(o % {len(headings)} as int))"


def grid_documents(spark: SparkSession, folder: str,
                   orders: DataFrame | None = None) -> DataFrame:
    """rows(doc_id, row_idx, cells): header row first (o % 3 = 0) or below a letter head."""
    total = f"if((o + x.k) % 4 != 0, {_money('x.total')}, null)"
    values = f"if((o + x.k) % 23 != 0, x.description, null), string(x.quantity), " \
             f"{_money('x.price')}, {total}"
    numbered = "if(o % 11 != 0, array('INVOICE', concat('INV-', o), null, null, null), " \
               "array('Statement', null, null, null, null))"
    party = """case
        when o % 9 = 0 then array(null, null, 'Ship To:', 'Small Book Store, Munich', null)
        when o % 9 = 1 then array('Ship To:', 'Small Book Store, Munich', 'Customer:',
                                  concat(c_name, ', Boston'), null)
        else array(case o % 9 when 3 then 'Vendor:' when 2 then 'Supplier:' when 4 then 'Supplier:'
                   else 'Customer:' end,
                   case o % 9 when 2 then concat("'", c_name, "'") when 3 then lower(c_name)
                   when 4 then 'Zzz' else concat(c_name, ', Boston') end,
                   'Ship To:', 'Small Book Store, Munich', null) end"""
    sums = ", ".join(f"array(null, null, null, '{label}', {_money(cents)})" for label, cents in
                     [("Subtotal:", "100 + tax"), ("Tax:", "tax"), ("Shipping:", "shipping")])
    none = "cast(array() as array<array<string>>)"
    orders = orders or order_documents(spark, folder)
    return orders.selectExpr("concat('G', o) as doc_id", f"""posexplode(concat(
          case o % 3 when 0 then {none}
            when 1 then array({numbered}, {party}, array(null, null, null, null, null))
            else array(array('PURCHASE ORDER', null, null, null, null), {party},
                       array(null, null, null, null, null)) end,
          array({_headings(GRID_HEADINGS)}),
          transform(lines, x -> case o % 4 when 1 then array({values}, x.sku)
                                when 3 then array({values}, null) else array(x.sku, {values}) end),
          array({sums}),
          if(total is null, {none}, array(array(null, null, null, 'Grand Total:',
                                                {_money('total')}))),
          if(o % 3 = 0, array({numbered}, {party}), {none}))) as (row_idx, cells)""")\
        .selectExpr("doc_id", "bigint(row_idx) as row_idx", "cells")


def table_documents(spark: SparkSession, folder: str,
                    orders: DataFrame | None = None) -> DataFrame:
    """tables(doc_id, page, table_idx, row_idx, cells): line 1 on page 1, above a total row and a
    row that must not be read; the other lines on page 2; a table without rows on page 3."""
    values = f"x.description, string(x.quantity), {_money('x.price')}, {_money('x.total')}"
    heading = f"array({_headings(TABLE_HEADINGS)})"
    items = f"transform(lines, x -> if(o % 3 = 2, array({values}, ''), array(x.sku, {values})))"
    below = """array(array('', '', '', '', ''),
        if(o % 3 = 2, array('Total', '', '', '9.99', ''), array('', 'Total', '', '', '9.99')),
        if(o % 3 = 2, array('hidden', '1', '1.00', '1.00', ''),
                      array('SK-0', 'hidden', '1', '1.00', '1.00')))"""
    orders = orders or order_documents(spark, folder)
    return (orders.selectExpr("concat('P', o) as doc_id", f"""posexplode(array(
                concat({heading}, slice({items}, 1, 1), {below}),
                concat({heading}, slice({items}, 2, greatest(size(lines), 1))), {heading})) as (page, rows)""")
            .selectExpr("doc_id", "bigint(page) as page", "0 as table_idx",
                        "posexplode(rows) as (row_idx, cells)")
            .selectExpr("doc_id", "page", "table_idx", "bigint(row_idx) as row_idx", "cells"))


# --- ledger lines of the order tables ------------------------------------------------

def numbered_lineitems(spark: SparkSession, folder: str) -> DataFrame:
    return number_copies(table(spark, folder, "lineitem").select("l_orderkey", *LINE_ORDER),
                         "l_orderkey", LINE_ORDER, "line_pos")


def ledger_lines(spark: SparkSession, folder: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    label = part.cast("string")
    return numbered_lineitems(spark, folder).select(
        F.col("l_orderkey").cast("string").alias("doc_id"), "line_pos",
        F.when(part % 17 != 0, F.concat(F.lit("Part "), label)).alias("raw_description"),
        F.when(part % 5 == 0, F.concat(F.lit("Title "), label)).alias("title"),
        F.when(supp % 41 == 0, F.lit(0.0)).when(supp % 43 != 0, F.col("l_quantity"))
        .alias("quantity"),
        round_binary(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"),
        F.when(part % 10 != 0, F.col("l_extendedprice")).alias("total_price"),
        ((part * 7 % 51 + 50) / 100.0).alias("match_confidence"))


def ledger_docs(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    o = F.col("o_orderkey")
    sums = exact_sum(fill_line_totals(lines).select("doc_id", "line_pos", "total_price"),
                     "total_price")
    tax = F.when(o % 3 != 0, (o % 500) / 100.0)
    shipping = F.when(o % 4 != 0, (o % 900) / 100.0)
    right = round_binary(F.coalesce("total_price", F.lit(0.0)) + F.coalesce("tax_amount", F.lit(0.0))
                         + F.coalesce("shipping_amount", F.lit(0.0)), 2)
    return (table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
            .withColumn("doc_id", o.cast("string"))
            .join(sums, "doc_id", "left")
            .withColumn("tax_amount", tax).withColumn("shipping_amount", shipping)
            .select("doc_id",
                    F.when(o % 22 == 0, "").when(o % 11 != 0, F.concat(F.lit("PO-"), o))
                    .alias("document_number"),
                    F.when(o % 13 != 0, F.concat(F.lit("CM-"), o)).alias("customer_id"),
                    "tax_amount", "shipping_amount",
                    F.when(o % 5 == 0, F.lit(None)).when(o % 7 == 0, F.col("o_totalprice"))
                    .otherwise(right).alias("total_amount"),
                    ((o % 41 + 60) / 100.0).alias("confidence")))


# --- sheets as files ---------------------------------------------------------------------

ORDERS_PER_SHEET = 4096
SHEET_HEADING = ["Order", "Line", "Description", "Quantity, pieces", "Note"]


def write_csv_sheets(spark: SparkSession, folder: str, out: str) -> None:
    """Every order line as a row of the CSV file of its sheet, below a row of names.

    Descriptions hold separators, doubled quotes and line breaks in quoted cells, and a quote in a
    cell without quotes, by turns.
    """
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"),
        "l_partkey")
    rows = lines.selectExpr(
        f"l_orderkey div {ORDERS_PER_SHEET} as sheet", "l_orderkey as o", "l_linenumber as n",
        "l_partkey as part", "bigint(l_quantity) as quantity", '''concat_ws(',', l_orderkey,
          l_linenumber, case l_partkey % 4
            when 0 then concat('"', p_name, ', size ', l_partkey % 7, '"')
            when 1 then concat('"', p_name, '\\n', l_partkey, ' pieces\\r\\n"')
            when 2 then concat('"5"" ', p_name, ',""', '"')
            else concat(p_name, ' 3" long') end,
          bigint(l_quantity), if(l_partkey % 3 = 0, "", '""')) as value''')
    names = ",".join(f'"{h}"' if "," in h else h for h in SHEET_HEADING)
    heads = rows.select("sheet").distinct().select(
        "sheet", *[F.lit(None).cast("long").alias(c) for c in ("o", "n", "part", "quantity")],
        F.lit(names).alias("value"))
    # A file is written by one task; the number of orders in it is bounded.
    (rows.unionByName(heads).repartition("sheet")
     .sortWithinPartitions("sheet", "o", "n", "part", "quantity")
     .select("sheet", "value").write.partitionBy("sheet").text(out))


# --- masters and probes ----------------------------------------------------------------

def customer_master(spark: SparkSession, folder: str) -> DataFrame:
    return master_from_table(table(spark, folder, "customer"), "c_custkey",
                             {"Customer master ID": "c_custkey", "Legal name": "c_name"})


def supplier_master(spark: SparkSession, folder: str) -> DataFrame:
    return master_from_table(table(spark, folder, "supplier"), "s_suppkey",
                             {"Supplier master ID": "s_suppkey", "Legal name": "s_name"})


def part_master(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn(
        "source_no", F.concat(F.lit("SRC-"), F.col("p_partkey") * 10))
    return master_from_table(parts, "p_partkey", {
        "Item master ID": "p_partkey", "Source item no.": "source_no", "Description": "p_name"})


def noisy(name: Column, kind: Column) -> Column:
    """Six spellings: as is, last letter lost, upper case, extra word, words swapped, unrelated."""
    words = F.split(name, " ")
    return (F.when(kind == 0, name)
            .when(kind == 1, F.substring(name, F.lit(1), F.length(name) - 1))
            .when(kind == 2, F.upper(name))
            .when(kind == 3, F.concat(name, F.lit(" pack")))
            .when(kind == 4, F.array_join(F.reverse(words), " "))
            .otherwise(F.lit("vvvv jjjj")))


def item_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(item_number, raw_description) of every order line: some by number, some by spelling."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    number = (F.when(order % 8 == 0, F.concat(F.lit(" src-"), part * 10, F.lit(" ")))
              .when(order % 8 == 1, part.cast("string"))
              .when(order % 8 == 2, F.lit("NON-EXISTENT")))
    return lines.join(parts, "l_partkey").select(
        order.alias("l_orderkey"), "l_linenumber", part.alias("l_partkey"),
        number.alias("item_number"), noisy(F.col("p_name"), order % 6).alias("raw_description"))


def counterparty_names(spark: SparkSession, folder: str) -> DataFrame:
    """(customer_raw) of every order line: the supplier name in six spellings, some decorated."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                       "s_name")
    order = F.col("l_orderkey")
    name = noisy(F.col("s_name"), order % 6)
    return lines.join(supplier, "l_suppkey").select(
        "l_orderkey", "l_suppkey",
        F.when(order % 7 == 0, F.concat(F.lit("Vendor: '"), name, F.lit("', Ship To: Us")))
        .otherwise(name).alias("customer_raw"))
