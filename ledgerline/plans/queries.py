"""The registered queries: every operator over whole tables."""

import json
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions import text as T
from ledgerline.functions.numbers import lenient_number
from ledgerline.functions.scoring import partial_ratio, token_set_ratio
from ledgerline.operators import fields, grid, matching, nesting, tables, textdoc, validation
from ledgerline.operators.fallback import fallback_extract
from ledgerline.operators.lineage import new_folder, written
from ledgerline.operators.totals import document_confidence
from ledgerline.plans import corpora as C
from ledgerline.plans import pipeline
from ledgerline.sources import documents as sources
from ledgerline.session import compiled_small
from ledgerline.sources import masters, sinks
from ledgerline.sources.result_files import read_result_files, write_result_files

QUERIES = {}


def query(function):
    @wraps(function)
    def run(spark, folder):
        compiled_small(spark)
        return function(spark, folder)
    QUERIES[function.__name__] = run
    return run


def _field_names(mapping):
    """Mapping as text: field names by column, "-" for unmapped columns."""
    names = F.array(*map(F.lit, K.FIELDS))
    return F.array_join(F.transform(mapping, lambda f: F.when(f < 0, F.lit("-"))
                                    .otherwise(F.get(names, f))), ",")


# --- arithmetic, rules, routing --------------------------------------------------------

@query
def line_positions(spark: SparkSession, folder: str) -> DataFrame:
    return C.numbered_lineitems(spark, folder)


@query
def validate_line_math(spark, folder):
    filled = validation.fill_line_totals(C.ledger_lines(spark, folder))
    return filled.select("doc_id", "line_pos", "total_price",
                         validation.line_arithmetic(filled).alias("message"))


def _ledger(spark, folder):
    lines = written(C.ledger_lines(spark, folder))
    return C.ledger_docs(spark, folder, lines), lines


@query
def validate_grand_total(spark, folder):
    docs, lines = _ledger(spark, folder)
    filled = validation.fill_document_totals(docs, validation.fill_line_totals(lines))
    return filled.select("doc_id", "n_items", "items_total", "expected_total", "total_amount",
                         validation.document_arithmetic().alias("message"))


@query
def business_rules(spark, folder):
    _, _, reasons = validation.checked(*_ledger(spark, folder))
    return sinks.review_queue(reasons)


@query
def route_documents(spark, folder):
    docs, _, _ = validation.validate(*_ledger(spark, folder))
    return validation.approved(docs).unionByName(validation.for_review(docs))\
        .select("doc_id", "needs_review", "n_reasons")


@query
def published_results(spark, folder):
    """Both sides of the routing and the review queue, published as one version and read back."""
    docs, _, reasons = validation.validate(*_ledger(spark, folder))
    out = new_folder(spark)
    sinks.publish_routed(written(docs.select("doc_id", "needs_review", "n_reasons")),
                         reasons, out)
    sides = sinks.published(spark, out)
    none = F.lit(None)
    documents = [sides[name].select(
        F.lit(name).alias("side"), "doc_id", "n_reasons", none.cast("int").alias("rank"),
        none.cast("long").alias("line_pos"), none.cast("string").alias("reason"))
        for name in ("approved", "review")]
    queue = sides["queue"].select(F.lit("queue").alias("side"), "doc_id",
                                  none.cast("long").alias("n_reasons"), "rank", "line_pos",
                                  "reason")
    return documents[0].unionByName(documents[1]).unionByName(queue)


def _result_rows(spark, folder):
    docs, lines, reasons = validation.validate(*_ledger(spark, folder))
    empty = F.lit(None).cast("string")
    for name in ["document_type", "customer_raw", "customer_matched"]:
        docs = docs.withColumn(name, empty)
    for name in ["item_number", "isbn", "author", "matched_description"]:
        lines = lines.withColumn(name, empty)
    return written(docs), lines, reasons


@query
def result_files(spark, folder):
    """A JSON file for each document, written and read back."""
    docs, lines, reasons = _result_rows(spark, folder)
    out = new_folder(spark)
    read = read_result_files(write_result_files(docs, lines, reasons, out), out)
    return read.select(
        "file", "result.document_number", "result.total_amount",
        F.size("result.items").alias("n_items"), F.array_join(F.transform(
            "result.items", lambda x: F.coalesce(x["raw_description"], F.lit("-"))), ";")
        .alias("items"),
        "result.needs_review", F.array_join("result.review_reasons", " | ").alias("reasons"))


@query
def review_reasons(spark, folder):
    docs, lines, reasons = _result_rows(spark, folder)
    return nesting.nest(docs, lines, reasons).select(
        "doc_id", "part", F.size("items").alias("n_items"), "needs_review",
        F.array_join("review_reasons", " | ").alias("reasons"))


@query
def doc_confidence(spark, folder):
    orders = C.table(spark, folder, "orders")
    docs = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"),
                         ((F.col("o_orderkey") % 51 + 50) / 100.0).alias("customer_confidence"))
    return document_confidence(docs, C.ledger_lines(spark, folder))


# --- scalar functions --------------------------------------------------------------------

@query
def parse_numbers(spark, folder):
    lines = C.table(spark, folder, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(20,2)").cast("string")
    kind = F.col("l_orderkey") % 10
    text = (F.when(kind == 0, price).when(kind == 1, F.concat(F.lit("$1,"), price))
            .when(kind == 2, F.replace(price, F.lit("."), F.lit(",")))
            .when(kind == 3, F.concat(F.lit(" ("), price, F.lit(") EUR")))
            .when(kind == 4, F.concat(F.lit("-"), price)).when(kind == 5, F.lit("n/a"))
            .when(kind == 6, F.concat(price, F.lit("-1"))).when(kind == 7, F.lit("1,234,567"))
            .when(kind == 8, F.concat(F.lit("1."), F.replace(price, F.lit("."), F.lit(",")))))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("raw"),
                        lenient_number(text).alias("parsed"))


def _native_texts(spark, folder):
    return C.spread(C.table(spark, folder, "documents").select("doc_id", "text"))


@query
def header_document_number(spark, folder):
    return _native_texts(spark, folder).select(
        "doc_id", T.document_number(F.col("text")).alias("document_number"))


@query
def header_tax(spark, folder):
    return _native_texts(spark, folder).select(
        "doc_id", T.tax_amount(F.col("text")).alias("tax_amount"))


@query
def header_shipping_total(spark, folder):
    text = F.col("text")
    return C.text_documents(spark, folder).select(
        "doc_id", T.shipping_amount(text).alias("shipping_amount"),
        T.total_amount(text).alias("total_amount"))


@query
def counterparty_native(spark, folder):
    return _native_texts(spark, folder).select(
        "doc_id", T.counterparty(F.col("text"), unquote=True).alias("customer_raw"))


@query
def counterparty_text(spark, folder):
    return fields.text_header_fields(C.text_documents(spark, folder))\
        .select("doc_id", "document_number", "document_type", "customer_raw", "tax_amount")


@query
def letterhead_native(spark, folder):
    return _native_texts(spark, folder).select(
        "doc_id", T.letterhead(F.col("text")).alias("letterhead"))


@query
def clean_names(spark, folder):
    names = C.counterparty_names(spark, folder).select("customer_raw").distinct()
    return names.select("customer_raw",
                        T.clean_counterparty(F.col("customer_raw")).alias("cleaned"))


@query
def line_predicates(spark, folder):
    lines = _native_texts(spark, folder).select(
        "doc_id", F.posexplode(T.text_lines(F.col("text"))).alias("pos", "line"))
    line = F.col("line")
    return lines.select("doc_id", "pos", T.is_footer(line).alias("footer"),
                        T.is_email(line).alias("email"), T.is_address(line).alias("address"),
                        T.is_junk(line).alias("junk"), T.is_own_company(line).alias("own"),
                        T.is_valid_line(line, F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("valid"))


# --- text, grids, tables -------------------------------------------------------------------

@query
def text_lines(spark, folder):
    return C.text_documents(spark, folder).select(
        "doc_id", F.posexplode(T.section_lines(F.col("text"))).alias("pos", "line"))


_LINE = ["doc_id", "line_pos", "raw_description", "quantity", "unit_price", "total_price"]


@query
def text_line_items(spark, folder):
    return textdoc.text_items(C.text_documents(spark, folder)).select(_LINE)


def _pages(spark, folder, orders=None):
    """The rendered texts cut into pages of two lines."""
    lines = F.split("text", "\n")
    page = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 2).cast("int")),
                       lambda p: F.array_join(F.slice(lines, p * 2 + 1, 2), "\n"))
    return C.text_documents(spark, folder, orders).select(
        "doc_id", F.posexplode(page).alias("page", "text"))


@query
def page_line_items(spark, folder):
    return textdoc.page_items(_pages(spark, folder)).select(_LINE)


@query
def page_header_fields(spark, folder):
    return fields.header_fields(fields.page_texts(_pages(spark, folder)), unquote=True,
                                use_letterhead=True)


@query
def grid_text_assembly(spark, folder):
    return fields.joined_texts(grid.clean_rows(C.grid_documents(spark, folder)))\
        .select("doc_id", "part", "text")


@query
def counterparty_grid(spark, folder):
    texts = fields.joined_texts(grid.clean_rows(C.grid_documents(spark, folder)))
    return fields.header_fields(texts)


@query
def grid_header_rows(spark, folder):
    return grid.header_rows(grid.clean_rows(C.grid_documents(spark, folder)))\
        .select("doc_id", "header_row", "score", "ambiguous")


@query
def grid_header_mapping(spark, folder):
    return grid.header_rows(grid.clean_rows(C.grid_documents(spark, folder)))\
        .select("doc_id", _field_names(F.col("mapping")).alias("fields"))


@query
def grid_line_items(spark, folder):
    return grid.grid_lines(grid.clean_rows(C.grid_documents(spark, folder)))\
        .select(*_LINE, "item_number")


@query
def grid_cells(spark, folder):
    """Grids given as single cells, put back into rows."""
    cells = C.grid_documents(spark, folder).select(
        "doc_id", "row_idx", F.posexplode("cells").alias("col_idx", "value")).dropna()
    rows = grid.clean_rows(grid.rows_from_cells(cells))
    return rows.select("doc_id", "row_idx", F.array_join("cells", "~", "").alias("line"))


@query
def pdf_header_mapping(spark, folder):
    return tables.table_mappings(C.table_documents(spark, folder)).select(
        "doc_id", "page", _field_names(F.col("mapping")).alias("fields"))


@query
def pdf_table_items(spark, folder):
    return tables.table_lines(C.table_documents(spark, folder)).select(*_LINE, "item_number")


def _half_empty_tables(spark, folder, orders=None):
    """The rendered tables, those of even orders with blank cells below their headings."""
    even = F.regexp_extract("doc_id", r"(\d+)", 1).cast("bigint") % 2 == 0
    blank = F.transform("cells", lambda c: F.lit(""))
    return C.table_documents(spark, folder, orders).withColumn(
        "cells", F.when(even & (F.col("row_idx") > 0), blank).otherwise(F.col("cells")))


@query
def table_or_text_items(spark, folder):
    """Tables and texts of all orders: text lines serve where the tables hold no line."""
    key = F.regexp_extract("doc_id", r"(\d+)", 1)
    orders = C.order_documents(spark, folder)
    rows = _half_empty_tables(spark, folder, orders).withColumn("doc_id", key)
    texts = C.text_documents(spark, folder, orders).withColumn("doc_id", key)
    return textdoc.with_text_fallback(tables.table_lines(rows), texts, textdoc.text_items)\
        .select(_LINE)


# --- similarity and matching -------------------------------------------------------------

@query
def token_set_ratio_pairs(spark, folder):
    queries = C.item_queries(spark, folder)
    parts = C.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    pairs = queries.join(parts, "l_partkey").select(
        F.col("raw_description").alias("a"), F.col("p_name").alias("b")).distinct()
    return pairs.withColumn("score", F.round(token_set_ratio("a", "b"), 9))


@query
def partial_ratio_pairs(spark, folder):
    parts = C.table(spark, folder, "part")
    pairs = parts.select(F.lower("p_type").alias("a"), F.col("p_name").alias("b")).distinct()
    return pairs.withColumn("score", F.round(partial_ratio("a", "b"), 9))


@query
def item_search_text(spark, folder):
    parts = C.table(spark, folder, "part")
    key = F.col("p_partkey")
    master = parts.select(
        key.alias("row_pos"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit(" ")))
        .alias("Title"),
        F.concat("p_type", F.lit(" "), "p_name").alias("Description"),
        F.when(key % 2 == 0, F.concat("p_brand", F.lit(" "))).alias("Author"))
    return master.select("row_pos", matching.item_search_text(master).alias("search_text"))


@query
def customer_id_pick(spark, folder):
    key = F.col("c_custkey")
    master = C.table(spark, folder, "customer").select(
        key.alias("row_pos"), F.col("c_name").alias("Legal name"),
        F.when(key % 2 == 0, F.concat(F.lit(" C"), key, F.lit(" "))).alias("Customer master ID"),
        F.when(key % 3 == 0, F.concat(F.lit("S"), key)).when(key % 3 == 1, F.lit("  "))
        .alias("Supplier ID"),
        F.when(key % 5 != 0, F.concat(F.lit("M"), key)).alias("Master ID"))
    return matching.customer_choices(master)


@query
def match_items_exact(spark, folder):
    """Key columns of the part master in their order of priority."""
    keys = matching.item_keys(C.part_master(spark, folder))
    probes = C.item_queries(spark, folder).select("item_number").dropna().distinct()
    return probes.withColumn("key", T.fold(F.col("item_number"))).join(keys, "key", "left")\
        .select("item_number", "item_id", "description")


@query
def match_items_fuzzy(spark, folder):
    return matching.match_items(C.item_queries(spark, folder), C.part_master(spark, folder))


@query
def match_customers_fuzzy(spark, folder):
    return matching.match_customers(C.counterparty_names(spark, folder),
                                    C.supplier_master(spark, folder))


@query
def resolve_and_write_back(spark, folder):
    """Order lines as documents lines: a match replaces the number, no match keeps it."""
    lines = C.item_queries(spark, folder).select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.col("l_linenumber").cast("long").alias("line_pos"), "item_number", "raw_description",
        "l_partkey")
    found = matching.match_items(lines, C.part_master(spark, folder))
    return matching.write_back(lines, found).select(
        "doc_id", "line_pos", "l_partkey", "item_number", "matched_description",
        "match_confidence")


# --- sources, sinks, fallback ---------------------------------------------------------------

def _supplier_sheet(spark, folder):
    """A sheet with two title rows, padded headings, and some suppliers without key."""
    supplier = C.table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    body = supplier.select(
        F.lit("suppliers").alias("doc_id"), (key + 3).alias("row_idx"),
        F.array(F.lpad(key.cast("string"), 7, "0"),
                F.when(key % 4 != 0, F.concat(F.lit("CM-"), key)), "s_name").alias("cells"))
    titles = [["Supplier list", None, None], ["Generated", "2026", None],
              ["Supplier no. ", " Customer master ID ", "Legal name"]]
    head = spark.createDataFrame([("suppliers", i, row) for i, row in enumerate(titles)],
                                 "doc_id string, row_idx long, cells array<string>")
    return head.unionByName(body)


@query
def master_load(spark, folder):
    master = masters.load_customer_master(_supplier_sheet(spark, folder))
    return master.withColumnsRenamed({"Supplier no.": "supplier_no",
                                      "Customer master ID": "master_id",
                                      "Legal name": "legal_name"})


@query
def item_master_load(spark, folder):
    """A sheet of parts with a title row, a repeated heading, and some parts without key."""
    key = F.col("p_partkey")
    body = C.table(spark, folder, "part").select(
        F.lit("parts").alias("doc_id"), (key + 2).alias("row_idx"),
        F.array(F.concat(F.lit("SRC-"), key), F.when(key % 4 != 0, F.concat(F.lit("IM-"), key)),
                "p_name", "p_type").alias("cells"))
    titles = [["Part list", None, None, None],
              ["Source item no.", " Item master ID", "Description", "Description "]]
    head = spark.createDataFrame([("parts", i, row) for i, row in enumerate(titles)],
                                 "doc_id string, row_idx long, cells array<string>")
    master = masters.load_item_master(head.unionByName(body))
    return master.withColumnsRenamed({"Source item no.": "source_no", "Item master ID": "item_id",
                                      "Description": "name", "Description.1": "kind"})


@query
def header_row_finder(spark, folder):
    return masters.find_header_row(C.grid_documents(spark, folder), "QUANTITY")


@query
def route_files(spark, folder):
    suffixes = F.array(*map(F.lit, [".csv", ".XLSX", ".xls", ".pdf", ".png", ".Jpg", ".jpeg",
                                    ".tiff", ".bmp", ""]))
    o = F.col("o_orderkey")
    files = C.table(spark, folder, "orders").select(F.concat(
        F.lit("in.box/doc "), o, F.get(suffixes, (o % 10).cast("int"))).alias("path"))
    inputs, rejects = sources.route_files(files)
    return inputs.unionByName(rejects, allowMissingColumns=True)


@query
def csv_sheets(spark, folder):
    """Order lines written to CSV files and read back: commas, quotes and line breaks in cells."""
    out = new_folder(spark)
    C.write_csv_sheets(spark, folder, out)
    sheet = F.regexp_extract("doc_id", r"sheet=(\d+)/", 1).cast("long")
    return sources.read_csv_grids(spark, out).select(
        sheet.alias("sheet"), "row_idx", F.size("cells").alias("width"),
        *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(C.SHEET_HEADING))])


def reply_from_text(text: str) -> str:
    """A stand-in for an external extractor: JSON made from the words of the text."""
    words = text.split()
    if len(words) % 7 == 0:
        raise ValueError("no answer")
    return json.dumps({
        "document_number": f"W-{len(words)}",
        "document_type": "memo" if len(words) % 5 == 0 else "invoice",
        "customer_raw": words[0], "total_amount": float(len(words)),
        "items": [{"raw_description": w, "quantity": 1.0} for w in words[:2]]})


@query
def fallback_documents(spark, folder):
    """Every native text as it stands, and some blank documents beside them."""
    native = _native_texts(spark, folder).select(F.col("doc_id").cast("string").alias("doc_id"),
                                                 "text")
    blank = C.table(spark, folder, "documents").filter(F.col("doc_id") % 50 == 0).select(
        F.concat(F.lit("blank-"), "doc_id").alias("doc_id"), F.lit(" \n").alias("text"))
    texts = native.unionByName(blank).withColumn("part", F.lit(0))
    docs, lines, rejects = fallback_extract(texts, reply_from_text)
    counts = lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_pos").alias("last_line"),
        F.max_by("raw_description", "line_pos").alias("last_description"))
    return docs.join(counts, "doc_id", "left").unionByName(rejects, allowMissingColumns=True)\
        .select("doc_id", "document_number", "document_type", "customer_raw", "total_amount",
                "n_lines", "last_line", "last_description", "error")


# --- the whole chain ------------------------------------------------------------------------

def reply_for_open(text: str) -> str:
    """A stand-in for an external extractor: one line for every document it gets."""
    return json.dumps({"document_number": "F-1", "document_type": "invoice",
                       "customer_raw": None, "items": [
                           {"raw_description": "red rod", "quantity": 2.0, "unit_price": 1.5}]})


def _processed(spark, folder, routes):
    docs, lines, _ = pipeline.combine(routes, reply_for_open)
    results, _ = pipeline.process(docs, lines, C.customer_master(spark, folder),
                                  C.part_master(spark, folder))
    return results.select(
        "doc_id", "part", "document_number", "document_type", "customer_raw", "customer_id",
        "customer_matched", "tax_amount", "shipping_amount", "total_amount", "confidence",
        "needs_review", F.size("items").alias("n_items"),
        F.array_join(F.transform("items", lambda x: F.concat_ws(
            "~", F.coalesce(x["item_number"], F.lit("-")), x["raw_description"],
            F.coalesce(x["matched_description"], F.lit("-")),
            (x["quantity"] * 100).cast("bigint").cast("string"),
            F.round(x["total_price"] * 100).cast("bigint").cast("string"),
            F.round(x["match_confidence"] * 10000).cast("bigint").cast("string"))), ";")
        .alias("items"),
        F.array_join("review_reasons", " | ").alias("reasons"))


@query
def process_documents(spark, folder):
    """Texts and grids."""
    orders = C.order_documents(spark, folder)
    return _processed(spark, folder, [
        pipeline.extract_whole_texts(C.text_documents(spark, folder, orders)),
        pipeline.extract_spreadsheets(C.grid_documents(spark, folder, orders))])


@query
def process_scans(spark, folder):
    """Paged documents with tables, and images, of which only a recognised text is known."""
    def renamed(texts, letter):
        return texts.withColumn("doc_id", F.concat(F.lit(letter), F.substring("doc_id", 2, 20)))
    orders = C.order_documents(spark, folder)
    images = renamed(C.text_documents(spark, folder, orders), "I").withColumn(
        "part", F.lit(0).cast("long"))
    return _processed(spark, folder, [
        pipeline.extract_pdfs(renamed(_pages(spark, folder, orders), "P"),
                              _half_empty_tables(spark, folder, orders)),
        pipeline.extract_images(images)])
