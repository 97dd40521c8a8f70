"""Decoded tables of a document: tables(doc_id, page, table_idx, row_idx, cells array<string>).

Row 0 of a table is its header; tables with a header only are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions import text as T
from ledgerline.functions.numbers import lenient_number
from ledgerline.operators.grid import as_lines
from ledgerline.operators.headings import field_value, first_mapped
from ledgerline.operators.lineage import held, written
from ledgerline.operators.positions import number_rows

TABLE = ["doc_id", "page", "table_idx"]


def table_mappings(tables: DataFrame) -> DataFrame:
    """(doc_id, page, table_idx, mapping) of every table, from its header row."""
    folded = F.transform("cells", lambda c: F.coalesce(T.fold(c), F.lit("")))
    headers = tables.filter(F.col("row_idx") == 0).select(*TABLE, folded.alias("folded"))
    return first_mapped(headers, "folded").select(*TABLE, "mapping")


def table_lines(tables: DataFrame) -> DataFrame:
    """tables -> lines, numbered over all tables of a document.

    Headings and rows are both read from the tables, cuts and lines both from the typed rows, so
    each is written once; of the rows only those that can be a line or a cut.
    """
    tables = written(tables.select(*TABLE, "row_idx", "cells"))
    body = tables.filter(F.col("row_idx") > 0).join(table_mappings(tables), TABLE)

    def value(field):
        return T.strip(field_value(F.col("cells"), F.col("mapping"), field))
    # Rows without any mapped cell are skipped before the footer test, which they could not meet.
    fields = held(body.select(*TABLE, "row_idx", F.struct(
        F.coalesce(value("raw_description"), F.lit("")).alias("raw_description"),
        T.blank_to_null(value("item_number")).alias("item_number"),
        lenient_number(value("quantity")).alias("quantity"),
        lenient_number(value("unit_price")).alias("unit_price"),
        lenient_number(value("total_line_amount")).alias("total_price")).alias("x")), "x")\
        .select(*TABLE, "row_idx", "x.*")
    valid = T.is_valid_line(F.col("raw_description"), F.col("quantity"), F.col("unit_price"),
                            F.col("total_price"))
    fields = written(fields.withColumn("footer", T.is_footer(F.col("raw_description")))
                     .withColumn("valid", valid).filter("footer or valid"))
    cuts = fields.filter("footer").groupBy(*TABLE).agg(F.min("row_idx").alias("cut"))
    items = written(fields.filter("valid").join(cuts, TABLE, "left")
                    .filter(F.col("cut").isNull() | (F.col("row_idx") < F.col("cut")))
                    .drop("cut", "footer", "valid"))
    chunk = [F.col("page"), F.col("table_idx"), F.floor(F.col("row_idx") / K.ROWS_PER_CHUNK)]
    return as_lines(number_rows(items, "doc_id", ["page", "table_idx", "row_idx"], chunk,
                                "line_pos"))
