"""Master tables: every column a string, rows in load order."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions.text import constant_array


def find_header_row(rows: DataFrame, keyword: str, depth: int = K.HEADER_SEARCH_ROWS) -> DataFrame:
    """rows(doc_id, row_idx, cells) -> (doc_id, header_row): first of the leading rows whose joined
    cells contain the keyword, 0 without one."""
    text = F.lower(F.array_join("cells", " ", "nan"))
    hit = F.when(text.contains(keyword.lower()), F.col("row_idx"))
    return (rows.filter(F.col("row_idx") < depth).groupBy("doc_id")
            .agg(F.coalesce(F.min(hit), F.lit(0)).alias("header_row")))


def _unique(names: list[str | None], form: Callable[[str], str]) -> list[str]:
    """Names in a form, repeated ones numbered; blank names stay blank."""
    out: list[str] = []
    for name in names:
        name = numbered = form(name or "")
        k = 0
        while name.strip() and numbered in out:
            k += 1
            numbered = f"{name}.{k}"
        out.append(numbered)
    return out


def load_master(rows: DataFrame, key: str) -> DataFrame:
    """rows of one master sheet -> string columns named by its header row, plus row_pos.

    Column names are stripped; a repeated name gets ".1", ".2", ... Rows without a key are dropped
    where the key column exists.
    """
    header_row = find_header_row(rows, key).first()["header_row"]
    header = rows.filter(F.col("row_idx") == header_row).first()["cells"]
    names = list(enumerate(_unique(_unique(header, str), str.strip)))
    names = [(i, n) for i, n in names if n]
    missing = F.transform(F.col("cells"), lambda c: F.when(~F.array_contains(constant_array(K.MISSING_CELL_TEXTS), c), c))
    body = (rows.filter(F.col("row_idx") > header_row).withColumn("cells", missing)
            .filter(F.exists("cells", lambda c: c.isNotNull())))
    master = body.select(F.col("row_idx").cast("long").alias("row_pos"),
                         *[F.get("cells", F.lit(i)).alias(n) for i, n in names])
    return master.na.drop(subset=[f"`{key}`"]) if key in master.columns else master


def load_customer_master(rows: DataFrame) -> DataFrame:
    return load_master(rows, K.CUSTOMER_KEY)


def load_item_master(rows: DataFrame) -> DataFrame:
    return load_master(rows, K.ITEM_KEY)


def master_from_table(table: DataFrame, order_by: str, columns: dict[str, str]) -> DataFrame:
    """A table as master: {master column: table column}, all strings, ordered by a unique integer
    column."""
    return table.select(F.col(order_by).cast("long").alias("row_pos"),
                        *[F.col(c).cast("string").alias(n) for n, c in columns.items()])
