"""The whole chain: extract by route, fall back, resolve, validate, route, nest."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.fallback import fallback_extract
from ledgerline.operators.fields import (
    header_fields, joined_texts, page_texts, text_header_fields, whole_texts)
from ledgerline.operators.grid import clean_rows, grid_lines
from ledgerline.operators.lineage import written
from ledgerline.operators.matching import resolve
from ledgerline.operators.nesting import nest
from ledgerline.operators.tables import table_lines
from ledgerline.operators.textdoc import page_items, text_items, with_text_fallback
from ledgerline.operators.validation import validate
from ledgerline.schemas import DOC, LINE


@dataclass
class Extracted:
    """What one route reads: header fields of all its documents, lines, and texts(doc_id, part,
    text) for the documents that turn out to have no line; `in_parts`: these are put together first.
    """

    docs: DataFrame
    lines: DataFrame
    texts: DataFrame
    in_parts: bool = False


def extract_spreadsheets(rows: DataFrame, own_companies=None) -> Extracted:
    """rows(doc_id, row_idx, cells). Header fields, headers, footers and lines all read the cleaned
    rows, so these are written once."""
    rows = written(clean_rows(rows))
    texts = written(joined_texts(rows))
    return Extracted(header_fields(texts, own_companies=own_companies, stored=True),
                     grid_lines(rows, stored=True), texts, in_parts=True)


def extract_pdfs(pages: DataFrame, tables: DataFrame | None = None,
                 own_companies=None) -> Extracted:
    """pages(doc_id, page, text), tables(doc_id, page, table_idx, row_idx, cells). Lines and texts
    both read the pages, so these are written once."""
    pages = written(pages)
    lines = page_items(pages) if tables is None else \
        with_text_fallback(table_lines(tables), pages, page_items)
    texts = written(page_texts(pages))
    docs = header_fields(texts, unquote=True, use_letterhead=True, own_companies=own_companies,
                         stored=True)
    return Extracted(docs, lines, texts, in_parts=True)


def extract_whole_texts(texts: DataFrame, own_companies=None) -> Extracted:
    """texts(doc_id, text), one row per document: as `extract_pdfs` without tables. Header fields,
    lines and the fallback all read the texts, so these are written once."""
    texts = written(texts)
    return Extracted(text_header_fields(texts, own_companies), text_items(texts),
                     texts.selectExpr("doc_id", "0L as part", "text"))


def extract_images(texts: DataFrame) -> Extracted:
    """Recognised texts(doc_id, part, text) keep no layout: all of them need the fallback."""
    spark = texts.sparkSession
    return Extracted(spark.createDataFrame([], DOC), spark.createDataFrame([], LINE), texts)


def combine(routes: list[Extracted], fallback=None, ledger: str | None = None):
    """Union of the routes; documents without a line go through the fallback -> (docs, lines,
    rejects).

    The lines decide which documents are open, so they are computed once and written. Texts are
    only gathered, put together and written for these documents; which ones they are takes no text.
    """
    def union(name, columns):
        frames = [getattr(route, name).select(columns) for route in routes]
        return reduce(DataFrame.unionByName, frames)
    lines = written(union("lines", LINE.names))
    found = lines.select("doc_id").distinct()
    docs = union("docs", DOC.names).join(found, "doc_id", "left_semi")
    still = written(union("texts", ["doc_id"]).distinct().join(found, "doc_id", "left_anti")
                    .withColumnRenamed("doc_id", "_open"))

    def open_texts(route):
        texts = route.texts.select("doc_id", "part", "text").join(
            still, F.col("doc_id").eqNullSafe(F.col("_open")), "left_semi")
        return whole_texts(texts) if route.in_parts else texts
    texts = written(reduce(DataFrame.unionByName, map(open_texts, routes)))
    if fallback is None:
        rejects = texts.selectExpr("doc_id", "'no line items and no fallback' as error").distinct()
        return docs, lines, rejects
    more_docs, more_lines, rejects = fallback_extract(texts, fallback, ledger)
    return (docs.unionByName(more_docs.select(DOC.names)),
            lines.unionByName(more_lines.select(LINE.names)), rejects)


def process_rows(docs: DataFrame, lines: DataFrame, customers: DataFrame, items: DataFrame):
    """Extracted docs and lines -> (docs, lines, reasons), results as rows.

    Matching and validation read the documents several times, so these are written to the shared
    checkpoint folder before and after; `validate` writes the reasons. Lines are read twice until `resolve` writes them with their
    match; those of `combine` come from written tables, so they are not written again before.
    """
    docs, lines = resolve(written(docs), lines, customers, items)
    docs, lines, reasons = validate(written(docs), lines)
    return written(docs), lines, reasons


def process(docs: DataFrame, lines: DataFrame, customers: DataFrame, items: DataFrame):
    """Extracted docs and lines -> (nested results, reasons); see `process_rows`."""
    docs, lines, reasons = process_rows(docs, lines, customers, items)
    return nest(docs, lines, reasons), reasons
