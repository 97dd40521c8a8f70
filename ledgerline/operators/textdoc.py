"""Line items of decoded text.

`text_items` takes whole texts(doc_id, text) and works inside the row of a document, without a
shuffle. `page_items` takes pages(doc_id, page, text) and finds the table section over all pages of
a document without bringing them together.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions import text as T
from ledgerline.functions.numbers import lenient_number
from ledgerline.operators.grid import as_lines
from ledgerline.operators.lineage import held, written
from ledgerline.operators.positions import number_in_place, number_rows


def line_parts(line: Column) -> Column:
    """Values of one text line, description first.

    With a bar: the non-blank bar-separated values. Otherwise the text before exactly three
    numbers, and these numbers; the line itself if it is not like that. Lines hold no line break.
    """
    pattern = "(?dU)" + K.SPACE_LAYOUT
    barred = F.filter(F.transform(F.split(line, r"\|"), T.strip), lambda c: c != "")
    # One search for all four values.
    spaced = F.split(F.regexp_replace(line, pattern, "$1\n$2\n$3\n$4"), "\n")
    return F.when(line.contains("|"), barred).otherwise(spaced)


def line_struct(parts: Column) -> Column:
    """Typed values of the first four parts, null with fewer."""
    return F.when(F.size(parts) >= 4, F.struct(
        T.strip(F.get(parts, F.lit(0))).alias("raw_description"),
        lenient_number(F.get(parts, F.lit(1))).alias("quantity"),
        lenient_number(F.get(parts, F.lit(2))).alias("unit_price"),
        lenient_number(F.get(parts, F.lit(3))).alias("total_price")))


def parsed_lines(rows: DataFrame) -> DataFrame:
    """rows(..., lines), an array of text lines -> the valid lines as rows, in their order, with their
    values and `pos` in the array in its place. Lines are rows when they are parsed: Spark compiles
    that, while it interprets what stands inside a function of arrays."""
    keys = [c for c in rows.columns if c != "lines"]
    parts = held(rows.select(*keys, F.posexplode("lines").alias("pos", "line"))
                 .select(*keys, "pos", line_parts(F.col("line")).alias("parts")), "parts")
    values = held(parts.select(*keys, "pos", line_struct(F.col("parts")).alias("x")), "x")
    return (values.select(*keys, "pos", "x.*", F.lit(None).cast("string").alias("item_number"))
            .filter(T.is_valid_line(F.col("raw_description"), F.col("quantity"),
                                    F.col("unit_price"), F.col("total_price"))))


def text_items(texts: DataFrame) -> DataFrame:
    """texts(doc_id, text) -> lines, numbered inside their text. The lines of a text follow each
    other in one part, so they are counted as they come, without a shuffle."""
    sections = texts.select("doc_id", F.monotonically_increasing_id().alias("_text"),
                            T.section_lines(F.col("text")).alias("lines"))
    return as_lines(number_in_place(parsed_lines(sections), "_text", "line_pos"))


def page_marks(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) -> (doc_id, page, lines, heading, footer, closing): the lines of a
    page, and the places of the first heading, the first footer line, and the first footer line
    after the heading."""
    lines = pages.select("doc_id", "page", T.text_lines(F.col("text")).alias("lines"))
    kinds = F.transform("lines", lambda line: F.when(T.is_table_heading(line), "h")
                        .when(T.is_footer(line), "f").otherwise(""))
    return (lines.withColumn("kinds", kinds)
            .withColumn("heading", F.nullif(F.array_position("kinds", "h"), F.lit(0)))
            .withColumn("footer", F.nullif(F.array_position("kinds", "f"), F.lit(0)))
            .withColumn("later", F.nullif(F.array_position(
                F.expr("slice(kinds, int(coalesce(heading, 0)) + 1, size(kinds))"), "f"),
                F.lit(0)))
            .select("doc_id", "page", "lines", "heading", "footer",
                    (F.col("heading") + F.col("later")).alias("closing")))


def section_bounds(marks: DataFrame) -> DataFrame:
    """`page_marks` -> (doc_id, start, end), places (page, pos) of the first heading and of the first
    footer line after it (null without one). Only three positions a page are shuffled."""
    starts = (marks.filter("heading is not null").groupBy("doc_id")
              .agg(F.min(F.struct("page", "heading", "closing")).alias("s"))
              .select("doc_id", F.struct("s.page", F.col("s.heading").alias("pos")).alias("start"),
                      "s.closing"))
    later = (marks.filter("footer is not null").join(starts, "doc_id")
             .filter(F.col("page") > F.col("start.page")).groupBy("doc_id")
             .agg(F.min(F.struct("page", F.col("footer").alias("pos"))).alias("next")))
    closing = F.when(F.col("closing").isNotNull(),
                     F.struct(F.col("start.page"), F.col("closing").alias("pos")))
    return starts.join(later, "doc_id", "left")\
        .select("doc_id", "start", F.coalesce(closing, "next").alias("end"))


def page_items(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) -> lines of the section that starts below the first heading of the
    document and ends at the first footer line after it, on whichever pages these are.

    Headings, footers and lines are all found in the lines of the pages, which are written once.
    """
    pages = written(page_marks(pages))
    inside = (pages.select("doc_id", "page", "lines").join(section_bounds(pages), "doc_id")
              .filter((F.col("page") >= F.col("start.page"))
                      & (F.col("end").isNull() | (F.col("page") <= F.col("end.page")))))
    skip = F.when(F.col("page") == F.col("start.page"), F.col("start.pos")).otherwise(F.lit(0))
    stop = F.when(F.col("page") == F.col("end.page"), F.col("end.pos"))
    lines = F.filter("lines", lambda line, i: (i >= skip)
                     & (stop.isNull() | (i < stop - 1)) & ~T.is_table_heading(line))
    items = written(parsed_lines(inside.select("doc_id", "page", lines.alias("lines"))))
    return as_lines(number_rows(items, "doc_id", ["page", "pos"], [F.col("page")], "line_pos"))


def with_text_fallback(table_lines: DataFrame, texts: DataFrame, read=None) -> DataFrame:
    """Lines from decoded tables, or lines from text for documents whose tables gave none.

    `texts` are text lines, or what `read` makes into lines: then only the texts of documents
    without table lines are read.
    """
    tabled = table_lines.select("doc_id").distinct()
    texts = texts.join(tabled, "doc_id", "left_anti")
    return table_lines.unionByName(read(texts) if read else texts)
