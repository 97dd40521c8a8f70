"""Document text from rows of cells, and the header fields found in it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions import text as T
from ledgerline.operators.lineage import collected, written

#: Fields that the first match of a pattern decides; null only without a match.
_FIRST_MATCH = ["document_number", "tax_amount", "shipping_amount", "total_amount"]


#: First words of all labels: what a match begins with.
_LABEL = ("PURCHASE|PO|INVOICE|ORDER|TAX|VAT|HST|SHIPPING|FREIGHT|HANDLING|ESTIMATED|TOTAL|GRAND|CUSTOMER|"
          "SUPPLIER|VENDOR|CLIENT|BUYER|ISSUED|SOLD|FROM|BILL|SHIP")
#: A line that can lie as a whole between the label and the value of a match.
_BETWEEN = r"^[\s\w()#:|$€£]*(?:\.:?\s*)?$"


def joined_texts(rows: DataFrame, part_rows: int = K.TEXT_ROWS_PER_PART) -> DataFrame:
    """rows(doc_id, row_idx, cells) -> (doc_id, part, text): cells in row order, one per line.

    A document of up to `part_rows` rows is one part; the parts of a larger one follow each other.
    """
    piece = F.array_join("cells", "\n")  # leaves out nulls
    pieces = rows.select("doc_id", F.floor(F.col("row_idx") / part_rows).alias("part"),
                         F.struct("row_idx", piece.alias("text")).alias("r"))
    return _joined(pieces, "doc_id", "part")


def _joined(pieces: DataFrame, *keys: str) -> DataFrame:
    """pieces(keys, r(order, text)) -> (keys, text), one piece per line."""
    return collected(pieces, list(keys), F.sort_array(F.collect_list("r")).alias("all")).select(
        *keys, F.array_join(F.transform("all", lambda r: r["text"]), "\n").alias("text"))


def whole_texts(texts: DataFrame) -> DataFrame:
    """texts(doc_id, part, text) -> the same with all parts of a document in one, part 0."""
    whole = _joined(texts.select("doc_id", F.struct("part", "text").alias("r")), "doc_id")
    return whole.selectExpr("doc_id", "0L as part", "text")


def page_texts(pages: DataFrame, part_rows: int = K.TEXT_ROWS_PER_PART) -> DataFrame:
    """pages(doc_id, page, text) -> as `joined_texts`, page texts in page order."""
    return joined_texts(pages.select("doc_id", F.col("page").alias("row_idx"),
                                     F.array("text").alias("cells")), part_rows)


def _found_in(text: Column, unquote: bool, use_letterhead: bool | Column, own) -> list[Column]:
    letterhead = F.when(use_letterhead if isinstance(use_letterhead, Column)
                        else F.lit(use_letterhead), T.letterhead(text, own))
    return [T.document_number(text).alias("document_number"),
            T.counterparty(text, unquote, own).alias("customer_raw"),
            letterhead.alias("letterhead"), T.tax_amount(text).alias("tax_amount"),
            T.shipping_amount(text).alias("shipping_amount"),
            T.total_amount(text).alias("total_amount")]


def _as_docs(found: DataFrame) -> DataFrame:
    return (found.withColumn("customer_raw",
                             T.or_unknown(F.coalesce("customer_raw", "letterhead")))
            .select("doc_id", "document_number", F.lit("unknown").alias("document_type"),
                    "customer_raw", "tax_amount", "shipping_amount", "total_amount"))


def text_header_fields(texts: DataFrame, own_companies=None) -> DataFrame:
    """texts(doc_id, text), one row per document -> docs. No shuffle."""
    return _as_docs(texts.select("doc_id", *_found_in(F.col("text"), True, True, own_companies)))


def _regrouped(texts: DataFrame) -> DataFrame:
    """texts(doc_id, part, text) with other borders of parts, which no match can cross.

    A match begins in a line with a label; the lines that it covers up to the value's line hold a
    label too, or nothing but what can stand between. So it ends with the first other line at the
    latest, and the lines of a part up to this one go to the part where the match can have begun.
    Only one small row per part is brought into order; texts are joined to it by part.
    """
    lines = F.split("text", "\n", -1)
    kinds = F.transform(lines, lambda x: F.when(x.rlike(K.FLAGS + _LABEL), 1).when(
        x.rlike(K.FLAGS + _BETWEEN), 0).otherwise(-1))
    kinds = texts.select("doc_id", "part", kinds.alias("kinds"))
    own = kinds.select("doc_id", "part", F.array_position("kinds", -1).cast("int").alias("end"),
                       F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.filter(
                           "kinds", lambda k: k != 0)), -1).alias("last"))
    order = Window.partitionBy("doc_id").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("open", F.coalesce(F.last("last", True).over(before) == 1, F.lit(False)))
    begins = ~F.col("open") | (F.col("end") > 0)
    own = own.withColumn("to", F.last(F.when(begins, F.col("part")), True).over(before))
    moved = own.filter("open").select("doc_id", "part", "end", "to")
    texts = texts.join(moved, ["doc_id", "part"], "left")

    def piece(unit, text):
        return F.struct(unit.alias("unit"), text.alias("text"))

    def cut(start, count):
        return F.array_join(F.slice(lines, start, count), "\n")
    size, end = F.size(lines), F.col("end")
    pieces = (F.when(F.col("to").isNull(), F.array(piece(F.col("part"), F.col("text"))))
              .when(end == 0, F.array(piece(F.col("to"), F.col("text"))))
              .otherwise(F.array(piece(F.col("to"), cut(F.lit(1), end)),
                                 piece(F.col("part"), cut(end + 1, size - end)))))
    pieces = texts.select("doc_id", "part", F.explode(pieces).alias("p")).select(
        "doc_id", F.col("p.unit").alias("unit"), F.struct("part", "p.text").alias("r"))
    return _joined(pieces, "doc_id", "unit").withColumnRenamed("unit", "part")


def header_fields(texts: DataFrame, unquote: bool = False, use_letterhead: bool = False,
                  own_companies=None, stored: bool = False) -> DataFrame:
    """texts(doc_id, part, text) -> docs, the same for any division into parts.

    Of a document in several parts, the first part with a match decides; parts are divided anew
    where no match can lie across. The letterhead is looked for in the document's first lines.
    Texts are written once (`stored`: they already are), and only those of documents in several
    parts are divided anew.
    """
    texts = texts if stored else written(texts)
    several = written(texts.filter(F.col("part") != 0).select("doc_id").distinct())
    units = texts.join(several, "doc_id", "left_anti").unionByName(
        _regrouped(texts.join(several, "doc_id", "left_semi")))
    first = F.slice(T.text_lines(F.col("text")), 1, K.LETTERHEAD_LINES)
    found = units.select("doc_id", "part", first.alias("first"),
                         *_found_in(F.col("text"), unquote, False, own_companies))
    top = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "first"))),
                                lambda r: r["first"]))
    docs = found.groupBy("doc_id").agg(
        *[F.min_by(name, F.when(F.col(name).isNotNull(), F.col("part"))).alias(name)
          for name in [*_FIRST_MATCH, "customer_raw"]],
        (F.array_join(top, "\n") if use_letterhead else F.lit(None).cast("string")).alias("top"))
    return _as_docs(docs.withColumn("letterhead", T.letterhead(F.col("top"), own_companies)))
