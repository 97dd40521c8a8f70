"""Entity resolution of counterparties and line items against the master tables.

Masters are string tables with a `row_pos` column (load order) and the column names of
`constants`; columns that a master lacks are simply not used.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions.numbers import round_binary
from ledgerline.functions.text import blank_to_null, clean_counterparty, fold, strip
from ledgerline.operators.fuzzy import fuzzy_top1
from ledgerline.operators.lineage import written
from ledgerline.operators.totals import document_confidence


def _column(master: DataFrame, name: str) -> Column:
    """A master column with missing values as "", or "" where the master lacks it."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in master.columns else F.lit("")


def _first_filled(values: list[Column]) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(None).cast("string"))


def customer_choices(master: DataFrame) -> DataFrame:
    """(row_pos, text, customer_id): legal name and first non-blank id column."""
    ids = [strip(_column(master, c)) for c in K.CUSTOMER_ID_COLUMNS]
    return master.select("row_pos", _column(master, K.CUSTOMER_NAME).alias("text"),
                         _first_filled(ids).alias("customer_id"))


def item_search_text(master: DataFrame) -> Column:
    """Title, or else description, followed by the author."""
    title = strip(_first_filled([_column(master, "Title"), _column(master, "Description")]))
    author = strip(_column(master, "Author"))
    return strip(F.concat_ws(" ", title, blank_to_null(author)))


def item_choices(master: DataFrame) -> DataFrame:
    """(row_pos, text, item_id, title)."""
    item_id = F.coalesce(_first_filled([_column(master, c) for c in K.ITEM_ID_COLUMNS]), F.lit(""))
    return master.select("row_pos", item_search_text(master).alias("text"),
                         item_id.alias("item_id"), _column(master, "Title").alias("title"))


def item_keys(master: DataFrame) -> DataFrame:
    """(key, item_id, description): every usable key once, by column order, then row order."""
    present = [c for c in K.ITEM_KEY_COLUMNS if c in master.columns]
    if not present:
        return item_choices(master).filter("false").select(
            F.lit("").alias("key"), "item_id", F.col("text").alias("description"))
    keys = F.array(*[F.struct(fold(_column(master, c)).alias("key"), F.lit(i).alias("priority"))
                     for i, c in enumerate(present)])
    item_id = F.coalesce(_first_filled([_column(master, c) for c in K.ITEM_ID_COLUMNS]), F.lit(""))
    description = F.coalesce(blank_to_null(item_search_text(master)), _column(master, "Title"))
    rows = master.select("row_pos", item_id.alias("item_id"), description.alias("description"),
                         F.explode(keys).alias("k")).filter(F.col("k.key") != "")
    first = F.min_by(F.struct("item_id", "description"), F.struct("k.priority", "row_pos"))
    return rows.groupBy(F.col("k.key").alias("key")).agg(first.alias("m"))\
        .select("key", "m.item_id", "m.description")


def _confidence(score: Column) -> Column:
    return round_binary(score / 100.0, 4)


def match_customers(names: DataFrame, master: DataFrame,
                    cutoff: float = K.CUSTOMER_CUTOFF) -> DataFrame:
    """names(customer_raw) -> one row per distinct name with a match:
    (customer_raw, customer_id, customer_matched, customer_confidence)."""
    if K.CUSTOMER_NAME not in master.columns:
        master = master.filter("false")
    choices = customer_choices(master)
    # Written, since a distinct of the cleaned texts would clean every row, and two steps read it.
    cleaned = written(names.select("customer_raw").dropna().distinct()
                      .withColumn("text", clean_counterparty(F.col("customer_raw"))))
    best = fuzzy_top1(cleaned, choices, cutoff)
    return (cleaned.join(best, "text")
            .join(choices.withColumnRenamed("text", "customer_matched"), "row_pos")
            .select("customer_raw", "customer_id", "customer_matched",
                    _confidence(F.col("score")).alias("customer_confidence")))


def match_items(queries: DataFrame, master: DataFrame, cutoff: float = K.ITEM_CUTOFF) -> DataFrame:
    """queries(item_number, raw_description) -> one row per distinct query (nulls as ""):
    (item_number, raw_description, item_id, matched_description, match_confidence).

    Exact keys first; only what they miss goes to the fuzzy join.
    """
    distinct = queries.select(F.coalesce("item_number", F.lit("")).alias("item_number"),
                              F.coalesce("raw_description", F.lit("")).alias("raw_description"))\
        .distinct().withColumn("key", fold(F.col("item_number")))
    keyed = distinct.join(item_keys(master).withColumn("exact", F.lit(True)), "key", "left")
    exact = keyed.filter("exact").select(
        "item_number", "raw_description", "item_id",
        F.col("description").alias("matched_description"),
        F.lit(1.0).alias("match_confidence"))
    rest = keyed.filter("exact is null").select("item_number", "raw_description")
    choices = item_choices(master)
    best = fuzzy_top1(rest.select(F.col("raw_description").alias("text")), choices, cutoff)
    described = best.withColumnRenamed("text", "raw_description").join(
        choices.select("row_pos", "item_id", F.col("text").alias("matched_description")), "row_pos")
    fuzzy = (rest.join(described, "raw_description", "left")
             .select("item_number", "raw_description", "item_id", "matched_description",
                     F.coalesce(_confidence(F.col("score")), F.lit(0.0))
                     .alias("match_confidence")))
    return exact.unionByName(fuzzy)


def write_back(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with their match: the number is replaced by a non-empty id, the matched description
    and the confidence are always set. Adaptive execution splits the lines of a frequent value."""
    matches = found.withColumnsRenamed({"item_number": "_number", "raw_description": "_description"})
    same = ((F.coalesce(lines["item_number"], F.lit("")) == matches["_number"])
            & (F.coalesce(lines["raw_description"], F.lit("")) == matches["_description"]))
    return (lines.join(matches, same, "left")
            .withColumn("item_number", F.coalesce(blank_to_null(F.col("item_id")), "item_number"))
            .drop("_number", "_description", "item_id"))


def resolve(docs: DataFrame, lines: DataFrame, customers: DataFrame, items: DataFrame,
            customer_cutoff: float = K.CUSTOMER_CUTOFF, item_cutoff: float = K.ITEM_CUTOFF):
    """-> (docs with customer_id, customer_matched, confidence; lines as from `write_back`).

    Distinct names and distinct (number, description) pairs are matched, so a frequent value is
    matched once. The matched lines are written once: the confidence and all later steps read them.
    """
    names = match_customers(docs, customers, customer_cutoff)
    docs = (docs.join(names, "customer_raw", "left")
            .withColumn("customer_confidence", F.coalesce("customer_confidence", F.lit(0.0))))
    lines = written(write_back(lines, match_items(lines, items, item_cutoff)))
    docs = docs.join(document_confidence(docs, lines), "doc_id").drop("customer_confidence")
    return docs, lines
