"""Mixing sources to target weights by systematic sampling over prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Digits after the point of an expected number of copies.
_SCALE = 12
#: Cells into which documents of one source and size class are dealt.
SALTS = 64
_ADDED = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes(source, source_size, ...) with the target of each source.

    Sources by code point, null last, take the weights in turn and share the total size; a target
    stops at most * source_size and the excess is shared again by weight. That ends at
    min(most * source_size, level * weight), where the sources that stop are those of least
    most * source_size / weight, so the level is found by running sums instead of rounds. All
    windows here run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)),
                        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", turn).withColumn(
        "stop", (F.col("source_size") * most).cast("double")).withColumn(
        "at", F.col("stop") / F.col("weight"))
    rising = Window.orderBy("at", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("__turn", F.row_number().over(rising))
    level = ranked.withColumn("total", F.sum("source_size").over(whole)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward)).withColumn(
        "level", F.min_by("level", F.when(F.col("level") <= F.col("at"), F.col("__turn"))).over(
            whole))
    return level.select(*sizes.columns, F.least(
        F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
        seed: int = 1) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target and taken; taken / size is
    the number of copies. `copies` turns the result into the mixed rows.

    Every document of a source expects target / source_size copies. Running sums of that number
    over the documents of the source, plus one offset for the source that depends on its name and
    the seed only, cross an integer as often as the document is taken. Documents stand in order of
    size class, so each class gives its share and the words taken come near the target.

    The running sum is a rank times a constant. Ranks are counted in cells (source, size class,
    hash of the id) whose counts are combined before their shuffle; a source with a third of all
    rows is spread over hundreds of cells. Sums are decimal, so reruns and other partitionings
    agree and no document exceeds `most` copies.

    Null texts have size 0 and may be taken with no words. A null source is a source of its own.
    Sources without words have target 0. Repeated rows count one each and may differ in their
    copies by one. Columns of docs named like an added one are replaced. An empty table gives no
    rows.
    """
    cols = [c for c in docs.columns if c not in _ADDED]
    rows = docs.select(*cols, n_words(F.col("text")).alias("size"))
    # Size class: the highest bit and the three below it, so sizes in a class differ by an eighth.
    bits = F.length(F.bin("size")) - 4
    rows = rows.withColumn("__class", F.when(F.col("size") < 16, F.col("size")).otherwise(
        bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))"))).withColumn(
        "__hash", F.xxhash64("doc_id", F.lit(seed))).withColumn(
        "__cell", F.pmod("__hash", F.lit(SALTS)))
    # A key that is never null, so that the join and the window below share one exchange.
    rows = rows.withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    cell = ["__source", "__class", "__cell"]
    counts = stored(rows.groupBy("source", *cell).agg(
        F.count("*").alias("n"), F.sum("size").alias("words")))
    goals = targets(counts.groupBy("source", "__source").agg(
        F.sum("words").alias("source_size")), weights, most)
    up_to = Window.partitionBy("__source").orderBy("__class", "__cell").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).select(
        *cell, "__before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cells = stored(starts.join(goals.select("__source", "source_size", "target", rate.cast(
        f"decimal({_SCALE + 2},{_SCALE})").alias("__rate")), "__source"))
    within = Window.partitionBy(*cell).orderBy("size", "__hash", "doc_id", F.xxhash64("text"))
    joined = rows.join(cells, cell)
    rank = (F.col("__before") + F.row_number().over(within)).cast("decimal(20,0)")
    offset = (F.pmod(F.xxhash64("source", F.lit(seed + 1)), F.lit(10**6)) / 10**6).cast(
        f"decimal({_SCALE + 2},{_SCALE})")
    joined = joined.withColumn("__rank", rank).withColumn("__offset", offset)
    crossed = (F.floor(F.col("__rank") * F.col("__rate") + F.col("__offset"))
               - F.floor((F.col("__rank") - 1) * F.col("__rate") + F.col("__offset")))
    return joined.select(*cols, "size", "source_size", "target",
                         crossed.cast("int").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))


def copies(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken."""
    return mixed.filter("copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("__copy")
