"""Best choice per probe by token_set score, at or above a cutoff, earliest row on ties.

Exact, and without comparing every probe with every choice. With la, lb the lengths of the two
joined token sets, t the score to reach as a fraction, and keep = t / (2 - t):

1. Scores from common tokens (the two closed-form ratios, and every 100) need common tokens of
   weight >= keep x the shorter side. Tokens are taken heaviest first until the rest weighs less
   than that, so such a pair meets on one of these leading tokens of one side and any token of the
   other: an equi-join on tokens.
2. The remaining ratio is at most 2 min(la, lb) / (la + lb), so only choices with a length between
   keep x la and la / keep can reach t: an equi-join on length bands. It runs only for probes
   without a 100 from step 1, and t is then the better of the cutoff and the score found so far.

A master of up to one block of distinct texts needs neither: the block goes to every probe.
Otherwise both joins meet on packed rows, a bounded batch of probes against a bounded block of choices, and a
vectorised kernel returns one best choice per probe and block; pairs are never rows. A pack is large, since
the kernel walks the tree of a block's prefixes and so compares a probe with few of its choices.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scoring import best_of_block, block_matches
from ledgerline.functions.text import tokens
from ledgerline.operators.lineage import written

PROBES_PER_BATCH = 4096
CHOICES_PER_BLOCK = 2048
CHOICES_PER_PACK = 1 << 16
#: Characters that a text takes on average in a full pack; longer texts make smaller packs.
PACKED_CHARS = 64
BAND_GROWTH = 1.25
BROADCAST_CHARS = 32 * 1024 * 1024


def _features(df: DataFrame) -> DataFrame:
    """Adds tokens, heaviest first, and length, of the joined distinct tokens; drops blank texts."""
    heaviest = F.transform(
        F.sort_array(F.transform(tokens(F.col("text")),
                                 lambda t: F.struct((-F.length(t)).alias("w"), t.alias("t")))),
        lambda s: s["t"])
    return (df.withColumn("tokens", heaviest).filter(F.size("tokens") > 0)
            .withColumn("length", F.length(F.array_join("tokens", " "))))


def _leading(keep: float) -> Column:
    """Tokens to take, heaviest first, until the rest weighs less than keep x the whole."""
    state = F.struct(F.lit(0).alias("weight"), F.lit(0).alias("n"))
    total = F.col("length") + 1
    n = F.aggregate(
        F.col("tokens"), state,
        lambda s, t: F.when((total - s["weight"]) >= F.lit(keep) * total,
                            F.struct((s["weight"] + F.length(t) + 1).alias("weight"),
                                     (s["n"] + 1).alias("n"))).otherwise(s))["n"]
    return F.slice(F.col("tokens"), F.lit(1), F.greatest(n, F.lit(1)))


def _band(length: Column) -> Column:
    return F.floor(F.log(length.cast("double")) / F.lit(math.log(BAND_GROWTH))).cast("int")


def _packed(keyed: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Rows of one key as arrays of about `size` texts; texts of a key are distinct, so the hash
    that spreads them over the key's packs spreads evenly."""
    weight = F.greatest(F.lit(1.0), F.length("text") / F.lit(PACKED_CHARS))
    large = (keyed.groupBy("key").agg(F.sum(weight).alias("n")).filter(F.col("n") > size)
             .select("key", F.ceil(F.col("n") / size).alias("packs")))
    pack = F.pmod(F.xxhash64("text"), F.coalesce("packs", F.lit(1)))
    return (keyed.join(large, "key", "left").withColumn("pack", pack)
            .groupBy("key", "pack").agg(F.collect_list(F.struct(*columns)).alias("rows"))
            .select("key", "pack", *[F.col("rows." + c).alias(c + "s") for c in columns]))


def _compare(probes: DataFrame, choices: DataFrame, cutoff: float, small: bool) -> DataFrame:
    """(key, text, floor) against (key, text, row_pos) on key -> best (probe, score, row_pos)."""
    batches = _packed(probes, ["text", "floor"], PROBES_PER_BATCH)
    blocks = _packed(choices, ["text", "row_pos"], CHOICES_PER_PACK)\
        .withColumnsRenamed({"texts": "choices", "pack": "block"})
    if small:
        pairs = batches.join(F.broadcast(blocks), "key")
    else:
        # A block is copied once for each batch of its key: no key's rows meet in one task.
        batches = written(batches)
        copies = batches.groupBy("key").agg(F.max("pack").alias("last"))
        pairs = batches.join(blocks.join(copies, "key").withColumn(
            "pack", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).drop("last"),
            ["key", "pack"])
    # The work is in the comparison, not in the bytes: a fixed number of partitions keeps adaptive
    # execution from merging small but expensive ones.
    context = probes.sparkSession.sparkContext
    partitions = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(max(context.defaultParallelism, partitions))
    match = block_matches(cutoff)("texts", "floors", "choices", "row_poss")
    return pairs.select(F.explode(match).alias("m")).select("m.*")


def _best(matches: DataFrame) -> DataFrame:
    order = F.struct("score", (-F.col("row_pos")).alias("p"))
    return (matches.groupBy("probe").agg(F.max(order).alias("b"))
            .select(F.col("probe").alias("text"), F.col("b.score").alias("score"),
                    (-F.col("b.p")).alias("row_pos")))


def fuzzy_top1(probes: DataFrame, choices: DataFrame, cutoff: float,
               broadcast_chars: int = BROADCAST_CHARS,
               block_size: int = CHOICES_PER_BLOCK) -> DataFrame:
    """probes(text), choices(row_pos, text) -> (text, score, row_pos) for probes that match."""
    # Equal choices: only the earliest row can win.
    distinct = choices.filter(F.length("text") > 0).groupBy("text")\
        .agg(F.min("row_pos").cast("long").alias("row_pos"))
    wanted = probes.select("text").dropna().distinct()
    head = distinct.limit(block_size + 1).collect()
    if len(head) <= block_size:
        return wanted.mapInPandas(
            best_of_block([c["text"] for c in head], [c["row_pos"] for c in head], cutoff),
            "text string, score double, row_pos bigint")

    keep = (cutoff / 100.0) / (2.0 - cutoff / 100.0)
    wanted, offered = written(_features(wanted)), written(_features(distinct))
    # What is sent holds a choice once for each token, each leading token and its band.
    held = F.size("tokens") + F.size(_leading(keep)) + 1
    size = offered.agg(F.sum(F.col("length") * held)).first()[0] or 0
    small = size <= broadcast_chars

    def on_tokens(df, kind, taken, *extra):
        return df.select(F.explode(taken).alias("token"), "text", *extra)\
            .select(F.concat(F.lit(kind), "token").alias("key"), "text", *extra)

    start = wanted.withColumn("floor", F.lit(cutoff))
    by_token = _compare(
        on_tokens(start, "p", _leading(keep), "floor")
        .unionByName(on_tokens(start, "c", F.col("tokens"), "floor")),
        on_tokens(offered, "p", F.col("tokens"), "row_pos")
        .unionByName(on_tokens(offered, "c", _leading(keep), "row_pos")),
        cutoff, small)
    first = written(_best(by_token))

    open_probes = (wanted.join(first, "text", "left")
                   .withColumn("floor", F.coalesce("score", F.lit(cutoff)))
                   .filter(F.col("floor") < 100.0))
    fraction = F.col("floor") / 100.0
    reach = fraction / (F.lit(2.0) - fraction)
    # One character of slack on either side covers the rounding of the band limits.
    low = F.greatest(F.floor(F.col("length") * reach) - 1, F.lit(1))
    high = F.ceil(F.col("length") / reach) + 1
    by_length = _compare(
        open_probes.select(F.explode(F.sequence(_band(low), _band(high))).alias("key"),
                           "text", "floor"),
        offered.select(_band(F.col("length")).alias("key"), "text", "row_pos"),
        cutoff, small)
    return _best(by_length.unionByName(first.withColumnRenamed("text", "probe")))
