"""Sharding by histogram sort: probe boundaries, count bytes below them, refine, exchange once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literals, stored

#: First probes over the whole key range, and probes inside an interval that stays open.
FIRST_PROBES, PROBES = 1 << 14, 256
_ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _keys(docs: DataFrame) -> DataFrame:
    """Sort key (hash of the text, doc_id): equal texts stand together, a large group of them can
    still be divided."""
    return docs.withColumn("__h", F.shiftrightunsigned(F.xxhash64("text"), 1)).withColumn(
        "__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63))).withColumn(
        "size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)


class _Interval:
    """An open stretch of the key range: hashes lo..hi, or ids lo..hi of the one hash `fixed`."""

    def __init__(self, below: int, lo: int, hi: int, fixed: int | None, probes: int):
        self.below, self.lo, self.fixed = below, lo, fixed
        self.step = (hi - lo) // probes + 1
        self.hi = hi

    def begin(self) -> tuple[int, int]:
        return (self.lo, -2**63) if self.fixed is None else (self.fixed, self.lo)


def _probed(keys: DataFrame, intervals: list[_Interval]) -> DataFrame:
    """keys with the interval's number i and the stretch p within it; both null outside."""
    fields = {"i": (range(len(intervals)), "int"),
              "by_hash": ([x.fixed is None for x in intervals], "boolean"),
              "fixed": ([x.fixed or 0 for x in intervals], "bigint"),
              "lo": ([x.lo for x in intervals], "bigint"), "hi": ([x.hi for x in intervals], "bigint"),
              "step": ([min(x.step, 2**55) for x in intervals], "bigint")}
    known = F.arrays_zip(*[literals(v, kind).alias(name) for name, (v, kind) in fields.items()])
    at = F.greatest(_part([x.begin() for x in intervals]), F.lit(1))
    rows = keys.withColumn("at", F.element_at(known, at))
    rows = rows.withColumn("key", F.when(F.col("at.by_hash"), F.col("__h")).otherwise(F.col("__d")))
    inside = F.col("key").between(F.col("at.lo"), F.col("at.hi")) & (
        F.col("at.by_hash") | (F.col("__h") == F.col("at.fixed")))
    # Ids of both signs, too far apart for a difference, are parted at 0 first.
    wide = F.when(F.col("key") < 0, 0).otherwise(1).cast("long")
    near = F.expr("(key - at.lo) div at.step")
    return rows.withColumn("i", F.when(inside, F.col("at.i"))).withColumn(
        "p", F.when(~inside, F.lit(None)).when(F.col("at.step") >= 2**55, wide).otherwise(near))


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (hash, id) at which parts begin, parts - 1 at most.

    Each round counts the bytes and rows between the probes of all open intervals in one
    aggregation, so at most FIRST_PROBES, then parts * PROBES rows reach the driver whatever the
    input. A target whose nearest probe is within tolerance * (bytes of a part) is done; else the
    stretch between its probes, cut to the keys that occur, is probed again. A stretch of a single
    hash goes on by id, so groups of equal texts are divided only where no border between texts
    is near enough.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    goals = [total * k // parts for k in range(1, parts)]
    allowed = total / parts * tolerance
    done: dict[int, tuple[int, int]] = {}
    waiting = {0: [k for k in range(len(goals)) if total]}
    intervals = [_Interval(0, 0, 2**63 - 1, None, FIRST_PROBES)]
    while waiting:
        counted = (_probed(keys, intervals).groupBy("i", "p")
                   .agg(F.sum("size").alias("bytes"), F.min("__h").alias("h0"),
                        F.max("__h").alias("h1"), F.min("__d").alias("d0"),
                        F.max("__d").alias("d1")).collect())
        cells: dict[int, list] = {}
        for row in sorted((r for r in counted if r.i is not None), key=lambda r: (r.i, r.p)):
            cells.setdefault(row.i, []).append(row)
        following, still = [], {}
        for i, which in waiting.items():
            interval = intervals[i]
            for k in which:
                below = interval.below
                for row in cells[i]:
                    if below + row.bytes > goals[k] or row is cells[i][-1]:
                        break
                    below += row.bytes
                start = (row.h0, -2**63) if interval.fixed is None else (row.h0, row.d0)
                short, over = goals[k] - below, below + row.bytes - goals[k]
                one = row.h0 == row.h1 and row.d0 == row.d1
                if short <= allowed or one and short <= over:
                    done[k] = start
                elif over <= allowed or one:
                    done[k] = (row.h1, 2**63 - 1) if interval.fixed is None else (row.h1, row.d1)
                    done[k] = (done[k][0], done[k][1], 1)
                else:
                    fixed = row.h0 if row.h0 == row.h1 else None
                    lo, hi = (row.h0, row.h1) if fixed is None else (row.d0, row.d1)
                    if not following or (following[-1].lo, following[-1].fixed) != (lo, fixed):
                        following.append(_Interval(below, lo, hi, fixed, PROBES))
                    still.setdefault(len(following) - 1, []).append(k)
        intervals, waiting = following, still
    return [done[k] for k in sorted(done)]


def _part(borders: list[tuple]) -> Column:
    """Number of borders at or below a row's key, as a balanced tree of comparisons."""
    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        m = (lo + hi) // 2
        h, d, *after = borders[m]
        reached = f"__h > {h}L or __h = {h}L and __d {'>' if after else '>='} bigint('{d}')"
        return f"if({reached}, {tree(m + 1, hi)}, {tree(lo, m)})"

    return F.expr(tree(0, len(borders)))


def shard(docs: DataFrame, shards: int = 24, parts_per_shard: int = 8,
          tolerance: float = 0.02) -> DataFrame:
    """docs(doc_id, text, ...) with size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 bytes of the text plus 8, the law is `bytes`: shards of nearly equal bytes.
    Rows are sorted by (hash of the text, doc_id) over shards * parts_per_shard parts found by
    `splitters`; each part is one group of the only exchange of whole rows, and its rank plus the
    rows of the shard's earlier parts is the slot, gapless from 0. Equal texts take slots side by
    side, in one shard but where a border has to divide them. More data than a task can sort: raise
    parts_per_shard; the shards stay nearly the same.

    A null text has no bytes and the checksum of no bytes; a null doc_id sorts before all others.
    Repeated rows sort side by side, and rows of one text and doc_id are never divided. With fewer
    rows than shards some shards are empty; an empty table gives no rows. Columns of docs named
    like an added one are replaced. grown_shard is null under this law.
    """
    cols = [c for c in docs.columns if c not in _ADDED]
    rows = _keys(docs.select(*cols))
    keys = stored(rows.select("__h", "__d", "size"))
    borders = splitters(keys, shards * parts_per_shard, tolerance)
    part = _part(borders)
    n_of = {r[0]: r[1] for r in keys.groupBy(part.alias("p")).count().collect()}
    before, shard_of, run, last = [], [], 0, -1
    for p in range(len(borders) + 1):
        s = p // parts_per_shard
        run, last = (0 if s != last else run), s
        before.append(run)
        shard_of.append(s)
        run += n_of.get(p, 0)
    at = lambda values, kind: F.element_at(literals(values, kind), F.col("__part") + 1)
    crc = F.crc32(F.coalesce("text", F.lit(""))).cast("long")
    order = Window.partitionBy("__part").orderBy("__h", "__d", "text_crc32")
    return (rows.withColumn("__part", part).withColumn("text_crc32", crc)
            .withColumn("__rank", F.row_number().over(order) - 1)
            .select(*cols, "size", "text_crc32", F.lit("bytes").alias("law"),
                    at(shard_of, "int").alias("shard"),
                    (at(before, "long") + F.col("__rank")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
