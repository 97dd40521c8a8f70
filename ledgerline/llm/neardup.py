"""Near-duplicates: MinHash bands, odd sketches as a filter, exact confirmation, components.

The samples of a MinHash signature serve twice. Bands of four samples find candidates; all samples
are folded into a bitmap in which each (place, sample) flips one bit. Two bitmaps differ in at most
two bits for every place where the samples differ, so the population count of their XOR bounds and
estimates the similarity of a candidate pair without its texts. A second bitmap folds the whole set
(a sample of all): its XOR never has more bits than the symmetric difference has members, which
sorts out pairs just below the threshold. Pairs that pass are confirmed on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (mixed, shingle_hashes, small_batches, steps, stored, text_bytes, word_hashes)
from .components import components

BANDS, ROWS, BITS, WHOLE_BITS = 32, 4, 1024, 2048
#: Members of a bucket that one group of the cross-component search holds, on average.
BLOCK = 4096
#: Groups into which the partners of one text are dealt for confirmation.
SPREAD = 64
#: Rounds that follow only the likeliest link of each member before all are followed.
ROUNDS = 5
#: Rows and columns of sketches compared in one numpy step.
_TILE = 256

_draws = np.random.default_rng(7)
_FACTOR = _draws.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFT = _draws.integers(0, 2**64, BANDS * ROWS, np.uint64)
_SALT = _draws.integers(0, 2**64, BANDS * ROWS, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a:a + 4096, None] * _FACTOR + _SHIFT
        np.minimum(least, part.min(axis=0), out=least)
    return least


def odd_sketches(rows: np.ndarray) -> np.ndarray:
    """Parity bitmaps, one row of BITS bits for each row of samples."""
    bit = (mixed(rows ^ _SALT) % np.uint64(BITS)).astype(np.int64)
    flat = (bit + np.arange(len(rows))[:, None] * BITS).ravel()
    parity = np.bincount(flat, minlength=len(rows) * BITS).reshape(len(rows), BITS) & 1
    return np.packbits(parity.astype(bool), axis=1)


def whole_sketch(shingles: np.ndarray) -> bytes:
    """Parity bitmap of all members of a set."""
    bit = (mixed(shingles) % np.uint64(WHOLE_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=WHOLE_BITS) & 1).astype(bool)).tobytes()


def band_keys(rows: np.ndarray) -> np.ndarray:
    parts = mixed(rows).reshape(len(rows), BANDS, ROWS)
    keys = np.zeros((len(rows), BANDS), np.uint64)
    for k in range(ROWS):
        keys = mixed(keys + parts[:, :, k])
    return keys.view(np.int64)


def estimate(differing_bits: float) -> float:
    """The similarity that a population count of the XOR of two odd sketches stands for."""
    rest = max(1e-9, 1 - 2 * differing_bits / BITS)
    return 1 + BITS / (4 * BANDS * ROWS) * math.log(rest)


def most_bits(percent: int) -> int:
    """The population count that a pair of this similarity passes only with a chance below 1e-9:
    two bits for each sample that differs, six deviations above the mean."""
    k, miss = BANDS * ROWS, 1 - percent / 100
    return 2 * math.ceil(k * miss + 6 * math.sqrt(k * miss * (1 - miss)))


class _Sketches:
    """Sketches of some members: set sizes and bitmaps of samples and of whole sets."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]):
        rows = np.frombuffer(b"".join(sketches), np.uint64).reshape(
            -1, (BITS + WHOLE_BITS) // 64)
        self.sizes, self.some, self.whole = sizes, rows[:, :BITS // 64], rows[:, BITS // 64:]

    def take(self, rows: np.ndarray) -> _Sketches:
        out = object.__new__(_Sketches)
        out.sizes, out.some, out.whole = self.sizes[rows], self.some[rows], self.whole[rows]
        return out

    @staticmethod
    def joined(parts: list[_Sketches]) -> _Sketches:
        out = object.__new__(_Sketches)
        for name in ("sizes", "some", "whole"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        return out


def near(x: _Sketches, y: _Sketches, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sketches row by row: which pairs can reach the similarity, and the bits that differ."""
    least, most = np.minimum(x.sizes, y.sizes), np.maximum(x.sizes, y.sizes)
    bits = np.bitwise_count(x.some ^ y.some).sum(axis=1, dtype=np.int64)
    apart = np.bitwise_count(x.whole ^ y.whole).sum(axis=1, dtype=np.int64)
    # |difference| <= |x| + |y| - 2 * |intersection|, and the intersection of a linked pair has at
    # least percent / (100 + percent) of |x| + |y| members.
    ok = (bits <= most_bits(percent)) & (100 * least >= percent * most) & (
        (100 + percent) * apart <= (100 - percent) * (x.sizes + y.sizes))
    return ok, bits + apart


_SIGNATURE = ("doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document: set size, two hashes of the whole set, band keys and odd sketch (null of an
    empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, of_text = word_hashes(*text_bytes(part["text"]))
                n = part.num_rows
                size, k1, k2 = (np.zeros(n, np.int64) for _ in range(3))
                rows, whole = np.zeros((n, BANDS * ROWS), np.uint64), [b""] * n
                for i, found in enumerate(shingle_hashes(words, of_text, shingle)):
                    size[i] = len(found)
                    if len(found):
                        rows[i], whole[i] = samples(found), whole_sketch(found)
                        k1[i] = mixed(found).sum().view(np.int64)
                        k2[i] = mixed(found ^ np.uint64(0x5DEECE66D)).sum().view(np.int64)
                keys, sketch = band_keys(rows), odd_sketches(rows)
                some = size > 0
                bands = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32),
                    keys[some].ravel(), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], size, k1, k2, bands,
                     pa.array([s.tobytes() + w if ok else None
                               for s, w, ok in zip(sketch, whole, some, strict=True)],
                              pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNATURE)


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the similarity.

    The partners of a text are dealt into SPREAD groups and its own text is sent once to each
    group in use, so that a text with very many partners is no single task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            found = []
            for part in steps(batch, "text"):
                words, of_text = word_hashes(*text_bytes(part["text"]))
                a, b, salt = (part[c].to_numpy() for c in ("a", "id", "salt"))
                first = part["first"].to_numpy(zero_copy_only=False)
                for i, s in enumerate(shingle_hashes(words, of_text, shingle)):
                    if first[i]:
                        hub, own = (a[i], salt[i]), s
                    elif hub == (a[i], salt[i]):
                        shared = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(s) - shared):
                            found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    roles = dealt.select("a", "salt", F.lit(False).alias("first"), F.col("b").alias("id")).union(
        dealt.select("a", "salt", F.lit(True), F.col("a")).distinct())
    rows = roles.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    small_batches(pairs.sparkSession)
    return (rows.select("a", "salt", "first", "id", "text").repartition("a", "salt")
            .sortWithinPartitions("a", "salt", F.desc("first"))
            .mapInArrow(run, "a long, b long").distinct())


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sketches can reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_Sketches(batch[f"n{c}"].to_numpy(), batch[c].to_pylist()) for c in "xy")
            keep = pa.array(near(x, y, percent)[0])
            yield pa.RecordBatch.from_arrays([batch[c].filter(keep) for c in "ab"], ["a", "b"])

    at = lambda side, name: sketches.select(
        F.col("doc_id").alias(side), F.col("sketch").alias(name), F.col("n").alias(f"n{name}"))
    return (pairs.join(at("a", "x"), "a").join(at("b", "y"), "b")
            .mapInArrow(run, "a long, b long"))


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int,
            best: bool) -> DataFrame:
    """Pairs of one bucket whose members lie in different components and whose sketches are near;
    with `best`, only the nearest for each member that is sent to a block.

    Only buckets with several components take part. The members of a bucket's largest component
    are dealt into blocks; the others, few as a rule, are sent to every block. Every pair of
    members of different components then meets in one block."""
    known = members.join(labels, members.id == labels.lid, "left").select(
        "band", "key", "id", F.coalesce("component", "id").alias("component"))
    sizes = known.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    open_buckets = stored(sizes.groupBy("band", "key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"),
        F.count("*").alias("parts")).filter("parts > 1"))
    inside = known.join(open_buckets, ["band", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = inside.select(
        "band", "key", "id", "component", own.alias("own"),
        F.explode(F.when(F.col("component") == F.col("main"), F.array(own)).otherwise(
            F.sequence(F.lit(0), blocks - 1))).alias("block"),
        (F.col("component") != F.col("main")).alias("sent"))
    rows = spread.join(sketches.withColumnRenamed("doc_id", "id"), "id")

    def found(here: _Sketches, of_here: list[np.ndarray], sent: _Sketches,
              of_sent: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Rows (id here, id sent, distance)."""
        for i in range(0, len(of_here[0]), _TILE):
            h = slice(i, i + _TILE)
            for j in range(0, len(of_sent[0]), _TILE):
                t = slice(j, j + _TILE)
                close = np.bitwise_count(here.some[h][:, None, :] ^ sent.some[t][None, :, :]).sum(
                    axis=2, dtype=np.int32) <= most_bits(percent)
                p, q = np.nonzero(close & (of_here[1][h][:, None] != of_sent[1][t][None, :]))
                ok, apart = near(here.take(p + i), sent.take(q + j), percent)
                p, q, apart = p[ok] + i, q[ok] + j, apart[ok]
                if best:
                    order = np.lexsort((of_here[0][p], apart, q))
                    first = order[np.unique(q[order], return_index=True)[1]]
                    p, q, apart = p[first], q[first], apart[first]
                yield np.stack([of_here[0][p], of_sent[0][q], apart], axis=1)

    def reduced(pairs: np.ndarray) -> np.ndarray:
        if not best:
            return pairs
        order = np.lexsort((pairs[:, 0], pairs[:, 2], pairs[:, 1]))
        return pairs[order[np.unique(pairs[order, 1], return_index=True)[1]]]

    def batch_of(pairs: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.sort(np.concatenate([x[:, :2] for x in pairs]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 3), np.int64)
        group, parts, sent, of_sent, held = None, [], None, None, none
        for batch in batches:
            out = [none]
            cols = {c: batch[c].to_numpy(zero_copy_only=False) for c in
                    ("band", "key", "block", "id", "component", "own", "sent")}
            sketch = _Sketches(batch["n"].to_numpy(), batch["sketch"].to_pylist())
            change = np.flatnonzero((np.diff(cols["band"]) != 0) | (np.diff(cols["key"]) != 0)
                                    | (np.diff(cols["block"]) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                at = cols["band"][a], cols["key"][a], cols["block"][a]
                if at != group:
                    out.append(held)
                    group, parts, sent, held = at, [], None, none
                few = np.arange(a, a + int(cols["sent"][a:b].sum()))
                if len(few):
                    parts.append((cols["id"][few], cols["component"][few], sketch.take(few)))
                    sent = None
                # Sent rows come first and by id, so of two of them the later one meets the other.
                rows = np.flatnonzero(cols["own"][a:b] == at[2]) + a
                here = [cols["id"][rows], cols["component"][rows]]
                if parts and sent is None:
                    of_sent = [np.concatenate([x[k] for x in parts]) for k in (0, 1)]
                    sent = _Sketches.joined([x[2] for x in parts])
                if parts:
                    for pairs in found(sketch.take(rows), here, sent, of_sent):
                        held = reduced(np.concatenate([held, pairs]))
            if not best:
                out.append(held)
                held = none
            yield batch_of(out)
        yield batch_of([held])

    small_batches(members.sparkSession)
    return (rows.select("band", "key", "block", "id", "component", "own", "sent", "n", "sketch")
            .repartition("band", "key", "block")
            .sortWithinPartitions("band", "key", "block", F.desc("sent"), "id")
            .mapInArrow(run, "a long, b long").distinct())


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs(doc_id, text).

    Words are separated by ASCII white space, A-Z lowered; a document's set holds its distinct
    shingles of so many words. Documents are linked if 100 * |intersection| >= percent * |union|;
    component_id is the least doc_id reachable, kept is whether that is the document itself.

    Equal sets are one class first, so exact copies cost one signature row. In each bucket every
    class is compared with the bucket's least one; links found make components, and only buckets
    whose members still lie in different components are searched on, in blocks. A few rounds try
    the likeliest link of each member outside its bucket's largest component; once they bring
    nothing new, all pairs of different components that the sketches allow are confirmed. So no
    link between components is lost, and a group of thousands of near copies costs a few
    comparisons a member.

    Null or empty texts and texts without words have the empty set and are linked with nothing.
    Rows that repeat a doc_id and its text get the same result each. A null doc_id takes no part:
    component_id is null and kept true. An empty table gives no rows. Other columns
    of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_of = stored(signatures(docs, shingle))
    known = all_of.filter("n_shingles > 0 and doc_id is not null")
    sets = stored(known.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    reps = stored(known.join(sets, ["n_shingles", "k1", "k2"]).filter("doc_id = rep")
                  .select("doc_id", F.col("n_shingles").alias("n"), "bands", "sketch")
                  .dropDuplicates(["doc_id"]))
    banded = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    buckets = stored(banded.groupBy("band", "key").agg(
        F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    members = stored(banded.join(buckets, ["band", "key"]))
    sketches = reps.select("doc_id", "n", "sketch")
    tried = stored(_near(members.filter("id <> least").select(
        F.col("least").alias("a"), F.col("id").alias("b")).distinct(), sketches, percent))
    texts = stored(docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id",
                             "left_semi").dropDuplicates(["doc_id", "text"]))
    links = stored(_confirmed(tried, texts, shingle, percent))
    labels = components(links).withColumnRenamed("id", "lid")
    inside = members.select("band", "key", "id")
    rounds, best = 0, True
    while True:
        found = stored(_across(inside, labels, sketches, percent, best))
        if found.isEmpty():
            break
        more = stored(found.join(tried, ["a", "b"], "left_anti"))
        new = stored(_confirmed(more, texts, shingle, percent))
        fruitless = new.isEmpty()
        if not fruitless:
            links = links.union(new)
            labels = components(links).withColumnRenamed("id", "lid")
        if not best:
            break
        tried, rounds = tried.union(more), rounds + 1
        best = not fruitless and rounds < ROUNDS
    of_set = sets.join(labels, sets.rep == labels.lid, "left").select(
        "n_shingles", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    joined = all_of.select("doc_id", "n_shingles", "k1", "k2").join(
        stored(of_set), ["n_shingles", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
