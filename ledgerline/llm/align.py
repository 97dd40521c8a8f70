"""Alignment of two tokenizers by lockstep merging of their token borders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches, steps, stored, text_bytes

#: Bytes of a text whose borders one place of the state vector walks; a longer text has several.
STRETCH = 256
#: Pairs that hold more than one in so many of all links are broadcast; there are fewer of them
#: than this, however large the corpus.
HEAVY = 1 << 18
_PIPE, _SEMICOLON = b"|;"


def lockstep(ends_a: np.ndarray, of_a: np.ndarray, ends_b: np.ndarray, of_b: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ends_a, in ends_b) of the tokens that end together.

    Stretch k has the ascending ends ends_a[of_a[k]:of_a[k + 1]], and so for b. One pointer per
    stretch and side moves: in each step all stretches compare their ends at once, the lower end
    moves on, equal ends are a cut and both move on. Stretches with a side used up leave.
    """
    i, stop_a, j, stop_b = of_a[:-1], of_a[1:], of_b[:-1], of_b[1:]
    cuts_a, cuts_b = [], []
    while True:
        live = (i < stop_a) & (j < stop_b)
        if not live.all():
            i, stop_a, j, stop_b = i[live], stop_a[live], j[live], stop_b[live]
        if not len(i):
            break
        a, b = ends_a[i], ends_b[j]
        cut = a == b
        cuts_a.append(i[cut])
        cuts_b.append(j[cut])
        i = i + (a <= b)
        j = j + (b <= a)
    if not cuts_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


class Side:
    """Token bytes of a tokenizer and the decimal digits of its ids, each behind one another."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens in a row."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        begins = self.offsets[ids] - (ends - sizes)
        return self.bytes[np.repeat(begins, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """Both tokenizers, read once by each Python worker."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = bpe.vocabulary(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        borders = self.a.offsets.tolist()
        blob = self.a.bytes.tobytes()
        side_a = [blob[x:y] for x, y in zip(borders[:-1], borders[1:], strict=True)]
        side_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in enumerate(map(self.b.id_to_piece, range(len(self.b))))]
        self.sides = Side(side_a), Side(side_b)
        digits = [str(i).encode() + b"," for i in range(max(len(side_a), len(side_b)))]
        self.digits = Side(digits)

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side the ids of all texts in a row and the number of each text's."""
        ids, sizes = self.a.encode_flat([" " + t if t else "" for t in texts], special=False)
        lists = self.b.encode(texts, num_threads=1)
        sizes_b = np.array([len(t) for t in lists], np.int64)
        ids_b = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes_b.sum()))
        return [(ids.astype(np.int64), sizes), (ids_b, sizes_b)]

    def align(self, raw: np.ndarray, starts: np.ndarray, texts: list[str]) -> dict:
        """Tokens, cuts and numbers of groups of texts; raw and starts are their bytes."""
        n_docs = len(texts)
        size = np.diff(starts)
        expected = size + (size > 0)
        blank = np.cumsum(expected) - expected
        wanted = np.full(expected.sum(), 0x20, np.uint8)
        is_text = np.ones(len(wanted), bool)
        is_text[blank[size > 0]] = False
        wanted[is_text] = raw
        sides = [(side, ids, np.repeat(np.arange(n_docs), counts))
                 for side, (ids, counts) in zip(self.sides, self.tokens(texts), strict=True)]
        # A text counts if its tokens spell it: as many bytes, then byte by byte.
        whole = size > 0
        for side, ids, doc in sides:
            whole &= np.bincount(doc, side.sizes[ids], n_docs) == expected
        wanted = wanted[np.repeat(whole, expected)]
        of_byte = np.repeat(np.arange(n_docs), np.where(whole, expected, 0))
        differs = [of_byte[side.spelled(ids[whole[doc]]) != wanted] for side, ids, doc in sides]
        whole[np.concatenate(differs)] = False
        length = np.where(whole, expected, 0)
        parts = -(-length // STRETCH)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = np.repeat(np.cumsum(length) - length, parts) + STRETCH * nth
        kept = []
        for side, ids, doc in sides:
            ids, doc = ids[whole[doc]], doc[whole[doc]]
            ends = np.cumsum(side.sizes[ids])
            # An end lies in the stretch that holds the byte before it.
            of = np.append(np.searchsorted(ends, begins, "right"), len(ends))
            kept.append((ids, doc, ends, of))
        (ids_a, doc_a, ends_a, of_a), (ids_b, doc_b, ends_b, of_b) = kept
        cut_a, cut_b = lockstep(ends_a, of_a, ends_b, of_b)
        return {"ids_a": ids_a, "ids_b": ids_b, "cut_a": cut_a, "cut_b": cut_b,
                "doc": doc_a[cut_a], "n_a": np.bincount(doc_a, minlength=n_docs),
                "n_b": np.bincount(doc_b, minlength=n_docs),
                "n_groups": np.bincount(doc_a[cut_a], minlength=n_docs)}

    def groups(self, found: dict) -> list[str]:
        """Groups of each text, a1,a2|b1;a3|b2,b3 in decimal ids."""
        cut_a, cut_b = found["cut_a"], found["cut_b"]
        n_a, n_b = len(found["ids_a"]), len(found["ids_b"])
        size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        # Tokens of A stand behind all groups before theirs, those of B also behind A's.
        ids = np.empty(n_a + n_b, np.int64)
        place_a = np.arange(n_a) + np.repeat(cut_b + 1 - size_b, size_a)
        place_b = np.arange(n_b) + np.repeat(cut_a + 1, size_b)
        ids[place_a], ids[place_b] = found["ids_a"], found["ids_b"]
        digits = self.digits
        ends = np.cumsum(digits.sizes[ids])
        out = digits.spelled(ids)
        out[ends[place_a[cut_a]] - 1] = _PIPE
        out[ends[place_b[cut_b]] - 1] = _SEMICOLON
        stops = np.concatenate([[0], ends])[
            np.concatenate([[0], np.cumsum(found["n_a"] + found["n_b"])])].tolist()
        data = out.tobytes()
        return [data[x:max(x, y - 1)].decode() for x, y in zip(stops[:-1], stops[1:], strict=True)]

    def links(self, found: dict) -> tuple[pa.Array, pa.Array]:
        """Distinct linked pairs of each text, as a << 32 | b, and how often each is linked."""
        n_docs, n_b = len(found["n_a"]), len(self.sides[1].sizes)
        # Text, id of A and id of B in one number: a single sort.
        key = (found["doc"] * len(self.sides[0].sizes) + found["ids_a"][found["cut_a"]]) * n_b \
            + found["ids_b"][found["cut_b"]]
        key, counts = np.unique(key, return_counts=True)
        doc, pair = np.divmod(key, len(self.sides[0].sizes) * n_b)
        pair = (pair // n_b) << 32 | pair % n_b
        starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
        offsets = pa.array(starts, pa.int32())
        return (pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())))


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, groups, pairs, times), one for each row of
    docs(doc_id, text); other columns are left out.

    A (a byte-level file) encodes the text behind a blank, B (a sentencepiece model) the text,
    to which it adds the blank; strings of special tokens are plain text. A group ends where a
    token of A and one of B end at the same byte; groups lists them in order as
    a1,a2|b1;a3|b2,b3. The two tokens at the end of a group are linked: pairs holds each linked
    id pair of the text once, as a << 32 | b, times how often it is linked.
    Null and empty texts, and those whose tokens of either side do not spell blank and text (say
    with U+2581 in them), have no tokens: zeros, no groups, no pairs. Nothing is shuffled; repeated
    rows get the same result each, an empty table gives no rows, and a long text is walked in
    stretches of STRETCH bytes, which changes no result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for part in steps(batch, "text"):
                raw, starts = text_bytes(part["text"])
                found = both.align(raw, starts, [t or "" for t in part["text"].to_pylist()])
                pairs, times = both.links(found)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *(pa.array(found[c], pa.int64())
                                       for c in ("n_a", "n_b", "n_groups")),
                     pa.array(both.groups(found), pa.string()), pairs, times],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups string, "
             "pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, count, best): how many links hold the pair; best: no other pair of its B id has
    a higher count. Counts are combined before their shuffle."""
    counts = stored(aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link")).groupBy(
        F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("count")))
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # One row for each id of B: bounded by its vocabulary.
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), of_b == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """aligned (a table that is read twice) with n_links, n_best and count_sum: over the links of
    the row, those whose pair is a best one of its B id, and the sum of their pairs' counts.

    Pairs with more than a HEAVY-th of all links, fewer than HEAVY, are broadcast and summed where
    the row lies; the others are shuffled, and no pair of these has more rows than that.
    """
    rows = aligned.withColumn("__row", F.monotonically_increasing_id())
    counts = stored(pair_counts(aligned))
    total = F.lit(aligned.agg(F.sum("n_groups")).first()[0] or 0)
    heavy = counts.filter(F.col("count") * HEAVY > total)
    light = counts.filter(F.col("count") * HEAVY <= total)
    links = rows.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("__l")).select(
        "__row", F.col("__l.pairs").alias("pair"), F.col("__l.times").alias("__n"))

    def summed(joined: DataFrame) -> DataFrame:
        return joined.groupBy("__row").agg(
            F.sum("__n").alias("n_links"),
            F.sum(F.when(F.col("best"), F.col("__n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("__n") * F.col("count")).alias("count_sum"))

    near = summed(links.join(F.broadcast(heavy), "pair"))
    far = summed(links.join(F.broadcast(heavy.select("pair")), "pair", "left_anti")
                 .join(light, "pair"))
    sums = near.unionByName(far).groupBy("__row").agg(
        *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c)
            for c in ("n_links", "n_best", "count_sum")]
    return rows.join(sums, "__row", "left").select(*aligned.columns, *zero)
