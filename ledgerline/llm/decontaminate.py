"""Benchmark decontamination: MinHash containment search of the items, exact confirmation.

Similarity of sets is of no use where a short item lies inside a long text, so samples are taken
from the item alone: if a share c of the item's shingles lies in a text, each of the item's MinHash
shingles lies there with probability c. There are two paths by set size: small sets are searched
whole, larger ones by a number of samples that leaves a chance below 1e-9 of missing an item at the
threshold. Hits are looked up in one pass over the texts, and a text with enough hits of an item is
compared with the item's whole set in place.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _PLACE, _base_powers, mixed, small_batches, steps, text_bytes

SHINGLE, PERCENT = 5, 80
#: Sets up to this size are searched whole.
SMALL = 32
#: Samples of each larger set.
SAMPLES = 48
#: Shingles of the items that one pass over the texts holds in each task: 16 bytes each.
BLOCK_SHINGLES = 1 << 21

#: Scripts without blanks between words: Thai, Lao, Myanmar, Khmer, Tai, Han and kana.
_UNSPACED = [(0xE01, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF),
             (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x303C), (0x3041, 0x3096),
             (0x309D, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
             (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9D),
             (0x16FE2, 0x16FF1), (0x1AFF0, 0x1B16F), (0x20000, 0x323AF)]
#: Code points from here on hold no letters or digits.
_END = 0x323B0


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 between words, 1 in a word, 2 a word of its own; and the code point in
    lower case, one for one, final sigma as any other."""
    kind, lower = np.zeros(_END + 1, np.uint8), np.arange(_END + 1, dtype=np.uint64)
    for c in range(_END):
        if unicodedata.category(chr(c))[0] in "LMN":
            kind[c] = 1
            lower[c] = ord(chr(c).lower()[0])
    lower[ord("ς")] = ord("σ")
    for first, last in _UNSPACED:
        kind[first:last + 1] *= 2
    return kind, lower


_KIND, _LOWER = _letters()
_LETTER = mixed(_LOWER + np.uint64(1))
_draws = np.random.default_rng(11)
_FACTOR = _draws.integers(0, 2**64, SAMPLES, np.uint64) | np.uint64(1)
_SHIFT = _draws.integers(0, 2**64, SAMPLES, np.uint64)


def _least_hits(samples: int) -> int:
    """Hits that an item at the threshold misses with a chance below 1e-9."""
    c = PERCENT / 100
    chance, k = 0.0, 0
    while k < samples:
        chance += math.comb(samples, k) * c**k * (1 - c) ** (samples - k)
        if chance > 1e-9:
            break
        k += 1
    return max(1, k)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts (one entry more)."""
    raw, starts = text_bytes(column)
    data = raw.tobytes()
    try:
        text = data.decode()
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[starts]
    except UnicodeDecodeError:
        texts = [data[a:b].decode(errors="replace")
                 for a, b in zip(starts[:-1], starts[1:], strict=True)]
        text, heads = "".join(texts), np.cumsum([0, *map(len, texts)])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), heads


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words start."""
    points, starts = _points(column)
    points = np.minimum(points, _END)
    kind = _KIND[points]
    inside = kind > 0
    begins = inside.copy()
    begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
    heads = starts[:-1][starts[:-1] < len(points)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    of_text = np.searchsorted(at, starts)
    if not len(at):
        return np.zeros(0, np.uint64), of_text
    values = _LETTER[points[inside]]
    first = (np.cumsum(inside) - 1)[at]
    lengths = np.diff(np.append(first, len(values)))
    values *= _base_powers(int(lengths.max()))[np.arange(len(values)) - np.repeat(first, lengths)]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64)), of_text


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, by first word, across the borders of texts."""
    count = max(0, len(words) - n + 1)
    joined = np.full(count, n, np.uint64)
    for k in range(n):
        joined += words[k:k + count] * _PLACE[k]
    return mixed(joined)


def _sets(column: pa.Array, lengths: Iterable[int], inside: bool) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles, and of its runs of `lengths` words: of
    all runs inside it, or only of one that is the whole text."""
    words, of_text = _words(column)
    runs = [(n, _runs(words, n)) for n in (SHINGLE, *lengths)]
    for a, b in zip(of_text[:-1], of_text[1:], strict=True):
        yield np.unique(np.concatenate([r[a:max(a, b - n + 1)] for n, r in runs
                                        if inside or n in (SHINGLE, b - a)]))


def _item(text: str) -> tuple[int, np.ndarray]:
    """(words of a shingle, set) of an item: one of fewer than SHINGLE words is one run of all."""
    words, _ = _words(pa.array([text], pa.string()))
    n = min(SHINGLE, len(words))
    return n, np.unique(_runs(words, n)) if n else words


class _Index:
    """The items of one block: their sets, the lengths of items below SHINGLE words, and a sorted
    table from sample shingle to item."""

    def __init__(self, ids: list, sets: list[np.ndarray], sizes: list[int]):
        self.ids, self.sets = ids, sets
        self.lengths = sorted(set(sizes) - {SHINGLE})
        hashes, owners, self.need = [], [], []
        for i, s in enumerate(sets):
            if len(s) <= SMALL:
                probe, need = s, max(1, math.ceil(PERCENT * len(s) / 100))
            else:
                least = np.argmin(mixed(s[:, None] * _FACTOR + _SHIFT), axis=0)
                probe, need = s[least], _least_hits(SAMPLES)
            self.need.append(need)
            hashes.append(probe)
            owners.append(np.full(len(probe), i))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, int))[order]
        # Most shingles of a text end at this bitmap of hash prefixes.
        self.bits = max(10, min(24, int(math.log2(len(self.hashes) + 1)) + 5))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hashes >> np.uint64(64 - self.bits)] = True

    def matches(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, number of its shingles in the text) for a text's sorted set."""
        some = text[self.seen[text >> np.uint64(64 - self.bits)]]
        lo = np.searchsorted(self.hashes, some, "left")
        n = np.searchsorted(self.hashes, some, "right") - lo
        if not n.any():
            return
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        hit, counts = np.unique(self.owners[at], return_counts=True)
        for i, hits in zip(hit, counts, strict=True):
            own = self.sets[i]
            if hits >= self.need[i]:
                shared = len(np.intersect1d(own, text, assume_unique=True))
                if 100 * shared >= PERCENT * len(own):
                    yield int(i), shared


def _blocks(items: DataFrame) -> Iterator[_Index]:
    """Indexes of at most BLOCK_SHINGLES shingles (or one item), in order of item_id."""
    ids, sets, sizes, held = [], [], [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        size, own = _item(row.text)
        if not len(own) or row.item_id is None:
            continue
        if sets and held + len(own) > BLOCK_SHINGLES:
            yield _Index(ids, sets, sizes)
            ids, sets, sizes, held = [], [], [], 0
        ids.append(row.item_id)
        sets.append(own)
        sizes.append(size)
        held += len(own)
    if sets:
        yield _Index(ids, sets, sizes)


def leaks(docs: DataFrame, items: DataFrame, short_inside: bool = False) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment): documents that hold benchmark items.

    Words are runs of letters, marks and digits of any script in lower case; in scripts without
    blanks each letter is a word. A set holds the distinct shingles of five words. A pair is a row
    if at least 80 % of the item's shingles occur anywhere in the document. An item of fewer words
    is one shingle of all its words: with short_inside it is found wherever a document has these
    words in a row, as the registered queries ask for, else only in a document of just these words.

    The items are a stated query set. They are read in blocks of bounded size; each block is sent
    to the tasks (32 MB at most, beside single larger items) and takes one pass over the documents
    without a shuffle, whatever the number of matches of an item or a document.

    Null and empty texts, and texts without words, match nothing; items with a null item_id are
    left out. Repeated items or documents give their rows each. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    out = None
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for index in _blocks(wanted):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows = []
                for part in steps(batch, "text"):
                    for d, text in zip(part["doc_id"].to_pylist(),
                                       _sets(part["text"], index.lengths, short_inside),
                                       strict=True):
                        for i, shared in index.matches(text):
                            size = len(index.sets[i])
                            rows.append((d, index.ids[i], size, shared, shared / size))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        columns, [pa.int64()] * 4 + [pa.float64()], strict=True)],
                    ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, short_inside: bool = False) -> DataFrame:
    """The rows of docs(doc_id, text, ...), all columns, whose text holds no item as `leaks` has
    it. The rows are filtered where they are read, without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text"):
                    yield part.filter(pa.array(
                        [next(sent.value.matches(text), None) is None
                         for text in _sets(part["text"], sent.value.lengths, short_inside)],
                        pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
