"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, small_batches, steps

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Added to each count; n-grams never seen in a language stay possible.
SMOOTHING = 0.5
UNKNOWN = "und"
#: Code points of a text that one numpy step handles; counts and scores add up over steps.
_CHUNK = 1 << 18
#: Languages of a model: its matrix has BUCKETS numbers for each and is broadcast.
MOST_LANGUAGES = 1 << 10
# Letters are Unicode's, for n-grams and for `und` alike; marks only stand inside words.
_LETTER = regex.compile(r"\p{L}")
_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_PLACE = np.random.default_rng(5).integers(0, 2**64, max(ORDERS), np.uint64) | np.uint64(1)


def normal(text: str | None) -> str:
    """Lowered words with one blank before, between and behind them; "" without a letter."""
    if not text or not _LETTER.search(text):
        return ""
    return f" {_GAP.sub(' ', text.lower()).strip(' ')} "


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, index of the text of each) over the n-grams of all texts, in bounded chunks.

    Texts are lowered; every run of characters other than letters and marks is one blank. The
    blank alone is no n-gram, and none crosses two texts. A long text comes in several chunks,
    each with the n-grams that begin in it, so chunks change no count."""
    pieces, owners, begin, held = [], [], [], 0
    for i, text in enumerate(texts):
        whole = normal(text)
        for a in range(0, len(whole), _CHUNK):
            # What follows the chunk completes the n-grams that begin at its end.
            piece = whole[a:a + _CHUNK + max(ORDERS) - 1]
            pieces.append(piece)
            owners.append(i)
            begin.append(min(_CHUNK, len(whole) - a))
            held += len(piece)
            if held >= _CHUNK:
                yield _buckets(pieces, owners, begin)
                pieces, owners, begin, held = [], [], [], 0
    if pieces:
        yield _buckets(pieces, owners, begin)


def _buckets(pieces: list[str], owners: list[int], begin: list[int]
             ) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins = inside < np.array(begin)[piece]
    word = codes != 32
    codes = codes.astype(np.uint64)
    found, of = [], []
    for n in ORDERS:
        size = max(0, len(codes) - n + 1)
        key = np.full(size, n, np.uint64)
        some = np.zeros(size, bool)
        for k in range(n):
            key += codes[k:k + size] * _PLACE[k]
            some |= word[k:k + size]
        some &= begins[:size] & (piece[:size] == piece[n - 1:n - 1 + size])
        found.append((mixed(key[some]) >> np.uint64(64 - 16)).astype(np.int32))
        of.append(piece[:size][some])
    return np.concatenate(found), np.array(owners, np.int32)[np.concatenate(of)]


def held_out(doc_id: Column) -> Column:
    """Whether a document's language is kept from the training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Languages and their log-probabilities, one row of BUCKETS for each language."""

    def __init__(self, langs: list[str], scores: np.ndarray):
        self.langs, self.scores = langs, scores

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language and its probability, for each text; UNKNOWN and 0 without a letter."""
        total = np.zeros((len(texts), len(self.langs)))
        for bucket, owner in grams(texts):
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(owner, self.scores[j][bucket], len(texts))
        known = np.array([bool(self.langs and t and _LETTER.search(t)) for t in texts], bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        # The orders overlap: each character counts once for each of them.
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / len(ORDERS))
        share = 1 / odds.sum(axis=1)
        return ([self.langs[j] if k else UNKNOWN for j, k in zip(best, known, strict=True)],
                np.where(known, share, 0.0))


def train(labelled: DataFrame) -> Model:
    """Counts over all rows of labelled(text, lang); rows with a null in either teach nothing.

    Each task adds up its n-grams in an array for each language and returns the buckets in use;
    these are summed by Spark, so at most BUCKETS numbers a language reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                langs = part["lang"].to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                sums = np.zeros((len(names), BUCKETS), np.int64)
                for bucket, owner in grams(part["text"].to_pylist()):
                    sums += np.bincount(number[owner] * BUCKETS + bucket,
                                        minlength=sums.size).reshape(sums.shape)
                for name, row in zip(names, sums, strict=True):
                    counts[name] = counts.get(name, 0) + row
        for name, row in counts.items():
            bucket = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)),
                 pa.array(row[bucket])], ["lang", "bucket", "n"])

    small_batches(labelled.sparkSession)
    parts = labelled.select("text", "lang").filter("text is not null and lang is not null")
    counted = parts.mapInArrow(run, "lang string, bucket int, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns"))
    if labelled.select("lang").distinct().limit(MOST_LANGUAGES + 2).count() > MOST_LANGUAGES + 1:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    rows = sorted(counted.collect(), key=lambda r: r.lang)
    dense = np.full((len(rows), BUCKETS), SMOOTHING)
    for i, row in enumerate(rows):
        dense[i, row.buckets] += row.ns
    scores = np.log(dense / dense.sum(axis=1, keepdims=True)) if rows else dense
    return Model([r.lang for r in rows], scores.astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs with lang_pred and score; the matrix is broadcast (256 KB for each
    language) and texts are scored in batches."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                langs, scores = sent.value.predict(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in keep), pa.array(langs, pa.string()), pa.array(scores)],
                    [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of docs(doc_id, text, lang).

    Learns from text and lang of the rows that are not held out; predictions read the text only.
    score is the probability of the language among those learned, 0 for `und`: null text, text
    without a letter, or no labelled row at all. Ties go to the first language by name. Languages
    weigh alike, however many documents they have; more than MOST_LANGUAGES are an error. A null doc_id is not held out; repeated rows
    get the same result each; an empty table gives no rows.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs, model, keep)
    return found.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
