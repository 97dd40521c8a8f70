"""Shared helpers: tables in the shared folder, Arrow batches, 64-bit hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.lineage import ensure_checkpoint_dir

#: Text bytes that one numpy step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch: a batch of long texts must fit a Python worker's memory.
BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/ledgerline-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder and read from there; survives lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def literals(values: Iterable[int | str | bool | None], kind: str) -> Column:
    """An array of constants, as one parsed expression."""
    quoted = (f"'{v.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'"
              if isinstance(v, str) else "null" if v is None else f"'{v}'" for v in values)
    return F.expr(f"cast(array({', '.join(quoted)}) as array<{kind}>)")


def small_batches(spark: SparkSession) -> None:
    """Limit the rows of Arrow batches of this session; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about STEP_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + STEP_BYTES)))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (one entry more). Null: empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[starts[0]:starts[-1]], starts - starts[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_draws = np.random.default_rng(2024)
_BYTE = _draws.integers(0, 2**64, 256, np.uint64)
_BASE = int(_draws.integers(0, 2**60)) * 8 + 5
_PLACE = _draws.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def _base_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown)
    return _powers


def word_hashes(raw: np.ndarray, starts: np.ndarray, space: np.ndarray = SPACE
                ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z lowered, and where each text's words start.

    space: which byte values separate words."""
    inside = ~space[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < len(raw)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    of_text = np.searchsorted(at, starts)
    if not len(at):
        return np.zeros(0, np.uint64), of_text
    letters = LOWER[raw[inside]]
    first = np.cumsum(inside)[at] - 1
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    values = _BYTE[letters] * _base_powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64)), of_text


def shingle_hashes(words: np.ndarray, of_text: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; of fewer words, one of them all."""
    n = max(0, len(words) - size + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(size):
        joined += words[k:k + n] * _PLACE[k]
    joined = mixed(joined)
    for a, b in zip(of_text[:-1], of_text[1:], strict=True):
        if b - a >= size:
            yield np.unique(joined[a:b - size + 1])
        elif b > a:
            whole = (words[a:b] * _PLACE[:b - a]).sum(keepdims=True)
            yield mixed(whole + np.uint64(b - a))
        else:
            yield words[:0]
