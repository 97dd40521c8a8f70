"""CSV files read by many tasks, also where cells hold separators, quotes and line breaks.

A file is cut into blocks wherever Spark splits it. Whether a block begins inside a quoted cell
cannot be told from the block alone, so each is read for both cases: does it end inside one, and
how many records begin in it. These answers are one small row a block; chained along the file they
give the true beginning, and the number of the first record, of every block. Then each block is
parsed by its own task, and only the records that cross a border are put together afterwards.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.lineage import written

_PLAN = ("doc_id string, start long, out_inside boolean, in_inside boolean, out_records long, "
         "in_records long, out_width int, in_width int")
_PARSED = "doc_id string, start long, row_idx long, cells array<string>, fragment string"
_BLANK = re.compile(r"[ \t]*[\r\n]*")
_RETURN = re.compile(r"(?<=\r)(?=[^\n])")
_BATCH = 4096


def _pieces(lines: Iterable[str]) -> Iterator[str]:
    """Lines with their ends; a carriage return on its own ends a line too."""
    for line in lines:
        if "\r" in line:
            yield from _RETURN.split(line + "\n")
        else:
            yield line + "\n"


class Records:
    """Records of a block, read line by line.

    The csv module reads quotes as the loader of the reference semantics does: they count where
    they begin a cell, two of them inside are one, and other text may follow the closing one.
    After the last record `head` is the text up to the end of a record that began before the block
    (inside: the block begins in a quoted cell), `tail` the text of one that goes on behind it. A
    block that lies within one record is all head. Lines of blanks between records are none.
    """

    def __init__(self, lines: Iterable[str], inside: bool):
        self.lines, self.inside = lines, inside
        self.head: str | None = None
        self.tail: str | None = None
        self.ends_inside = False

    def __iter__(self) -> Iterator[list[str]]:
        csv.field_size_limit(sys.maxsize)
        taken: list[str] = []
        used_up = False

        def feed() -> Iterator[str]:
            nonlocal used_up
            for k, piece in enumerate(_pieces(self.lines)):
                taken.append(piece)
                # An opening quote puts the reader where the block begins.
                yield '"' + piece if self.inside and not k else piece
            used_up = True

        for k, record in enumerate(csv.reader(feed())):
            # The reader asks for more lines than there are only in the middle of a record.
            self.ends_inside = used_up
            if self.inside and not k:
                self.head = "".join(taken)
            elif used_up:
                self.tail = "".join(taken)
            elif record and not (len(record) == 1 and _BLANK.fullmatch(taken[0])):
                yield record
            taken.clear()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows of one block, with its key (doc_id, start)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        same = pc.and_(*(pc.equal(batch[c][1:], batch[c][:-1]) for c in ("doc_id", "start")))
        cuts = np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1
        borders = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            part = batch.slice(a, b - a)
            yield (part["doc_id"][0].as_py(), part["start"][0].as_py()), part


def _summary(lines: list[pa.Array]) -> tuple:
    """Of both cases: whether the block ends inside a cell, records that begin in it, width."""
    quoted = any(pc.any(pc.match_substring(a, '"')).as_py() for a in lines)
    returns = any(pc.any(pc.match_substring_regex(a, r"\r[^\r]")).as_py() for a in lines)
    if not quoted and not returns:
        full = [a.filter(pc.invert(pc.match_substring_regex(a, r"^[ \t\r]*$"))) for a in lines]
        widths = [pc.max(pc.count_substring(a, ",")).as_py() for a in full if len(a)]
        return False, True, sum(map(len, full)), 0, max(widths, default=-1) + 1, 0
    found = []
    for inside in (False, True):
        records = Records(chain.from_iterable(a.to_pylist() for a in lines), inside)
        n = width = 0
        for record in records:
            n, width = n + 1, max(width, len(record))
        found.append((records.ends_inside, n + (records.tail is not None), width))
    return tuple(chain.from_iterable(zip(*found, strict=True)))


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, runs in groupby(_runs(batches), itemgetter(0)):
        row = (*key, *_summary([part["value"] for _, part in runs]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(),
                                                    pa.int64(), pa.int64(), pa.int32(),
                                                    pa.int32()], strict=True)],
            [f.split()[0] for f in _PLAN.split(", ")])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        [f.split()[0] for f in _PARSED.split(", ")])


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield _rows(held)
            held = []
    if held:
        yield _rows(held)


def _cells(record: list[str]) -> list[str | None]:
    return [c or None for c in record]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records with cells; parts of a record that crosses a border as fragments."""
    def rows() -> Iterator[tuple]:
        for key, runs in groupby(_runs(batches), itemgetter(0)):
            _, part = next(runs)
            inside, at = part["inside"][0].as_py(), part["first"][0].as_py()
            records = Records(chain(part["value"].to_pylist(), chain.from_iterable(
                p["value"].to_pylist() for _, p in runs)), inside)
            begun = at
            for record in records:
                yield *key, at, _cells(record), None
                at += 1
            if records.head is not None:
                yield *key, begun - 1, None, records.head
            if records.tail is not None:
                yield *key, at, None, records.tail
    yield from _batched(rows())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by record and place, put together."""
    def rows() -> Iterator[tuple]:
        parts = (row for batch in batches for row in batch.to_pylist())
        for (doc, at), mine in groupby(parts, lambda r: (r["doc_id"], r["row_idx"])):
            mine = list(mine)
            text = "".join(r["fragment"] for r in mine)
            # A cell that is never closed ends with its file, not with a line break more.
            for record in csv.reader(iter([text.removesuffix("\n")])):
                yield doc, mine[0]["start"], at, _cells(record), None
    csv.field_size_limit(sys.maxsize)
    yield from _batched(rows())


def _chained(plan: DataFrame) -> DataFrame:
    """Blocks with `inside` (begins in a cell) and `first` (number of the next record).

    A block sends its two possible beginnings to two ends: it keeps them, swaps them, or ends the
    same way for both. So the state before a block is that of the latest block of the last kind,
    swapped as often as blocks since then swap; all of it running aggregates over small rows.
    """
    earlier = Window.partitionBy("doc_id").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    settles = F.col("out_inside") == F.col("in_inside")
    swaps = F.count_if(F.col("out_inside") & ~F.col("in_inside")).over(earlier)
    known = plan.withColumn("swaps", F.coalesce(swaps, F.lit(0))).withColumn(
        "settled", F.when(settles, F.struct("out_inside", "swaps")))
    last = F.last("settled", ignorenulls=True).over(earlier)
    state = known.withColumn("last", last).withColumn(
        "odd", (F.col("swaps") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1).withColumn(
        "inside", F.coalesce("last.out_inside", F.lit(False)) != F.col("odd"))
    begun = F.when(F.col("inside"), F.col("in_records")).otherwise(F.col("out_records"))
    width = F.when(F.col("inside"), F.col("in_width")).otherwise(F.col("out_width"))
    whole = Window.partitionBy("doc_id")
    return state.withColumn("n", begun).select(
        "doc_id", "start", "inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
        F.max(width).over(whole).alias("width"))


def read_csv_rows(spark: SparkSession, path) -> DataFrame:
    """rows(doc_id, row_idx, cells) of CSV files; doc_id is the path of the file.

    Commas, quotes and line breaks in quoted cells are text. Empty cells are null, lines of blanks
    are passed over, and the rows of a file are filled up to its widest one. Files of any size are
    read by as many tasks as Spark cuts them into (`spark.sql.files.maxPartitionBytes`); what is
    broadcast is one row for each block but the first of its file. A cell that is never closed
    goes on to the end of its file.
    """
    meta = F.col("_metadata")
    text = F.make_valid_utf8(F.col("value"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("doc_id"), meta["file_block_start"].alias("start"),
        F.when(meta["file_block_start"] == 0, F.regexp_replace(text, "^\ufeff", ""))
        .otherwise(text).alias("value"))
    plan = written(_chained(lines.mapInArrow(_plan, _PLAN)))
    later = plan.filter("start > 0").select("doc_id", "start", "inside", "first")
    known = lines.join(F.broadcast(later), ["doc_id", "start"], "left").select(
        "doc_id", "start", "value", F.coalesce("inside", F.lit(False)).alias("inside"),
        F.coalesce("first", F.lit(0)).alias("first"))
    parsed = written(known.mapInArrow(_parsed, _PARSED))
    crossing = written(parsed.filter("fragment is not null").repartition("doc_id", "row_idx")
                       .sortWithinPartitions("doc_id", "row_idx", "start")
                       .mapInArrow(_joined, _PARSED))
    # Joined by block, so that a file of any size has no key of more rows than a block.
    wider = crossing.groupBy("doc_id").agg(F.max(F.size("cells")).alias("crossing"))
    widths = plan.join(wider, "doc_id", "left").select(
        "doc_id", "start", F.greatest("width", F.coalesce("crossing", F.lit(0))).alias("width"))
    missing = F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size("cells"))
    return (parsed.filter("fragment is null").unionByName(crossing)
            .join(widths, ["doc_id", "start"])
            .select("doc_id", "row_idx", F.concat("cells", missing).alias("cells")))
