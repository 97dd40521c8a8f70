"""Line positions inside a document without one task per document."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.lineage import written


def number_rows(df: DataFrame, key: str, order_by: list[str], chunk: list[Column],
                position: str) -> DataFrame:
    """0-based position of every row inside its key.

    `chunk` must never decrease along `order_by`. Rows are numbered inside (key, chunk) and shifted
    by the number of rows in earlier chunks, so a key that holds most of the rows is spread over
    its chunks. The row counts per chunk are combined before their shuffle.
    """
    chunked = df.withColumn("_chunk", F.struct(*chunk))
    before = Window.partitionBy(key).orderBy("_chunk")\
        .rowsBetween(Window.unboundedPreceding, -1)
    # Only keys with more than one chunk need a shift; the first chunk of a key never does.
    shifts = (chunked.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_shift", F.sum("_n").over(before))
              .filter(F.col("_shift").isNotNull()).drop("_n"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order_by)
    return (chunked.withColumn("_inside", F.row_number().over(inside) - 1)
            .join(shifts, [key, "_chunk"], "left")
            .withColumn(position, (F.col("_inside") + F.coalesce("_shift", F.lit(0))).cast("long"))
            .drop("_chunk", "_inside", "_shift"))


def _running(batches: Iterator[pa.RecordBatch], key: str, weight: str) -> Iterator[pa.RecordBatch]:
    """Adds the part's number and the sum of weights of earlier rows of the same key in it."""
    part = TaskContext.get().partitionId()
    last, carried = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key]
        same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False)
        both_null = pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1]))
        new = np.ones(batch.num_rows, bool)
        new[1:] = ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
        new[0] = last is None or last != (keys[0].as_py(),)
        sizes = batch[weight].to_numpy().astype(np.int64)
        before = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(new)
        base = np.concatenate([[-carried], before[starts]])[np.cumsum(new)]
        at = before - base
        last, carried = (keys[-1].as_py(),), int(at[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(at), pa.array(np.full(batch.num_rows, part, np.int32))],
            [*batch.schema.names, "_at", "_part"])


def number_in_place(df: DataFrame, key: str, position: str) -> DataFrame:
    """0-based position of every row inside its key, for rows of a key that follow each other in one
    part. No shuffle; the key is left out."""
    rows = df.withColumn("_size", F.lit(1).cast("long"))
    schema = rows.withColumn("_at", F.lit(0).cast("long"))\
        .withColumn("_part", F.lit(0).cast("int")).schema
    return (rows.mapInArrow(lambda batches: _running(batches, key, "_size"), schema)
            .withColumnRenamed("_at", position).drop(key, "_size", "_part"))


def rank_rows(df: DataFrame, key: str, order_by: list[str], position: str,
              weight: str | None = None) -> DataFrame:
    """0-based position of every row inside its key, nulls of order_by first; with a weight, the
    sum of the weights of the earlier rows of the key.

    One range sort by (key, order_by) over all rows, written once, so a key with any share of the
    rows lies in as many parts as its rows fill. Rows are numbered inside their part; a part goes
    on with at most one key of earlier ones, so the shifts that are broadcast are no more than
    there are parts. Rows that are equal in key and order_by are numbered in any order.
    """
    size = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.withColumn("_size", size).repartitionByRange(key, *order_by)\
        .sortWithinPartitions(key, *order_by)
    schema = rows.withColumn("_at", F.lit(0).cast("long"))\
        .withColumn("_part", F.lit(0).cast("int")).schema
    numbered = written(rows.mapInArrow(lambda batches: _running(batches, key, "_size"), schema))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (numbered.groupBy(key, "_part").agg(F.sum("_size").alias("_n"))
              .withColumn("_shift", F.sum("_n").over(before)).filter("_shift is not null")
              .select(F.col(key).alias("_key"), F.col("_part").alias("_in"), "_shift"))
    return (numbered.join(F.broadcast(shifts), F.col(key).eqNullSafe(F.col("_key"))
                          & (F.col("_part") == F.col("_in")), "left")
            .withColumn(position, F.col("_at") + F.coalesce("_shift", F.lit(0)))
            .drop("_size", "_at", "_part", "_key", "_in", "_shift"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows of each batch, and how often it holds them."""
    for batch in batches:
        names = batch.schema.names
        copies = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate(
            [([], "count_all")]).select([*names, "count_all"]).rename_columns([*names, "_copies"])
        yield from copies.to_batches()


def number_copies(df: DataFrame, key: str, order_by: list[str], position: str) -> DataFrame:
    """Position of every row inside its key, for rows that may be exact copies of each other.

    Copies are counted before the shuffle and written out again at the end, so that a line repeated
    any number of times costs one row for each batch that holds it until then; copies from several
    batches stand side by side, and which one comes first does not show. `order_by` must name every
    column but the key.
    """
    # One zero: copies may differ in its sign.
    zeros = [(F.col(c) + F.lit(0.0)).cast(t).alias(c) if t in ("double", "float") else F.col(c)
             for c, t in df.select(key, *order_by).dtypes]
    rows = df.select(*zeros)
    schema = rows.withColumn("_copies", F.lit(0).cast("long")).schema
    counted = rows.mapInArrow(_counted, schema)
    first = F.col("_first")
    return (rank_rows(counted, key, order_by, "_first", "_copies")
            .withColumn(position, F.explode(F.sequence(first, first + F.col("_copies") - 1)))
            .drop("_first", "_copies"))
