"""Work that is done once, and rows that are combined before they are moved."""

import json
import math
import random
import re
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions import text as T
from ledgerline.operators import grid, validation
from ledgerline.operators.positions import _counted, number_copies
from ledgerline.plans import pipeline
from ledgerline.plans.queries import QUERIES


@pytest.fixture
def traced(tmp_path):
    """Rows that leave a file in a folder whenever a part of them is computed -> (rows, runs)."""
    def follow(frame):
        folder = str(tmp_path)

        def pass_on(batches):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield from batches
        return frame.coalesce(1).mapInArrow(pass_on, frame.schema)
    return follow, lambda: len(list(tmp_path.iterdir()))


def test_a_label_is_only_tried_at_its_letters(spark):
    rng = random.Random(4)
    pieces = ["PURCHASE", "ORDER", "po", "ınvoice", "İNVOICE", "Invoice #:", "tax", "Vat", "ſhipping",
              "Shipping & Handling", "FREIGHT", "ſold by", "Customer:", "ship to", "biLL to", "K",
              "total", "GRAND  TOTAL", "subtotal", "estimated\nfreight", " ", "\n", ":", "#", "€", "12.50",
              "A-7", "x", " "]
    texts = [rng.choice(["", " "]).join(rng.choices(pieces, k=rng.randint(0, 16))) for _ in range(3000)]
    x = F.col("x")
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    for pattern in (K.DOCUMENT_NUMBER, K.TAX, K.SHIPPING, K.TOTAL, K.COUNTERPARTY):
        assert "(?=" in T.labelled(pattern)
        plain, quick = [F.regexp_extract_all(x, F.lit(p), F.lit(0))
                        for p in (K.FLAGS + pattern, T.labelled(pattern))]
        assert not frame.filter(plain != quick).collect()
        assert frame.filter(F.size(plain) > 0).count() > 0


def test_texts_are_made_once(spark, traced):
    follow, runs = traced
    texts = follow(spark.createDataFrame(
        [("a", "Customer: Ann\nItem Description Qty Price\nred rod 2 1.50 3.00\nTotal: 3"),
         ("b", "nothing to read")], "doc_id string, text string"))
    docs, lines, rejects = pipeline.combine([pipeline.extract_whole_texts(texts)], lambda text: "no")
    assert [d.customer_raw for d in docs.collect()] == ["Ann"]
    assert [x.raw_description for x in lines.collect()] == ["red rod"]
    assert [r.doc_id for r in rejects.collect()] == ["b"]
    assert runs() == 1


def test_only_open_texts_are_put_together(spark):
    """Parts of documents without a line, in their order; a document without a key is one too."""
    docs = spark.createDataFrame([], pipeline.DOC)
    lines = spark.createDataFrame([("a", 0, None, None, "x", None, None, 1.0, 1.0, 1.0)], pipeline.LINE)
    texts = spark.createDataFrame(
        [("a", 0, "read"), ("b", 1, "two"), ("b", 0, "one"), (None, 0, "no key")],
        "doc_id string, part long, text string")

    def reply(text):
        return json.dumps({"items": [{"raw_description": text, "quantity": 1.0}]})
    for in_parts, wanted in ((True, {("a", "x"), ("b", "one\ntwo"), (None, "no key")}),
                             (False, {("a", "x"), ("b", "one"), ("b", "two"), (None, "no key")})):
        route = pipeline.Extracted(docs, lines, texts, in_parts)
        _, found, rejects = pipeline.combine([route], reply)
        assert {(r.doc_id, r.raw_description) for r in found.collect()} >= wanted - {(None, "no key")}
        assert not rejects.collect()
        _, _, rejects = pipeline.combine([route])
        assert {r.doc_id for r in rejects.collect()} == {"b", None}


def test_grid_rows_are_made_once(spark, traced):
    follow, runs = traced
    rows = follow(spark.createDataFrame(
        [("g", 0, ["Description", "Qty", "Price"]), ("g", 1, ["red rod", "2", "1.5"]),
         ("g", 2, ["Total", "", "3"])], "doc_id string, row_idx long, cells array<string>"))
    assert [x.raw_description for x in grid.grid_lines(rows).collect()] == ["red rod"]
    assert runs() == 1


def test_smallest_places_need_no_sorted_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0, 1, 5, 2 ** 40]),
             rng.randint(0, 5), rng.randint(0, 2), rng.choice("xyz")) for _ in range(600)]
    rows += [("a", validation.DOCUMENT_LEVEL, 5, 0, "x"), ("c", validation.DOCUMENT_LEVEL, 0, 0, "x")]
    frame = spark.createDataFrame(rows, "doc_id string, line_pos long, rank int, step int, reason string")
    # A reason of an arithmetic check is never one of another rule.
    frame = frame.withColumn("reason", F.concat("reason", F.when(F.col("rank") == 0, "!").otherwise("")))
    line = F.when(F.col("rank") == 0, F.lit(-1)).otherwise(F.col("line_pos")).cast("long")
    text = F.when(F.col("rank") == 0, F.col("reason")).otherwise("")
    plain = frame.groupBy("doc_id", "reason").agg(F.min(F.struct(
        "rank", text.alias("sort_text"), line.alias("line_pos"), "step")).alias("place"))
    found = validation.distinct_reasons(frame)
    assert found.select("place.*").dtypes == plain.select("place.*").dtypes
    assert sorted(found.collect(), key=str) == sorted(plain.select(*found.columns).collect(), key=str)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_copies_are_counted_in_their_batch(spark):
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, None, 1, None], "v": [0.5, 0.5, None, 2.0, None]})
    found = [tuple(r.values()) for b in _counted(iter([batch])) for r in b.to_pylist()]
    assert sorted(found, key=str) == sorted([(1, 0.5, 2), (None, None, 2), (1, 2.0, 1)], key=str)
    rows = [(1, 0.0), (1, -0.0), (1, float("nan")), (1, 3.0), (1, 3.0), (1, None), (2, 1.0), (None, 1.0)] * 20
    frame = spark.createDataFrame(rows, "k long, v double").repartition(5)
    numbered = number_copies(frame, "k", ["v"], "at").collect()
    assert len(numbered) == len(rows)
    rank = {None: 0, "0.0": 1, "3.0": 2, "nan": 3}
    ones = sorted((r.at, rank[None if r.v is None else str(r.v)]) for r in numbered if r.k == 1)
    assert [a for a, _ in ones] == list(range(120)) and [k for _, k in ones] == sorted(k for _, k in ones)
    assert not [r for r in numbered if r.v == 0 and math.copysign(1, r.v) < 0]
    assert sorted(r.at for r in numbered if r.k is None) == list(range(20))


def test_large_shuffles_begin_with_many_parts(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        QUERIES["customer_id_pick"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) >= 512
    finally:
        if before:
            spark.conf.set(name, before)


def test_written_tables_are_packed(spark, tmp_path):
    from ledgerline.operators.lineage import written
    files = written(spark.range(5)).inputFiles()
    assert files and all(re.search(r"\.zstd\.parquet$", f) for f in files)
