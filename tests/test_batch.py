"""A folder of documents from discovery to the written results."""

import json

import pytest

from ledgerline.plans import batch
from ledgerline.schemas import RESULT
from ledgerline.sources.result_files import write_result_files

CUSTOMERS = "row_pos long, `Customer master ID` string, `Legal name` string"
ITEMS = "row_pos long, `Item master ID` string, `Description` string"


@pytest.fixture
def known(spark):
    return (spark.createDataFrame([(1, "C-7", "Harbour Tools")], CUSTOMERS),
            spark.createDataFrame([(1, "I-1", "brass hinge")], ITEMS))


def listed(folder, name):
    return f"file:{folder}/{name}"


def test_every_file_ends_in_results_or_rejects(spark, known, tmp_path):
    folder, out = tmp_path / "in box", tmp_path / "out"
    folder.mkdir()
    (folder / "a+b c.CSV").write_text(
        "Description,Qty,Price,Amount\nbrass hinge,2,3.00,6.00\nwood screw,1,4.00,4.00\n")
    (folder / "empty.csv").write_text("\n\n")
    (folder / "prose.csv").write_text("nothing to see\n")
    for name in ["read.pdf", "unread.pdf", "notes.txt", "scan.png"]:
        (folder / name).write_bytes(b"x")
    (folder / "nothing.csv").write_bytes(b"")
    pages = spark.createDataFrame(
        [(listed(folder, "read.pdf"), 0, "INVOICE #: Q-5\nCustomer: Harbour Tools\n"
          "Item Description Qty Price Total\nbrass hinge 2 3.00 6.00\nSubtotal: 6.00")],
        "doc_id string, page long, text string")
    images = spark.createDataFrame([(listed(folder, "scan.png"), 0, "smudge")],
                                   "doc_id string, part long, text string")
    results, rejects = batch.run(spark, str(folder), str(out), *known, pages=pages, images=images)
    found = {r.doc_id.rsplit("/", 1)[1]: r for r in results.collect()}
    assert set(found) == {"a+b c.CSV", "read.pdf"}
    assert [i.raw_description for i in found["a+b c.CSV"]["items"]] == ["brass hinge", "wood screw"]
    assert found["read.pdf"].customer_id == "C-7"
    errors = {r.doc_id.rsplit("/", 1)[1]: r.error for r in rejects.collect()}
    assert errors == {"notes.txt": "Unsupported file extension: .txt",
                      "prose.csv": "no line items and no fallback",
                      "scan.png": "no line items and no fallback",
                      "empty.csv": batch.NOT_READ, "unread.pdf": batch.NOT_READ,
                      "nothing.csv": batch.NOT_READ}
    assert sorted(p.name for p in (out / "json").glob("*.json")) == [
        "a+b c_result.json", "read_result.json"]
    record = json.loads((out / "json" / "a+b c_result.json").read_text())
    assert list(record) == [f.name for f in RESULT.fields]
    assert [i["quantity"] for i in record["items"]] == [2.0, 1.0]
    assert record["review_reasons"] == list(found["a+b c.CSV"].review_reasons)
    assert spark.read.parquet(f"{out}/routed").count() == 2
    assert spark.read.json(f"{out}/rejects").count() == 6


def test_folder_without_content(spark, known, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        batch.run(spark, str(folder), str(tmp_path / "out"), *known)
    (folder / "left.pdf").write_bytes(b"x")
    results, rejects = batch.run(spark, str(folder), str(tmp_path / "out"), *known)
    assert results is None and rejects.count() == 2


def test_result_files(spark, tmp_path):
    """Shared stems, no lines, many lines, reasons with quotes; a failed run shows no file."""
    from pyspark.sql import functions as F
    empty = {f.name: None for f in RESULT.fields if f.name not in ("items", "review_reasons")}
    heads = [("in/a.csv", "N1"), ("b/a.pdf", "N2"), ("big.csv", 'x"y\nü'), ("none.csv", None)]
    docs = spark.createDataFrame(heads, "doc_id string, document_number string")
    for field in RESULT.fields:
        if field.name in empty and field.name != "document_number":
            docs = docs.withColumn(field.name, F.lit(None).cast(field.dataType))
    lines = spark.range(5000).select(F.lit("big.csv").alias("doc_id"), F.col("id").alias("line_pos"),
                                     F.concat(F.lit('"'), "id").alias("raw_description"))
    lines = lines.unionByName(lines.limit(1).withColumn("doc_id", F.lit("in/a.csv")))
    for name in ("item_number", "isbn", "title", "author", "matched_description"):
        lines = lines.withColumn(name, F.lit(None).cast("string"))
    for name in ("quantity", "unit_price", "total_price", "match_confidence"):
        lines = lines.withColumn(name, F.lit(1.5))
    reasons = spark.createDataFrame(
        [("none.csv", (3, "", -1, 0), 'the "last"'), ("none.csv", (1, "", -1, 0), "first"),
         ("lost.csv", (1, "", -1, 0), "no such document")],
        "doc_id string, place struct<rank:int,sort_text:string,line_pos:bigint,step:int>, reason string")
    out = tmp_path / "out"
    listed = {r.doc_id: r for r in write_result_files(docs, lines, reasons, str(out)).collect()}
    read = {d: json.loads(open(r.path, encoding="utf8").read()) for d, r in listed.items()}
    assert set(read) == {d for d, _ in heads} and len({r.path for r in listed.values()}) == 4
    assert listed["big.csv"].path.endswith("/big_result.json")
    assert read["big.csv"]["document_number"] == 'x"y\nü'
    assert [i["raw_description"] for i in read["big.csv"]["items"]] == [f'"{i}' for i in range(5000)]
    assert read["none.csv"]["review_reasons"] == ["first", 'the "last"']
    assert read["none.csv"]["items"] == [] and listed["in/a.csv"].n_items == 1
    assert all(list(r) == [f.name for f in RESULT.fields] for r in read.values())
    failing = lines.withColumn("raw_description", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        write_result_files(docs, failing, reasons, str(tmp_path / "failed"))
    assert not list((tmp_path / "failed").glob("*.json"))
