"""Steps that are compiled, read once or skipped, with their results."""

from pyspark.sql import functions as F

from ledgerline.functions.numbers import lenient_number
from ledgerline.operators import tables, textdoc, validation


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_reasons_are_compiled(spark):
    # inside a function of arrays Spark interprets the texts of the reasons.
    lines = spark.createDataFrame(
        [("a", 0, "rod", None, 2.0, 3.0, 9.0, 0.5), ("a", 1, "nut", "t", 1.0, 3.0, 3.0, 0.9)],
        "doc_id string, line_pos long, raw_description string, title string, quantity double, "
        "unit_price double, total_price double, match_confidence double")
    found = validation.line_reasons(validation.fill_line_totals(lines))
    assert "lambda" not in _plan(found)
    assert sorted((r.doc_id, r.line_pos, r["rank"], r.step, r.reason) for r in found.collect()) == [
        ("a", 0, 0, 0, "Line item 1 (rod): total mismatch. Expected 6.00, got 9.00"),
        ("a", 0, 4, 1, "Item 0 ('rod'): Math inconsistency (2.0 * 3.0 = 6.0, but document has 9.0)."),
        ("a", 0, 4, 2, "Item 'rod': Low match confidence (0.50).")]


def test_text_lines_are_rows_when_parsed_and_keep_their_numbers(spark):
    # two texts of one key each number their own lines, rejected lines do not count.
    body = "Item Description Qty Price Total\nred rod 2 1.50 3.00\nMain Street 12 1 1 1\n| nut | 1 | 2 | 2 |\nTax: 1"
    texts = spark.createDataFrame([("a", body), ("a", body), (None, body), ("b", "none")],
                                  "doc_id string, text string")
    items = textdoc.text_items(texts)
    assert "Window" not in _plan(items)
    assert sorted((r.doc_id or "", r.line_pos, r.raw_description, r.total_price)
                  for r in items.collect()) == sorted(
        [(key, pos, name, total) for key in ("a", "a", "")
         for pos, name, total in ((0, "red rod", 3.0), (1, "nut", 2.0))])
    # The number patterns of a line are searched once, not for each mention in the filter.
    assert _plan(items).count("regexp_replace(line") == 1


def test_texts_of_documents_with_table_lines_are_not_read(spark):
    # F7, F3
    tabled = spark.createDataFrame([("a", 0)], "doc_id string, line_pos long")
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    seen = []

    def read(open_):
        seen.extend(r.doc_id for r in open_.collect())
        return open_.selectExpr("doc_id", "0L as line_pos")
    lines = textdoc.with_text_fallback(tabled, texts, read)
    assert seen == ["b"] and sorted(r.doc_id for r in lines.collect()) == ["a", "b"]


def test_tables_are_read_once(spark):
    # headings and rows both come from the written tables.
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(cell):
        reads.add(1)
        return cell
    cells = [["Description", "Qty", "Price", "Total"], ["rod", "2", "1.5", "3"], ["", "", "", ""],
             ["Total", "", "", "3"], ["nut", "1", "1", "1"]]
    frame = spark.createDataFrame([("a", 0, 0, i, *row) for i, row in enumerate(cells)],
                                  "doc_id string, page long, table_idx int, row_idx long, "
                                  "a string, b string, c string, d string")
    frame = frame.select("doc_id", "page", "table_idx", "row_idx",
                         F.array(counted("a"), "b", "c", "d").alias("cells"))
    found = tables.table_lines(frame).collect()
    assert [(r.line_pos, r.raw_description, r.total_price) for r in found] == [(0, "rod", 3.0)]
    assert reads.value == len(cells)


def test_number_texts_without_a_digit(spark):
    rows = spark.createDataFrame([("",), ("-",), ("n/a",), (None,), ("٣",), ("€ 1,5",), ("1e3",), ("\n",)],
                                 "t string")
    found = rows.select(lenient_number(F.col("t")).alias("x"))
    assert [r.x for r in found.collect()] == [0.0, 0.0, 0.0, 0.0, 3.0, 1.5, 13.0, 0.0]
    assert "x7F" in _plan(found)
