"""Steps that were rewritten to scale, held against the plain form of the same work."""

import random

from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions import text as T
from ledgerline.functions.scoring import partial_score, token_set_score, with_field_scores
from ledgerline.operators import fields, grid, headings, validation
from ledgerline.plans.queries import QUERIES
from ledgerline.schemas import RESULT
from ledgerline.sources.result_files import read_result_files


def heading_cells(rng, n):
    aliases = [a for names in K.COLUMN_ALIASES.values() for a in names]
    cells = [None, "", "12.50", "Unnamed: 3", "  SKU ", "Main Street 12", "QTY ", "Total (€)"]
    for _ in range(n):
        alias = list(rng.choice(aliases))
        for _ in range(rng.randint(0, 3)):
            alias[rng.randrange(len(alias))] = rng.choice("aeiot Xé€3")
        cells.append("".join(alias))
    return cells


def test_headings_are_mapped_as_by_column_functions(spark):
    rng = random.Random(11)
    cells = heading_cells(rng, 300)
    rows = [(i % 7, rng.choices(cells, k=rng.randint(0, 7))) for i in range(800)] + [(0, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                  "i int, row_idx long, cells array<string>")
    found = {r.i: r.mapping for r in headings.mapped_headings(frame, 2).collect()}
    folded = F.transform("cells", lambda c: F.when(~T.fold(c).startswith("unnamed:"), T.fold(c)))
    plain = {r.i: r.m for r in with_field_scores(
        frame.withColumn("near", folded), "near", token_set_score).select(
        "i", headings.best_field_mapping(F.col("scores")).alias("m")).collect()}
    for i, (row_idx, _) in enumerate(rows):
        mapped = sum(f >= 0 for f in plain[i] or [])
        if row_idx == 0 or mapped >= 2:
            assert found[i] == plain[i], rows[i]
    texts = frame.withColumn("texts", F.transform("cells", lambda c: F.coalesce(T.fold(c), F.lit(""))))
    first = {r.i: r.mapping for r in headings.first_mapped(texts, "texts").collect()}
    plain = {r.i: r.m for r in with_field_scores(texts, "texts", partial_score).select(
        "i", headings.first_field_mapping(F.col("scores")).alias("m")).collect()}
    assert first == plain


def test_predicates_equal_their_patterns(spark):
    rng = random.Random(12)
    pieces = ["road", "ROAD", "12345", "1234", "x12345", "_12345", " ", "ſtreet", "Avenue", "é",
              "٣٣٣٣٣", "a@b.c", "@", "ü@é.x", "tot", "Total", "TAX", "\n", "amount  due", "-"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 4))) for _ in range(1500)]
    x = F.col("x")
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    wrong = frame.filter((T.is_address(x) != x.rlike(K.FLAGS + K.ADDRESS))
                         | (T.is_email(x) != x.rlike(K.FLAGS + K.EMAIL))
                         | (T.is_footer(x) != T.is_footer(x, K.FOOTER_WORDS)))
    assert not wrong.collect()


def test_queries_keep_long_methods_compiled_in_any_session(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    try:
        QUERIES["customer_id_pick"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == "8000"
    finally:
        spark.conf.set(name, before)


def test_result_files_are_read_by_their_list(spark, tmp_path):
    (tmp_path / "_a_result.json").write_text('{"document_number": "A", "items": []}\n')
    (tmp_path / "b_result.json").write_text('{\n "document_number": "B",\n "items": [{}]}\n')
    (tmp_path / "other_result.json").write_text("{}")
    listed = spark.createDataFrame([(f"{tmp_path}/{n}_result.json",) for n in ("_a", "b", "b")],
                                   "path string")
    read = read_result_files(listed, str(tmp_path))
    assert read.schema["result"].dataType.fieldNames() == RESULT.fieldNames()
    assert sorted(read.select("file", "result.document_number", F.size("result.items")).collect()) \
        == [("_a_result.json", "A", 0), ("b_result.json", "B", 1)]


def test_section_builds_its_lines_once(spark):
    """The plan splits the text once, not again for every use of its lines."""
    frame = spark.createDataFrame([("x\nItem Qty\na\nItem qty\nb\nTotal\nc",), ("a\nTotal",), (None,)],
                                  "text string")
    plan = frame.select(T.section_lines(F.col("text")).alias("s"))
    assert sorted(plan.collect(), key=str) == [(None,), (None,), (["a", "b"],)]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(") == 1


def test_reasons_are_computed_once(spark):
    """Routing and the reasons themselves read one written table, not the lines again."""
    docs = spark.createDataFrame(
        [("a", "N", "C", 0.0, 0.0, 6.0, 0.9)],
        "doc_id string, document_number string, customer_id string, tax_amount double, "
        "shipping_amount double, total_amount double, confidence double")
    lines = spark.createDataFrame(
        [("a", 0, "x", None, 2.0, 3.0, 6.0, 0.5)],
        "doc_id string, line_pos long, raw_description string, title string, quantity double, "
        "unit_price double, total_price double, match_confidence double")
    routed, _, reasons = validation.validate(docs, lines)
    assert [r.reason for r in reasons.collect()] == ["Item 'x': Low match confidence (0.50)."]
    assert [tuple(r) for r in routed.select("doc_id", "n_reasons").collect()] == [("a", 1)]
    for frame in (routed, reasons):
        assert "Low match" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_collected_by_one_shuffle_and_one_sort(spark):
    """Rows out of cells and texts out of rows: no table of lists on both sides of the shuffle."""
    cells = [("G1", 0, 1, "b"), ("G1", 0, 0, "a"), ("G1", 2, 2, "x"), ("G2", 0, 0, None),
             (None, 0, 0, "n"), ("G1", None, 1, "k")] + [(f"H{i}", 0, 0, "h") for i in range(300)]
    cells = spark.createDataFrame(cells, "doc_id string, row_idx long, col_idx int, value string")
    rows = grid.rows_from_cells(cells)
    found = {(r.doc_id, r.row_idx): r.cells for r in rows.collect()}
    assert len(found) == 305 and found[("G1", 0)] == ["a", "b"] and found[("G2", 0)] == [None]
    assert found[("G1", 2)] == [None, None, "x"] and found[(None, 0)] == ["n"]
    assert found[("G1", None)] == [None, "k"] and found[("H7", 0)] == ["h"]
    texts = fields.joined_texts(rows, 2)
    joined = {(r.doc_id, r.part): r.text for r in texts.collect()}
    assert len(joined) == 305 and joined[("G1", 0)] == "a\nb" and joined[("G2", 0)] == ""
    assert joined[("G1", 1)] == "x" and joined[("G1", None)] == "k"
    for frame in (grid.rows_from_cells(cells), fields.joined_texts(cells.select(
            "doc_id", "row_idx", F.array("value").alias("cells")))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_cells_are_cleaned_as_one_by_one(spark):
    rng = random.Random(13)
    pool = [None, "", "nan", "N/A", "x", " ", "total", "NULL"]
    rows = [(str(i), rng.randint(0, 2), rng.choices(pool, k=rng.randint(0, 4))) for i in range(400)]
    rows.append(("none", 1, None))
    frame = spark.createDataFrame(rows, "doc_id string, row_idx long, cells array<string>")
    found = {r.doc_id: r.cells for r in grid.clean_rows(frame).filter("row_idx > 0").collect()}
    clean = {d: [None if c in K.MISSING_CELL_TEXTS else c for c in cells]
             for d, i, cells in rows if i and cells}
    assert found == {d: c for d, c in clean.items() if any(x is not None for x in c)}
