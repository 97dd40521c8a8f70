import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions.scoring import partial_score, token_set_score, with_field_scores
from ledgerline.operators import fields, grid, headings, matching, positions, tables, textdoc
from ledgerline.operators.fallback import fallback_extract
from ledgerline.plans import pipeline
from ledgerline.sources import documents, masters, sinks

INVOICE = """Kestrel Tools Ltd,,,,
,,,,
Invoice No.,INV-204,,Due,14 days
Sold by:,Kestrel Tools Ltd,,,
SKU,Product,Pieces,Rate,Line Total
KT-7,Torque wrench,4,31.00,124.00
KT-9,Bench vice,1,88.50,88.50
KT-2,"Chalk line, blue",10,2.15,21.50
Subtotal,,,,234.00
Freight,,,,9.00
Grand Total,,,,243.00
"""


def grid_rows(spark, *grids):
    rows = [(f"d{d}", i, row) for d, g in enumerate(grids) for i, row in enumerate(g)]
    return grid.clean_rows(spark.createDataFrame(
        rows, "doc_id string, row_idx long, cells array<string>"))


def items(lines):
    return [tuple(r)[2:] for r in lines.orderBy("doc_id", "line_pos").select(
        "doc_id", "line_pos", "item_number", "raw_description", "quantity", "unit_price",
        "total_price").collect()]


def test_invoice_end_to_end(spark, tmp_path):
    (tmp_path / "invoice.csv").write_text(INVOICE)
    read = pipeline.extract_spreadsheets(documents.read_csv_grids(spark, str(tmp_path)))
    head = read.docs.first()
    assert (head.document_number, head.customer_raw) == ("INV-204", "Kestrel Tools Ltd")
    assert (head.tax_amount, head.shipping_amount, head.total_amount) == (None, 9.0, 243.0)
    assert items(read.lines) == [
        ("KT-7", "Torque wrench", 4.0, 31.0, 124.0), ("KT-9", "Bench vice", 1.0, 88.5, 88.5),
        ("KT-2", "Chalk line, blue", 10.0, 2.15, 21.5)]
    sellers = spark.createDataFrame([(0, "S-1", "Kestrel Tools Ltd")],
                                    f"row_pos long, `{K.CUSTOMER_KEY}` string, `Legal name` string")
    tools = spark.createDataFrame(
        [(i, f"T-{n}", f"KT-{n}", d) for i, (n, d) in enumerate(
            [(2, "Chalk line"), (7, "Wrench"), (9, "Vice")])],
        f"row_pos long, `{K.ITEM_KEY}` string, `Source item no.` string, Description string")
    docs, lines, rejects = pipeline.combine([read])
    results, reasons = pipeline.process(docs, lines, sellers, tools)
    sinks.write_json(results, str(tmp_path / "json"))
    sinks.write_routed(results, str(tmp_path / "routed"))
    out = json.loads(next((tmp_path / "json").glob("part*.json")).read_text())
    assert out["customer_id"] == "S-1" and out["tax_amount"] is None
    assert [i["item_number"] for i in out["items"]] == ["T-7", "T-9", "T-2"]
    assert out["needs_review"] is False and out["review_reasons"] == []
    assert (tmp_path / "routed" / "needs_review=false").exists()
    assert reasons.count() == 0 and rejects.count() == 0


def test_csv_rows_of_any_width(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,,9\n\n5\n")
    (tmp_path / "b.csv").write_text(",".join(map(str, range(100))) + "\n")
    (tmp_path / "c.csv").write_text('"a\nb","c\nd","e\nf",' + ",".join("x" * 12) + "\n")
    found = {r.doc_id.rsplit("/", 1)[1]: [] for r in documents.read_csv_grids(
        spark, str(tmp_path)).collect()}
    for r in documents.read_csv_grids(spark, str(tmp_path)).orderBy("row_idx").collect():
        found[r.doc_id.rsplit("/", 1)[1]].append(r.cells)
    assert found["a.csv"] == [["1", "2", None, "9"], ["5", None, None, None]]
    assert found["b.csv"] == [[str(i) for i in range(100)]]
    assert [c for c in found["c.csv"][0] if c] == ["a\nb", "c\nd", "e\nf", *"x" * 12]


def test_rows_wider_than_each_of_their_lines(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",".join(['"p\nq"'] * 40) + "\n")
    [row] = documents.read_csv_grids(spark, str(tmp_path)).collect()
    assert [c for c in row.cells if c] == ["p\nq"] * 40


def test_commas_in_quotes_are_no_columns(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        'SKU,Description,Qty,Customer:\n1,"bolt, steel, long, M4",2,ACME\n')
    rows = documents.read_csv_grids(spark, str(tmp_path))
    assert [r.cells for r in rows.orderBy("row_idx").collect()] == [
        ["SKU", "Description", "Qty", "Customer:"], ["1", "bolt, steel, long, M4", "2", "ACME"]]
    read = pipeline.extract_spreadsheets(rows)
    assert read.docs.first().customer_raw == "1"
    assert not any("Unnamed" in (c or "") for r in grid.clean_rows(rows).collect()
                   for c in r.cells)


@pytest.mark.parametrize("size", [700, 3000, 1 << 20])
def test_csv_blocks(spark, tmp_path, size):
    """Files cut into blocks of any size give the rows of the csv module over the whole file."""
    rng = random.Random(size)
    expected = {}
    for i in range(12):
        pool = ['"a\nb"', '""', ",", ",", "\n", "\n", "x y", " ", "é", "\r\n", '"p, ""q"""', 'r"s']
        text = "".join(rng.choice(pool + ['"'] * (i % 3)) for _ in range(rng.choice([0, 5, 3000])))
        if i == 7:
            text = '"' + "long cell, " * 400 + '",end\nlast,row'
        if i == 8:
            text = "\ufeffname,\rother\r" * 300
        text += '"' * (i % 3 and text.count('"') % 2)
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
        body = text.removeprefix("\ufeff")
        lines = io.StringIO(body, newline="").readlines()
        reader, at, rows = csv.reader(io.StringIO(body, newline="")), 0, []
        for row in reader:
            begin, at = lines[at], reader.line_num
            if len(row) > 1 or row and begin.strip():
                rows.append([c or None for c in row])
        width = max(map(len, rows), default=0)
        expected[f"{i}.csv"] = [r + [None] * (width - len(r)) for r in rows]
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)
        found = documents.read_csv_grids(spark, str(tmp_path)).collect()
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    for name, rows in expected.items():
        mine = sorted((r.row_idx, r.cells) for r in found if r.doc_id.endswith(f"/{name}"))
        assert [i for i, _ in mine] == list(range(len(rows)))
        cells = [c for _, c in mine]
        # A cell that is never closed ends without the last line break of its file.
        if cells != rows:
            assert cells[:-1] == rows[:-1]
            assert [(c or "").rstrip("\n") for c in cells[-1]] \
                == [(c or "").rstrip("\n") for c in rows[-1]]


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, folder)
    docs = spark.createDataFrame([("a", True), ("b", False)], "doc_id string, needs_review boolean")
    reasons = spark.createDataFrame([("a", (1, "", 0, 0), "why")], "doc_id string, place struct<"
                                    "rank:int,sort_text:string,line_pos:bigint,step:int>, reason string")
    assert sinks.publish_routed(docs, reasons, folder) == 1
    broken = docs.withColumn("doc_id", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(folder, approved=docs, review=broken)
    assert [r.doc_id for r in sinks.published(spark, folder)["review"].collect()] == ["a"]
    assert sinks.publish_routed(docs.limit(0), reasons.limit(0), folder) == 2
    assert all(t.count() == 0 for t in sinks.published(spark, folder).values())


HEAD = ["SKU", "Description", "Qty", "Price", "Total"]


def test_grid_details(spark):
    rows = grid_rows(
        spark,
        # null description kept as "", missing total derived, private is a footer word
        [HEAD, ["a", None, "2", "1.5", None], ["", "x", "1", "1", "1"], ["c", "private", "1", "1", "1"],
         ["d", "after", "1", "1", "1"]],
        # no description column: nothing passes
        [["Qty", "Price"], ["1", "2"]],
        # header only
        [HEAD],
        # a mapped column name twice below the first row: undecided
        [["x", None, None], ["Description", "Amount", "Amount"], ["y", "1", "2"]],
        # the same in the column names gets a suffix and stays readable
        [["Description", "Amount", "Amount"], ["y", "1", "2"]],
        # names that differ by a blank are two columns
        [["Description", "Qty", "Price", "Amount", "Amount "], ["z", "2", "3", "", "6"]])
    assert items(grid.grid_lines(rows)) == [
        ("a", "", 2.0, 1.5, 3.0), (None, "x", 1.0, 1.0, 1.0), (None, "y", 1.0, 0.0, 2.0),
        (None, "z", 2.0, 3.0, 6.0)]
    found = {r.doc_id: r for r in grid.header_rows(rows).collect()}
    assert found["d3"].ambiguous and not found["d4"].ambiguous


def test_existing_header_wins_ties(spark):
    rows = grid_rows(spark, [["Qty", "Price"], ["Quantity", "Rate"]],
                     [["a", "b", "c"], ["Qty", "Price", None], ["Qty", "Price", "Name"]])
    assert {r.doc_id: r.header_row for r in grid.header_rows(rows).collect()} == \
        {"d0": 0, "d1": 2}


def best_by_hand(cells):
    used, out = set(), []
    for cell in cells:
        scores = [(max(token_set_score(cell, a) for a in aliases), -i)
                  for i, (f, aliases) in enumerate(K.COLUMN_ALIASES.items()) if f not in used]
        score, place = max(scores, default=(0, 0))
        field = -place if score >= 80 else -1
        used |= {K.FIELDS[field]} if field >= 0 else set()
        out.append(field)
    return out


def first_by_hand(cells):
    used, out = [], []
    for cell in cells:
        fits = [i for i, aliases in enumerate(K.COLUMN_ALIASES.values()) if i not in used
                and max(partial_score(cell, a) for a in aliases) >= 80]
        used += fits[:1]
        out.append(fits[0] if fits else -1)
    return out


def test_heading_mappings(spark):
    rng = random.Random(8)
    words = [a for group in K.COLUMN_ALIASES.values() for a in group] + ["title", "no", "isbn", "x"]
    rows = [[rng.choice(words) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    rows += [["item description"], ["price"], ["title"], ["amount", "amount"]]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<string>")
    for score, mapping, by_hand in [
            (token_set_score, headings.best_field_mapping, best_by_hand),
            (partial_score, headings.first_field_mapping, first_by_hand)]:
        out = with_field_scores(frame, "c", score).select("c", mapping(F.col("scores")).alias("m"))
        for r in out.collect():
            assert r.m == by_hand(r.c), r.c


def test_long_grids_are_read_in_parts(spark):
    body = [["y", "1", "2"]] * 30
    rows = grid_rows(spark, [["Note", None, None]] + [["z", None, None]] * 9
                     + [["Supplier:", None, None], ["Acme", None, None]]
                     + [["Description", "Qty", "Price"]] + body + [["Tax:", "7", None]])
    whole = fields.header_fields(fields.joined_texts(rows)).first()
    parts = fields.joined_texts(rows, part_rows=11)
    assert parts.count() == 4
    assert fields.header_fields(parts).first() == whole
    assert whole.customer_raw == "Acme" and whole.tax_amount == 7.0


def test_header_fields_do_not_depend_on_parts(spark):
    cells = ["memo", "note", "left", "INVOICE NUMBER", "X-1", "\U0001d54f", "VAT due:", "?",
             "VAT due: 4", "Total", "12.50", "Order no. 9"]
    rows = grid_rows(spark, [[c] for c in cells])
    expected = fields.header_fields(fields.joined_texts(rows)).first()
    assert (expected.document_number, expected.total_amount) == ("X-1", 12.5)
    for n in range(1, len(cells) + 1):
        assert fields.header_fields(fields.joined_texts(rows, part_rows=n)).first() == expected


def test_labels_meet_values_over_any_distance(spark):
    cells = ["Head", "", "Ltd", "From", "", "", "", "Small Book Store vendor", "Late; x", "Shipping",
             "by", "land", "(", "air", ")", "9.50", "PURCHASE", "", "", "", "ORDER", "", "#", "", "No.",
             "", "P-7", "Tax", "", "", ":", "", "", "4", "Bill", "", "", "", "to", "", "Acme, Inc", "x-y"]
    rows = spark.createDataFrame([("d", i, [c]) for i, c in enumerate(cells)],
                                 "doc_id string, row_idx long, cells array<string>")
    whole = spark.createDataFrame([("d", "\n".join(cells))], "doc_id string, text string")
    expected = fields.text_header_fields(whole).first()
    assert (expected.document_number, expected.customer_raw) == ("P-7", "Acme")
    assert (expected.tax_amount, expected.shipping_amount) == (4.0, 9.5)
    for n in [1, 2, 3, 4, 5, 7, 11, 20, len(cells)]:
        texts = fields.joined_texts(rows, part_rows=n)
        assert fields.header_fields(texts, True, True).first() == expected, n
        assert fields.whole_texts(texts).first().text == "\n".join(cells)
    bare = spark.createDataFrame([("d", i, [c]) for i, c in enumerate(["invoice", "po", "", "order", "Ab", "Name"])],
                                 "doc_id string, row_idx long, cells array<string>")
    assert {fields.header_fields(fields.joined_texts(bare, part_rows=n), True, True).first().customer_raw
            for n in range(1, 7)} == {"Name"}


TEXT = ("Acme\nINVOICE #: 5\nItem Qty\n| Book one | 2 | 1.00 | 2.00 |\nBook two 3 1.50 4.50\n"
        "a@b.de 1 1 1\nno numbers\n| short | 1 |\nItem qty again\nBook three 1 1 1\nSubtotal 7\n"
        "Late book 1 1 1")


def test_text_lines(spark):
    texts = spark.createDataFrame([("d", TEXT), ("e", "nothing")], "doc_id string, text string")
    expected = [(None, "Book one", 2.0, 1.0, 2.0), (None, "Book two", 3.0, 1.5, 4.5),
                (None, "Book three", 1.0, 1.0, 1.0)]
    assert items(textdoc.text_items(texts)) == expected
    for size in (1, 2, 3, 5, 20):
        lines = TEXT.split("\n")
        pages = [("d", i, "\n".join(lines[i * size:(i + 1) * size]))
                 for i in range(-(-len(lines) // size))]
        frame = spark.createDataFrame(pages, "doc_id string, page long, text string")
        assert items(textdoc.page_items(frame)) == expected


def test_tables_with_text_fallback(spark):
    head = ["SKU", "Description", "Qty", "Unit Price", "Total"]
    rows = [("a", 0, 0, 0, head), ("a", 0, 0, 1, ["s1", "one", "1", "2", "2"]),
            ("a", 0, 0, 2, ["", "Total", "", "", "2"]), ("a", 0, 0, 3, ["s", "cut", "1", "1", "1"]),
            ("a", 1, 0, 0, head), ("a", 1, 0, 1, [None] * 5), ("a", 1, 0, 2, [None, "two", "1", "3", "3"]),
            ("b", 0, 0, 0, head)]
    frame = spark.createDataFrame(
        rows, "doc_id string, page long, table_idx int, row_idx long, cells array<string>")
    texts = spark.createDataFrame([("a", TEXT), ("b", TEXT)], "doc_id string, text string")
    lines = textdoc.with_text_fallback(tables.table_lines(frame), textdoc.text_items(texts))
    assert [i[1] for i in items(lines)] == ["one", "two", "Book one", "Book two", "Book three"]
    assert items(lines)[:2] == [("s1", "one", 1.0, 2.0, 2.0), (None, "two", 1.0, 3.0, 3.0)]


def test_positions(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aab"), rng.randint(0, 300), rng.randint(0, 2)) for _ in range(1000)]
    frame = spark.createDataFrame(rows, "k string, v int, w int")
    out = positions.number_copies(frame, "k", ["v", "w"], "p").collect()
    for key in "ab":
        mine = sorted((r.p, r.v, r.w) for r in out if r.k == key)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted((v, w) for k, v, w in rows if k == key)
    unique = frame.distinct()
    plain = positions.number_rows(unique, "k", ["v", "w"], [F.floor(F.col("v") / 50)], "p")
    mine = sorted((r.p, r.v, r.w) for r in plain.collect() if r.k == "a")
    assert [m[1:] for m in mine] == sorted({(v, w) for k, v, w in rows if k == "a"})
    assert [m[0] for m in mine] == list(range(len(mine)))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ranks_of_a_key_over_many_parts(spark, parts):
    """One key with most rows, null keys and null order, in any number of range parts."""
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(50)]), i)
            for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, v int, w int").repartition(5)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions",
                                             "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        out = positions.rank_rows(frame, "k", ["v", "w"], "p").collect()
        summed = positions.rank_rows(frame, "k", ["v", "w"], "p", "w").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for key in ("a", "b", None):
        order = sorted(((v, w) for k, v, w in rows if k == key),
                       key=lambda r: (r[0] is not None, r))
        assert [(r.v, r.w) for r in sorted((r for r in out if r.k == key), key=lambda r: r.p)] \
            == order
        assert sorted(r.p for r in out if r.k == key) == list(range(len(order)))
        sums = {r.w: r.p for r in summed if r.k == key}
        assert [sums[w] for _, w in order] == [sum(w for _, w in order[:i])
                                               for i in range(len(order))]
    empty = positions.rank_rows(frame.limit(0), "k", ["v", "w"], "p")
    assert empty.columns == ["k", "v", "w", "p"] and empty.count() == 0


def answering():
    """Local, so that it travels to the workers by value."""
    def answer(text):
        if "boom" in text:
            raise RuntimeError("no reply")
        if "wrong" in text:
            return json.dumps({"total_amount": "much"})
        if "bad" in text:
            return "not json"
        return json.dumps({"document_number": "N", "document_type": "invoice",
                           "items": [{"raw_description": text, "quantity": 1}]})
    return answer


def test_fallback(spark):
    texts = spark.createDataFrame(
        [("a", 0, "fine"), ("b", 0, "boom"), ("c", 0, " \n"), ("d", 0, "bad"), ("f", 0, "wrong"), ("e", 0, "p0"),
         ("e", 1, "p1")], "doc_id string, part int, text string")
    docs, lines, rejects = fallback_extract(texts, answering())
    heads = {r.doc_id: r for r in docs.collect()}
    assert set(heads) == {"a", "c", "e"}
    assert heads["c"].customer_raw == "UNKNOWN" and heads["c"].document_type == "unknown"
    assert [(r.doc_id, r.line_pos, r.raw_description) for r in lines.orderBy("doc_id", "line_pos")
            .collect()] == [("a", 0, "fine"), ("e", 0, "p0"), ("e", 1, "p1")]
    assert {r.doc_id: r.error for r in rejects.collect()} == {
        "b": "RuntimeError: no reply", "d": "reply does not fit the result schema", "f": "reply does not fit the result schema"}


def test_fallback_in_parts(spark):
    def answer(text):
        if text == "broken":
            raise ValueError("unreadable")
        return json.dumps({"total_amount": 9.0} if text == "last" else {"document_number": text})

    texts = spark.createDataFrame([("g", 0, "first"), ("g", 1, "last"), ("h", 0, "one"),
                                   ("h", 1, "broken"), ("h", 2, "broken")],
                                  "doc_id string, part int, text string")
    docs, _, rejects = fallback_extract(texts, answer)
    assert [(r.doc_id, r.document_number, r.total_amount) for r in docs.collect()] == [
        ("g", "first", 9.0)]
    assert [tuple(r) for r in rejects.collect()] == [("h", "ValueError: unreadable")]


def test_replies_are_kept(spark, tmp_path):
    """Equal texts are sent once, a failing call is repeated, and a rerun sends only what failed."""
    calls = str(tmp_path / "calls")

    def noting(fails):
        def answer(text, fails=fails):
            import os
            import uuid
            os.makedirs(f"{calls}/{text}", exist_ok=True)
            open(f"{calls}/{text}/{uuid.uuid4().hex}", "w").close()
            if len(os.listdir(f"{calls}/{text}")) <= fails.get(text, 0):
                raise RuntimeError("busy")
            return "[]" if text == "list" else json.dumps({"document_number": text})
        return answer

    def sent():
        return {t.name: len(list(t.iterdir())) for t in (tmp_path / "calls").iterdir()}
    texts = spark.createDataFrame(
        [(d, 0, t) for d, t in enumerate(["same"] * 20 + ["slow", "dead", "list"])],
        "doc_id string, part int, text string").repartition(4)
    ledger = str(tmp_path / "ledger")
    docs, _, rejects = fallback_extract(texts, noting({"slow": 2, "dead": 5}), ledger)
    assert sorted(r.document_number for r in docs.collect()) == ["same"] * 20 + ["slow"]
    assert {r.doc_id: r.error for r in rejects.collect()} == {
        "21": "RuntimeError: busy", "22": "reply does not fit the result schema"}
    assert sent() == {"same": 1, "slow": 3, "dead": 3, "list": 3}
    docs, _, rejects = fallback_extract(texts, noting({"dead": 5}), ledger)
    assert docs.count() == 22 and [r.doc_id for r in rejects.collect()] == ["22"]
    assert sent() == {"same": 1, "slow": 3, "dead": 6, "list": 6}


def test_images_need_the_fallback(spark):
    texts = spark.createDataFrame([("a", 0, "fine")], "doc_id string, part long, text string")
    docs, lines, rejects = pipeline.combine([pipeline.extract_images(texts)], answering())
    assert docs.first().document_number == "N" and lines.count() == 1
    docs, lines, rejects = pipeline.combine([pipeline.extract_images(texts)])
    assert docs.count() == 0 and rejects.first().doc_id == "a"


def test_pdf_route(spark):
    pages = spark.createDataFrame([("d", 0, TEXT), ("e", 0, "scan")],
                                  "doc_id string, page long, text string")
    docs, lines, rejects = pipeline.combine([pipeline.extract_pdfs(pages)], answering())
    heads = {r.doc_id: r for r in docs.collect()}
    assert (heads["d"].document_number, heads["d"].customer_raw) == ("5", "Acme")
    assert heads["e"].document_number == "N" and lines.count() == 4


def sheet(spark, rows):
    return spark.createDataFrame([("m", i, r) for i, r in enumerate(rows)],
                                 "doc_id string, row_idx long, cells array<string>")


def test_master_tables(spark):
    rows = sheet(spark, [["Depot list", None, None, None], [" Customer Master ID", "Zone", "Zone ", "Zone"],
                         ["Q-3", "007", "b", "c"], [None, "8", "x", "y"], ["Q-4", "NULL", None, "z"]])
    assert masters.find_header_row(rows, K.CUSTOMER_KEY).first().header_row == 1
    assert masters.find_header_row(rows, "elsewhere").first().header_row == 0
    master = masters.load_master(rows, K.CUSTOMER_KEY)
    # The key column is another one, so no row is dropped; repeated headings are numbered.
    assert master.columns == ["row_pos", "Customer Master ID", "Zone", "Zone.1", "Zone.1.1"]
    assert [r.Zone for r in master.collect()] == ["007", "8", None]
    stock = masters.load_item_master(sheet(spark, [
        [f"{K.ITEM_KEY} ", "EAN", "EAN"], ["B-1", "40", "41"], [None, "50", "51"]]))
    assert stock.columns == ["row_pos", K.ITEM_KEY, "EAN", "EAN.1"]
    assert [tuple(r)[1:] for r in stock.collect()] == [("B-1", "40", "41")]
    keys = {r.key for r in matching.item_keys(stock).collect()}
    assert {"b-1", "40"} <= keys


def test_files(spark, tmp_path):
    for name in ["a.csv", "b.PDF", "c.Tiff", "d.unknown", "e"]:
        (tmp_path / name).write_text("x")
    inputs, rejects = documents.route_files(documents.discover(spark, str(tmp_path)))
    assert {r.filename: r.file_type for r in inputs.collect()} == {
        "a.csv": "spreadsheet", "b.PDF": "pdf", "c.Tiff": "image"}
    assert sorted(r.error for r in rejects.collect()) == [
        "Unsupported file extension: ", "Unsupported file extension: .unknown"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        documents.discover(spark, str(tmp_path / "empty"))
