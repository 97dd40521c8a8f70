import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.operators import matching
from ledgerline.operators.nesting import nest
from ledgerline.operators.totals import document_confidence, exact_sum
from ledgerline.operators.validation import validate

DOC = ("doc_id string, document_number string, document_type string, customer_raw string, "
       "customer_matched string, customer_id string, tax_amount double, shipping_amount double, "
       "total_amount double, confidence double")
LINE = ("doc_id string, line_pos long, item_number string, isbn string, raw_description string, "
        "title string, author string, matched_description string, quantity double, "
        "unit_price double, total_price double, match_confidence double")


def run(spark, lines, number="PO-1", customer="CM-1", tax=None, shipping=None, total=None,
        confidence=1.0, part_size=None):
    docs = spark.createDataFrame([("d", number, "unknown", "x", "x", customer, tax, shipping, total,
                                   confidence)], DOC)
    frame = spark.createDataFrame(
        [("d", i, None, None, text, None, None, None, q, p, t, c)
         for i, (text, q, p, t, c) in enumerate(lines)], LINE)
    return nest(*validate(docs, frame), part_size=part_size).orderBy("part").collect()


CASES = [
    (dict(lines=[("A", 2.0, 50.0, 100.0, 1.0)], total=100.0), []),
    (dict(lines=[("A", 2.0, 56.25, 112.5, 1.0)], confidence=0.95), []),
    (dict(lines=[("Item B", 3.0, 10.0, 50.0, 1.0)], total=50.0),
     ["Line item 1 (Item B): total mismatch. Expected 30.00, got 50.00",
      "Item 0 ('Item B'): Math inconsistency (3.0 * 10.0 = 30.0, but document has 50.0)."]),
    (dict(lines=[("C", 1.0, 20.0, 20.0, 1.0)], total=100.0),
     ["Grand total mismatch: document header is 100.00, sum of line items (20.00) + tax (0.00) + "
      "shipping (0.00) is 20.00"]),
    (dict(lines=[(None, 3.0, 10.0, 50.0, 1.0)], total=50.0),
     ["Line item 1 (Unknown): total mismatch. Expected 30.00, got 50.00",
      "Item 0 ('None'): Math inconsistency (3.0 * 10.0 = 30.0, but document has 50.0)."]),
    (dict(lines=[("A", 1.0, 1.0, 1.0, 1.0)], confidence=0.65),
     ["Low overall document confidence (0.65)."]),
    (dict(lines=[], number="", customer=None, confidence=0.9),
     ["Missing mandatory document number.",
      "Customer/Supplier could not be matched to Master Data.", "No line items extracted."]),
    (dict(lines=[("B", None, 1.0, 1.0, 0.5), ("A", 0.0, 1.0, 0.0, 0.5), ("B", 1.0, 1.0, 1.0, 0.5),
                 ("", 1.0, 1.0, 1.0, 0.845)]),
     ["Item 0: Missing or invalid quantity.", "Item 'B': Low match confidence (0.50).",
      "Item 1: Missing or invalid quantity.", "Item 'A': Low match confidence (0.50)."]),
    (dict(lines=[("b", 1.0, 1.0, 2.0, 1.0), ("a", 1.0, 1.0, 1.02, 1.0)], tax=1.0, shipping=2.0,
          total=6.02),
     ["Line item 1 (b): total mismatch. Expected 1.00, got 2.00",
      "Line item 2 (a): total mismatch. Expected 1.00, got 1.02",
      "Item 0 ('b'): Math inconsistency (1.0 * 1.0 = 1.0, but document has 2.0)."]),
]


@pytest.mark.parametrize("document, reasons", CASES)
def test_rules(spark, document, reasons):
    [result] = run(spark, **document)
    assert result.review_reasons == reasons
    assert result.needs_review == bool(reasons)


def test_totals_are_filled(spark):
    [result] = run(spark, [("D", 4.0, 25.0, None, 1.0)])
    assert (result["items"][0].total_price, result.total_amount) == (100.0, 100.0)
    assert not result.needs_review


def test_tolerance_keeps_binary_noise(spark):
    one = [("A", 1.0, 100.0, 100.0, 1.0)]
    assert run(spark, one, total=100.01)[0].needs_review
    assert not run(spark, [("A", 1.0, 10.0, 10.0, 1.0)], total=10.01)[0].needs_review


def test_large_documents_continue_in_parts(spark):
    lines = [(f"L{i}", 1.0, 1.0, 1.0, 0.5 if i % 2 else 1.0) for i in range(10)]
    parts = run(spark, lines, total=10.0, part_size=4)
    assert [r.part for r in parts] == [0, 1, 2]
    assert [x.raw_description for r in parts for x in r["items"]] == [f"L{i}" for i in range(10)]
    assert [len(r.review_reasons) for r in parts] == [2, 2, 1]
    assert all(r.needs_review and r.total_amount == 10.0 for r in parts)


def test_sums_are_exact_in_any_order(spark):
    values = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16, 0.7, None]
    rows = [("d", i, v) for i, v in enumerate(values)]
    for n in (1, 4, 8):
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "doc_id string, line_pos long, v double")
            out = exact_sum(df.repartition(n), "v").first()
            assert (out.n, out.v) == (8, 2.3)


def test_sums_beyond_decimals_and_without_values(spark):
    rows = spark.createDataFrame(
        [("big", 0, 1e30), ("big", 1, 1.0), ("none", -1, None), ("tiny", 0, 1e-13),
         ("tiny", 1, 2e-13), ("third", 0, 1 / 3), ("least", 0, 5e-324), ("most", 0, 1.7e308),
         ("odd", 0, float("inf")), ("odd", 1, 1.0), ("nan", 0, float("nan"))],
        "doc_id string, line_pos long, v double")
    out = {r.doc_id: (r.n, r.v) for r in exact_sum(rows, "v").collect()}
    assert math.isnan(out.pop("nan")[1])
    assert out == {"big": (2, 1e30), "none": (0, 0.0), "tiny": (2, 3e-13), "third": (1, 1 / 3),
                   "least": (1, 5e-324), "most": (1, 1.7e308), "odd": (2, float("inf"))}


def test_sums_of_any_magnitude_do_not_depend_on_order(spark):
    rng = random.Random(4)
    values = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-20, 25) for _ in range(400)]
    values += [1e300, -1e300, 1e-13, 0.1, 0.2]
    exact = sum(map(lambda v: Fraction(repr(v)), values))
    found = set()
    for n in (1, 3, 8):
        rng.shuffle(values)
        df = spark.createDataFrame([("d", i, v) for i, v in enumerate(values)],
                                   "doc_id string, line_pos long, v double")
        found.add(exact_sum(df.repartition(n), "v").first().v)
    assert len(found) == 1 and abs(found.pop() - float(exact)) <= abs(float(exact)) * 1e-15


def test_document_confidence(spark):
    docs = spark.createDataFrame([("a", 0.8205), ("b", 1.0)],
                                 "doc_id string, customer_confidence double")
    lines = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.33)],
                                  "doc_id string, line_pos int, match_confidence double")
    out = {r.doc_id: r.confidence for r in document_confidence(docs, lines).collect()}
    assert out == {"a": round((0.8205 + 0.9 + 0.33) / 3, 4), "b": 1.0}


#: Confidence of "Nordwind Logistik" for "NordWind Logistik AG": the sorted words compare as 17
#: against 20 characters, of which one W differs in case.
NEAR_NAME = round(2 * 16 / (17 + 20), 4)
#: Of "hose garden 25 metre" for "Garden hose 25 metres": behind the common words, 20 against 21
#: characters, of which 19 agree.
NEAR_ITEM = round(2 * 19 / (20 + 21), 4)


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [(0, "V-20", "Harbour & Lane Partners"), (1, "V-21", "NordWind Logistik AG")],
        f"row_pos long, `{K.CUSTOMER_KEY}` string, `{K.CUSTOMER_NAME}` string")


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(
        [(0, "A-5", "S-500", "M-50", "Garden hose 25 metres"),
         (1, "A-6", "S-501", "M-51", "Stainless hinge for doors")],
        f"row_pos long, `{K.ITEM_KEY}` string, `Source item no.` string, "
        "`Manufacturer item no.` string, Description string")


def test_customers(spark, customers):
    names = spark.createDataFrame([("Nordwind Logistik",), (None,), ("Zq",), ("Supplier:",)],
                                  "customer_raw string")
    [found] = matching.match_customers(names, customers).collect()
    assert tuple(found) == ("Nordwind Logistik", "V-21", "NordWind Logistik AG", NEAR_NAME)
    unnamed = customers.drop(K.CUSTOMER_NAME)
    assert matching.match_customers(names, unnamed).count() == 0


def test_items(spark, parts):
    queries = spark.createDataFrame(
        [("S-500", "anything"), (None, "hose garden 25 metre"),
         ("ZZ-0", "Violin strings"), (" a-6 ", None), ("M-50", "zz")],
        "item_number string, raw_description string")
    found = {(r.item_number, r.raw_description): (r.item_id, r.match_confidence)
             for r in matching.match_items(queries, parts).collect()}
    assert found == {("S-500", "anything"): ("A-5", 1.0),
                     ("", "hose garden 25 metre"): ("A-5", NEAR_ITEM),
                     ("ZZ-0", "Violin strings"): (None, 0.0),
                     (" a-6 ", ""): ("A-6", 1.0), ("M-50", "zz"): (None, 0.0)}


def test_key_priority_and_first_row(spark):
    master = spark.createDataFrame(
        [(0, "x", "k1", "", "first"), (1, "k1", "z", "T", "second"), (2, "k1", "y", " ", "third")],
        "row_pos long, `Item ID` string, EAN string, Title string, Description string")
    keys = {r.key: (r.item_id, r.description) for r in matching.item_keys(master).collect()}
    assert keys["k1"] == ("k1", "T") and keys["y"] == ("k1", " ")


def test_write_back_keeps_unmatched_numbers(spark, parts):
    lines = spark.createDataFrame([("d", 0, "S-501", "q"), ("d", 1, "77", "nothing alike zzz")],
                                  "doc_id string, line_pos long, item_number string, raw_description string")
    out = matching.write_back(lines, matching.match_items(lines, parts)).orderBy("line_pos").collect()
    assert [(r.item_number, r.match_confidence) for r in out] == [("A-6", 1.0), ("77", 0.0)]
    assert out[1].matched_description is None


def test_repeated_values_of_one_document_stay_whole(spark, customers, parts):
    """One name and one description on every row: nothing is lost or multiplied."""
    docs = spark.range(500).select(F.concat(F.lit("d"), "id").alias("doc_id"),
                                   F.lit("Nordwind Logistik").alias("customer_raw"))
    lines = docs.select("doc_id", F.explode(F.expr("sequence(0L, 3L)")).alias("line_pos"), F.lit(None).cast("string").alias("item_number"),
                        F.lit("hose garden 25 metre").alias("raw_description"))
    out_docs, out_lines = matching.resolve(docs, lines, customers, parts)
    assert out_lines.filter("item_number = 'A-5'").count() == 2000
    assert out_docs.select("customer_id", "confidence").distinct().collect() == [
        ("V-21", round((NEAR_NAME + 4 * NEAR_ITEM) / 5, 4))]
