import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.functions.numbers import fixed2, float_text, lenient_number, round_binary

NUMBERS = {
    "1.234,56": 1.23456, "1,234,567": 0.0, "$1,234.56": 1234.56, "1,5": 1.5, "(12.00)": 12.0,
    "1-2": 0.0, "-5": -5.0, "abc": 0.0, None: 0.0, "": 0.0, "nan": 0.0, " 7 ": 7.0, ".5": 0.5,
    "5.": 5.0, "-": 0.0, ".": 0.0, "1.2.3": 0.0, "٣,٥": 3.5, "€ 120,00": 120.0,
}


def values(spark, rows, kind, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)],
                                                f"i int, x {kind}")
            .orderBy("i").select(expression).collect()]


def test_lenient_number(spark):
    assert values(spark, list(NUMBERS), "string", lenient_number(F.col("x"))) == \
        list(NUMBERS.values())


def plain_number(text):
    if "," in text and "." in text:
        text = text.replace(",", "")
    elif "," in text:
        text = text.replace(",", ".")
    try:
        return float("".join(c for c in text if c in "0123456789.-") or "0")
    except ValueError:
        return 0.0


def test_lenient_number_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789.,-$ x") for _ in range(rng.randint(0, 8)))
             for _ in range(2000)]
    assert values(spark, texts, "string", lenient_number(F.col("x"))) == \
        [plain_number(t) for t in texts]


def test_rounding_and_formats_follow_binary_values(spark):
    rng = random.Random(5)
    xs = [2.675, 0.125, 1.005, -2.675, 0.285, 1e7, 12345678.125, 0.0]
    xs += [rng.randint(-10**6, 10**6) / 1000 for _ in range(3000)]
    xs += [rng.uniform(-10**9, 10**9) for _ in range(1000)]
    xs += [rng.randint(0, 50) * rng.randint(0, 10**6) / 100 / 8 for _ in range(1000)]
    x = F.col("x")
    assert values(spark, xs, "double", round_binary(x, 2)) == [round(v, 2) for v in xs]
    assert values(spark, xs, "double", round_binary(x, 4)) == [round(v, 4) for v in xs]
    shown = [v for v in xs if round(v, 2) != 0]
    assert values(spark, shown, "double", fixed2(x)) == [f"{v:.2f}" for v in shown]


def test_float_text(spark):
    xs = [7.0, 1e7, 12345678.9, 1e15, 1.5e16, 1e22, 0.001, 0.00025, 1e-5, 2.5e-7, 0.0, -3.25]
    assert values(spark, xs, "double", float_text(F.col("x"))) == [str(v) for v in xs]


HEADERS = [
    ("INVOICE #: INV-7", "INV-7"), ("Purchase  Order No. 88-A", "88-A"),
    ("PO Number:\nPO-2026-701", "PO-2026-701"), ("Supported report", "rted"), ("nothing", None),
]


def test_document_number(spark):
    texts, expected = zip(*HEADERS)
    assert values(spark, texts, "string", T.document_number(F.col("x"))) == list(expected)


def test_amounts(spark):
    texts = ["VAT 20%: 18.66", "Tax (8%) 7.20", "Subtotal: 9\nGrand Total: $1,234.56",
             "Shipping & Handling:\n15.00", "subtotal 5"]
    assert values(spark, texts, "string", T.tax_amount(F.col("x"))) == \
        [18.66, 7.2, None, None, None]
    assert values(spark, texts, "string", T.total_amount(F.col("x"))) == \
        [None, None, 1234.56, None, None]
    assert values(spark, texts, "string", T.shipping_amount(F.col("x")))[3] == 15.0


def test_counterparty_and_letterhead(spark):
    texts = ["Ship To: Small Book Store, X\nSupplier: 'Acme Ltd', Y", "INVOICE\nBig Shop\nx",
             "small book store ltd\nabc\nAcme Corp"]
    x = F.col("x")
    assert values(spark, texts, "string", T.counterparty(x, True)) == ["Acme Ltd", None, None]
    assert values(spark, texts, "string", T.counterparty(x, False))[0] == "'Acme Ltd'"
    assert values(spark, texts, "string", T.letterhead(x))[1:] == ["Big Shop", "Acme Corp"]


@pytest.mark.parametrize("raw, clean", [
    ("Supplier: Acme, \"Ltd\"", "Acme, \"Ltd"), ("Acme Customer: Shop", "Acme"),
    ("Acme\r\nLtd  Ship To: Here", "Acme Ltd"), ("VENDOR Acme", "Acme"), ("Customer: x", ""),
])
def test_clean_counterparty(spark, raw, clean):
    assert values(spark, [raw], "string", T.clean_counterparty(F.col("x"))) == [clean]


def test_line_filter(spark):
    rows = ["Good book", "qty", " Unit Price ", "a@b.de", "12 Main Street", "code 12345 x", "  ",
            "Broadway Hits", "123456"]
    one, zero = F.lit(1.0), F.lit(0.0)
    assert values(spark, rows, "string", T.is_valid_line(F.col("x"), one, zero, zero)) == \
        [True, False, False, False, False, False, False, False, True]
    assert not any(values(spark, rows, "string", T.is_valid_line(F.col("x"), zero, zero, zero)))


def test_footer_words_match_inside_words(spark):
    rows = ["Sub Total", "private", "syntax", "amount due", "amounts due", "plain"]
    assert values(spark, rows, "string", T.is_footer(F.col("x"))) == \
        [True, True, True, True, False, False]


def test_section_lines(spark):
    text = "intro\nItem  Qty\n\n a 1 1 1 \nDescription qty again\nb\nTotal: 5\nItem qty\nc"
    assert values(spark, [text, "no heading\nTotal", "Item qty"], "string",
                  T.section_lines(F.col("x"))) == [["a 1 1 1", "b"], None, []]
