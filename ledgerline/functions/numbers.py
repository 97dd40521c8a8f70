"""Number parsing, rounding and formatting as Column expressions."""

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every decimal digit of Unicode outside ASCII, with its value.
_OTHER_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal()]
_OTHER_DIGITS_FROM = "".join(_OTHER_DIGITS)
_OTHER_DIGITS_TO = "".join(str(int(d)) for d in _OTHER_DIGITS)


def lenient_number(value: Column) -> Column:
    """Text to double; anything that is not a number becomes 0.0.

    Only digits, separators and minus signs count. With both separators present commas are
    dropped, otherwise a comma is a decimal point. A text that is a plain number already is
    converted as it stands. A plain ASCII text without a digit is none, and a failed conversion is
    dear, so such a text is not converted at all.
    """
    kept = F.regexp_replace(F.translate(value, _OTHER_DIGITS_FROM, _OTHER_DIGITS_TO),
                            r"[^0-9.,\-]", "")
    comma = F.when(kept.contains("."), F.lit("")).otherwise(F.lit("."))
    return F.coalesce(F.when(value.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"), value)
                      .when(value.rlike(r"\A[\x00-/:-\x7F]*\z"), F.lit(None))
                      .otherwise(F.replace(kept, F.lit(","), comma)).try_cast("double"), F.lit(0.0))


def round_binary(x: Column, digits: int) -> Column:
    """Round the exact binary value of a double, half to even, as Python's round() does.

    Spark's round() works on the shortest decimal text and gives 2.68 for 2.675, whose binary
    value lies below the half. The product with 10^digits is split into its rounded value and its
    exact remainder, so that the comparison with one half is exact.
    """
    scale = float(10 ** digits)
    product = x * F.lit(scale)
    spread = x * F.lit(134217729.0)  # 2^27 + 1 splits a double into two 26-bit halves
    high = spread - (spread - x)
    remainder = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    whole = F.floor(product).cast("double")
    above_half = (product - whole - F.lit(0.5)) + remainder
    rounded = F.when(above_half > 0, whole + F.lit(1.0)).when(above_half < 0, whole)\
        .otherwise(whole + F.pmod(whole, F.lit(2.0)))
    return F.when(F.abs(x) < F.lit(4.5e13), rounded / F.lit(scale)).otherwise(x)


def fixed2(x: Column) -> Column:
    """Two-decimal text of a double."""
    return F.format_string("%.2f", round_binary(x, 2))


def float_text(x: Column) -> Column:
    """Shortest text of a double in Python's form: 7.0, 10000000.0, 1e+16, 1e-05."""
    size = F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    java = x.cast("string")
    exponent = F.regexp_extract(java, r"E-?(\d+)$", 1)
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", ""),
        F.when(java.contains("E-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent))
    return F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)\
        .when((size >= 1e-4) & (size < 1e16), plain)\
        .otherwise(scientific)
