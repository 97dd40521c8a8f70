"""Text cleaning, field extraction and line predicates as Column expressions."""

import sys
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions.numbers import lenient_number

# All characters that str.strip() and str.split() take as blank.
BLANKS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
# Footer words that hold no other one; none is a pattern.
_FOOTER_PARTS = [w for w in K.FOOTER_WORDS if not any(o in w for o in K.FOOTER_WORDS if o != w)]


def constant_array(values: list[str]) -> Column:
    """Array literal; one call instead of one per value (the texts hold no quotes)."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def fold(value: Column) -> Column:
    return F.lower(strip(value))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def tokens(value: Column) -> Column:
    """Distinct blank-separated tokens."""
    spaced = F.translate(value, BLANKS, " " * len(BLANKS))
    return F.array_distinct(F.filter(F.split(spaced, " "), lambda t: t != ""))


#: First letters of the labels that a pattern can begin with.
_STARTS = {K.DOCUMENT_NUMBER: "PIO", K.TAX: "TVH", K.SHIPPING: "SFHE", K.TOTAL: "TOG",
           K.COUNTERPARTY: "CSVBIF"}


def labelled(pattern: str) -> str:
    """The pattern with its flags; its labels are only tried where one of their letters stands."""
    letters = _STARTS.get(pattern)
    return K.FLAGS + (f"(?=[{letters}])" if letters else "") + pattern


def first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without one (the groups used here are never empty)."""
    return blank_to_null(F.regexp_extract(text, labelled(pattern), 1))


# --- predicates ----------------------------------------------------------------

def is_footer(value: Column, words=None) -> Column:
    if words:
        return fold(value).rlike("|".join(words))
    low = F.lower(value)
    return reduce(or_, [low.contains(w) for w in _FOOTER_PARTS])


def is_own_company(value: Column, patterns=None) -> Column:
    return value.rlike(K.FLAGS + "(?:" + "|".join(patterns or K.OWN_COMPANY_PATTERNS) + ")")


def is_email(value: Column) -> Column:
    # Most lines hold no sign of an address and need no search.
    return value.contains("@") & value.rlike(K.FLAGS + K.EMAIL)


def is_address(value: Column) -> Column:
    """In plain ASCII the words are looked for as they stand; the flags only matter beyond it."""
    low, parts = F.lower(value), K.ADDRESS.split("|")
    plain = reduce(or_, [low.contains(p) if p.isalpha() else value.rlike(p) for p in parts])
    return F.when(F.octet_length(value) == F.length(value), plain).otherwise(
        value.rlike(K.FLAGS + K.ADDRESS))


def is_junk(value: Column) -> Column:
    return fold(value).isin(K.JUNK_DESCRIPTIONS)


def is_valid_line(description: Column, quantity: Column, price: Column, total: Column) -> Column:
    return (
        (strip(description) != "")
        & ((quantity > 0) | (price > 0) | (total > 0))
        & ~is_junk(description)
        & ~is_email(description)
        & ~is_address(description)
    )


# --- header fields ---------------------------------------------------------------

def document_number(text: Column) -> Column:
    return first_group(text, K.DOCUMENT_NUMBER)


def amount(text: Column, pattern: str) -> Column:
    # The array holds the match, so the search runs once although the parser reads it twice.
    found = F.filter(F.array(first_group(text, pattern)), lambda m: m.isNotNull())
    return F.get(F.transform(found, lambda m: lenient_number(m)), F.lit(0))


def tax_amount(text: Column) -> Column:
    return amount(text, K.TAX)


def shipping_amount(text: Column) -> Column:
    return amount(text, K.SHIPPING)


def total_amount(text: Column) -> Column:
    return amount(text, K.TOTAL)


def counterparty(text: Column, unquote: bool, own=None) -> Column:
    """First labelled counterparty that is not our own company."""
    def clean(candidate: Column) -> Column:
        if unquote:
            return strip(F.regexp_replace(strip(candidate), "^['\"]|['\"]$", ""))
        return strip(candidate)

    found = F.regexp_extract_all(text, F.lit(labelled(K.COUNTERPARTY)), F.lit(1))
    outside = F.filter(F.transform(found, clean),
                       lambda c: (c != "") & ~is_own_company(c, own))
    return F.get(outside, F.lit(0))


def letterhead(text: Column, own=None) -> Column:
    """First of the leading lines that can be a company name."""
    lines = F.slice(text_lines(text), 1, K.LETTERHEAD_LINES)
    fitting = F.filter(lines, lambda line: ~F.lower(line).isin(K.LETTERHEAD_TITLES)
                       & ~is_own_company(line, own)
                       & (F.length(line) > K.LETTERHEAD_MIN_CHARS))
    return F.get(fitting, F.lit(0))


def or_unknown(name: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.lit(K.UNKNOWN_COUNTERPARTY))


def clean_counterparty(raw: Column) -> Column:
    """Name without recipient block, role words, line breaks and surrounding punctuation."""
    labels = "|".join(m.rstrip(":") for m in K.RECIPIENT_MARKERS)
    name = F.get(F.split(raw, f"(?i)(?:{labels}):", 2), F.lit(0))
    name = F.regexp_replace(name, "(?i)(?:supplier|vendor):?", "")
    name = strip(F.regexp_replace(name, r"[\r\n]+", " "))
    return strip(F.btrim(name, F.lit(", \"'")))


# --- lines of running text -------------------------------------------------------

def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def _once(value: Column, use) -> Column:
    """use(value), with a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_table_heading(line: Column) -> Column:
    low = F.lower(line)
    return (low.contains("item") | low.contains("description")) & low.contains("qty")


def section_lines(text: Column) -> Column:
    """Lines between the first table heading and the first footer line after it.

    Later headings are skipped and never end the section. All arrays belong to one row, so no
    shuffle is needed, and each is built once.
    """
    def cut(body):
        end = F.array_position(F.transform(body, lambda x: is_footer(x)), F.lit(True)).cast("int")
        return _once(end, lambda end: F.when(end > 0, F.slice(body, F.lit(1), end - 1))
                     .otherwise(body))

    def below(lines):
        start = F.array_position(F.transform(lines, is_table_heading), F.lit(True)).cast("int")
        after = _once(start, lambda start: F.when(
            start > 0, F.slice(lines, start + 1, F.size(lines))))
        return _once(F.filter(after, lambda line: ~is_table_heading(line)), cut)
    return _once(text_lines(text), below)
