"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literals

#: Words of a k-gram, k-grams of a window. Texts that share K + WINDOW - 1 words in a row share a
#: fingerprint.
K, WINDOW = 4, 4
#: Prime modulus and base of the rolling hash.
PRIME, BASE = 2**31 - 1, 1_000_003
#: Bytes of text in a stretch of ids, which a window function handles apart, and the least and
#: greatest number of stretches.
STRETCH_BYTES, STRETCHES, MOST_STRETCHES = 1 << 27, 256, 1 << 13
_POSITION = 2**31
#: Hash of the mark before the first and behind the last word.
_END = 1_234_567_891
#: A letter of a script without blanks between words is a word; otherwise a run of letters is.
WORDS = (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}]"
         r"|[\p{L}\p{N}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}"
         r"\p{IsKhmer}]]+")


def _beside(values: Column, step: int, join) -> Column:
    """join(x[i], x[i + step]) for every i that has both."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(step + 1), n), join)


def _rolled(width: int):
    factor = pow(BASE, width, PRIME)
    return lambda x, y: (x * factor + y) % PRIME


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`: the winnowed fingerprints of a text as numbers
    hash * 2^31 + (2^31 - 1 - position), in order of position.

    A k-gram's hash is the polynomial of its words' hashes modulo a prime; the hashes of two words,
    then of four, come from their halves, so each step reuses what neighbours share. The least
    number of a window is the least hash and, on ties, the rightmost position; window minima come
    from two steps of halves as well. K - 1 end marks stand before the first and behind the last
    word, so the same rule holds for texts of any number of words: one of n has n windows, and
    positions count from the first mark. A text without words is one word as it stands; a null or
    empty text has no fingerprint.
    """
    step = f"__{out}_"
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0))
    df = df.withColumn(f"{step}w", words)
    df = df.withColumn(f"{step}w", F.when(F.size(f"{step}w") > 0, F.col(f"{step}w")).when(
        F.length(text) > 0, F.array(F.col(text))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{step}h", F.transform(
        f"{step}w", lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))).drop(f"{step}w")
    ends = F.array_repeat(F.lit(_END).cast("long"), K - 1)
    df = df.withColumn(f"{step}h", F.when(F.size(f"{step}h") > 0, F.concat(
        ends, f"{step}h", ends)).otherwise(F.col(f"{step}h")))
    df = df.withColumn(f"{step}g", _beside(F.col(f"{step}h"), 1, _rolled(1)))
    df = df.withColumn(f"{step}g", _beside(F.col(f"{step}g"), 2, _rolled(2)))
    df = df.withColumn(f"{step}p", F.transform(
        f"{step}g", lambda g, i: g * _POSITION + (_POSITION - 1 - i))).drop(f"{step}g")
    lesser = lambda x, y: F.least(x, y)
    df = df.withColumn(f"{step}m", _beside(F.col(f"{step}p"), 1, lesser))
    df = df.withColumn(f"{step}m", _beside(F.col(f"{step}m"), 2, lesser))
    return df.withColumn(out, F.array_distinct(f"{step}m")).drop(
        f"{step}h", f"{step}p", f"{step}m")


def hashes(marks: Column) -> Column:
    """The distinct hashes of marks, without positions."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 31)))


def printed(marks: Column) -> Column:
    """Marks as text: `hash:position` in hexadecimal, one after another."""
    return F.array_join(F.transform(marks, lambda m: F.concat(
        F.hex(F.shiftright(m, 31)), F.lit(":"), F.hex(_POSITION - 1 - m % _POSITION))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in all hashes of two sets; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `marks` (array<long>, hash and position) and `fingerprint` (text)."""
    marked = with_marks(docs.drop("marks", "fingerprint"), text, "marks")
    return marked.withColumn("fingerprint", printed(F.col("marks")))


def with_edits(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next), one for each row of docs(doc_id, text).

    The edited text of a document has its last quarter of code points (rounded down) replaced by
    as many first ones of the next document, or all it has; next by doc_id, after the last the
    first. Rows of one doc_id follow each other by text, a null doc_id comes first; a null text is
    empty. Of a single row the next is itself. An empty table gives no rows.

    Ids are cut at quantiles into stretches, each a window of its own, which also gets the first
    rows of the following stretch, so neighbours meet without sorting all rows in one task. Whole
    texts move once. There are as many stretches as the texts' bytes ask for; cuts and first ids,
    at most MOST_STRETCHES numbers each, are all the driver sees.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63))
    rows = docs.select(F.col("doc_id"), order.alias("__order"),
                       F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = min(MOST_STRETCHES, max(STRETCHES, -(-size // STRETCH_BYTES)))
    shares = [k / number for k in range(1, number)]
    cuts = rows.agg(F.percentile_approx("__order", shares, 40 * number)).first()[0]
    borders = sorted(set(cuts or []))
    stretch = F.size(F.filter(literals(borders, "bigint"), lambda b: b <= F.col("__order")))
    firsts = sorted(tuple(r) for r in rows.groupBy(stretch.alias("s")).agg(
        F.min("__order")).collect())
    # The first row of a stretch also ends the stretch before it, the very first the last.
    before = F.map_from_arrays(literals([first for _, first in firsts], "bigint"),
                               literals([firsts[i - 1][0] for i in range(len(firsts))], "int"))
    ends = F.try_element_at(before, F.col("__order"))
    own = F.struct(stretch.cast("int").alias("s"), F.lit(0).alias("ghost"))
    places = F.when(ends.isNotNull(), F.array(own, F.struct(
        ends.alias("s"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    rows = rows.withColumn("__at", F.explode(places)).select(
        "doc_id", "__order", "text", F.col("__at.s").alias("__s"),
        F.col("__at.ghost").alias("__ghost"))
    along = Window.partitionBy("__s").orderBy("__ghost", "__order", "text")
    n = F.length("text")
    rows = rows.withColumn("__next", F.lead("text").over(along)).withColumn("n_chars", n)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("__edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - quarter),
        F.coalesce(F.substring("__next", F.lit(1), quarter), F.lit(""))))
    rows = with_marks(with_marks(rows, "text", "__a"), "__edited", "__b")
    rows = rows.select(
        "doc_id", "__s", "__ghost", "__order", "text", F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"), printed(F.col("__a")).alias("fingerprint"),
        printed(F.col("__b")).alias("edited_fingerprint"), hashes(F.col("__a")).alias("__ha"),
        hashes(F.col("__b")).alias("__hb"))
    rows = rows.withColumn("__hn", F.lead("__ha").over(along)).filter("__ghost = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("__ha"), F.col("__hb")).alias("near_edited"),
                       likeness(F.col("__ha"), F.col("__hn")).alias("near_next"))
