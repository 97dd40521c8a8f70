"""Documents that no deterministic extractor could read go through a caller-supplied function.

The function takes the text of one document (or of one part of a large document) and returns the
JSON text of a `schemas.RESULT` object. It runs inside tasks; an exception concerns its document
only and is reported in the rejects.
"""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import constants as K
from ledgerline.functions.text import strip
from ledgerline.operators.lineage import written
from ledgerline.operators.positions import number_rows
from ledgerline.schemas import RESULT

_UNREAD = "_unread"
_ANSWER = "key string, reply string, error string"


def _is_object(reply) -> bool:
    try:
        return isinstance(json.loads(reply), dict)
    except (TypeError, ValueError):
        return False


def _calling(extract: Callable[[str], str], attempts: int):
    def answer(text: str) -> tuple[str | None, str | None]:
        for left in range(attempts - 1, -1, -1):
            try:
                reply = extract(text)
                if _is_object(reply) or not left:
                    return reply, None
            except Exception as problem:  # one document must not stop the others
                if not left:
                    return None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [answer(text) for text in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "reply": [r for r, _ in found],
                                "error": [e for _, e in found]})
    return run


def _answers(texts: DataFrame, extract: Callable[[str], str], ledger: str | None,
             attempts: int) -> DataFrame:
    """texts(key, text) -> (key, reply, error), one row for each distinct text.

    Replies in the ledger are taken from there. The others are asked for, in one job whose result
    is written before anything reads it, and those that are JSON objects are added to the ledger.
    """
    wanted = texts.groupBy("key").agg(F.first("text").alias("text"))
    spark, known = texts.sparkSession, None
    if ledger is not None:
        try:
            known = spark.read.schema("key string, reply string").parquet(ledger)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    if known is not None:
        known = written(known.dropDuplicates(["key"]))
        wanted = wanted.join(known.select("key"), "key", "left_anti")
    fresh = written(wanted.mapInPandas(_calling(extract, attempts), _ANSWER))
    if ledger is not None:
        fresh.filter(F.col("error").isNull() & F.col("reply").rlike(r"^\s*\{")).select(
            "key", "reply").write.mode("append").parquet(ledger)
    if known is None:
        return fresh
    return fresh.unionByName(known.withColumn("error", F.lit(None).cast("string")))


def fallback_replies(texts: DataFrame, extract: Callable[[str], str], ledger: str | None = None,
                     attempts: int = K.FALLBACK_ATTEMPTS) -> DataFrame:
    """texts(doc_id, part, text) -> (doc_id, part, result, error); blank texts are not sent.

    Equal texts are sent once. The function is called up to `attempts` times while it fails or its
    reply is no JSON object. ledger: a folder that keeps replies by the hash of their text from
    run to run, so that a rerun asks only for what has no reply yet.
    """
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    guarded = texts.filter(blank).select(
        "doc_id", F.col("part").cast("bigint").alias("part"), F.from_json(
            F.lit('{"customer_raw": "%s", "items": [], "review_reasons": ["%s"]}'
                  % (K.UNKNOWN_COUNTERPARTY, K.EMPTY_TEXT_REASON)), RESULT).alias("result"),
        F.lit(None).cast("string").alias("error"))
    asked = texts.filter(~blank).withColumn("key", F.sha2("text", 256))
    replies = asked.select("doc_id", F.col("part").cast("bigint").alias("part"), "key").join(
        _answers(asked.select("key", "text"), extract, ledger, attempts), "key")
    # Strict: text that is no JSON, or a value of the wrong type, makes the whole reply unread.
    schema = T.StructType([*RESULT.fields, T.StructField(_UNREAD, T.StringType())])
    parsed = replies.withColumn("parsed", F.from_json(
        "reply", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _UNREAD}))
    kind = F.col("parsed.document_type")
    readable = (F.col("parsed").isNotNull() & F.col(f"parsed.{_UNREAD}").isNull()
                & F.coalesce(kind.isin(K.DOCUMENT_TYPES), F.lit(True)))
    answered = parsed.select(
        "doc_id", "part", F.when(readable, F.col("parsed").dropFields(_UNREAD)).alias("result"),
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~readable, F.lit("reply does not fit the result schema")).alias("error"))
    return guarded.unionByName(answered)


def fallback_extract(texts: DataFrame, extract: Callable[[str], str], ledger: str | None = None,
                     attempts: int = K.FALLBACK_ATTEMPTS):
    """-> (docs, lines, rejects(doc_id, error)); see `fallback_replies`.

    Of a document in several parts, each header field is the first one that a part has, and one
    failed part rejects the whole document, with the first error.
    """
    replies = written(fallback_replies(texts, extract, ledger, attempts))
    failed = F.when(F.col("error").isNotNull(), F.col("part"))
    rejects = (replies.groupBy("doc_id").agg(F.min_by("error", failed).alias("error"))
               .filter(F.col("error").isNotNull()))
    read = replies.join(rejects.select("doc_id"), "doc_id", "left_anti")
    head = ["document_number", "document_type", "customer_raw", "tax_amount", "shipping_amount",
            "total_amount"]
    docs = (read.groupBy("doc_id").agg(*[
        F.min_by("result." + c, F.when(F.col("result." + c).isNotNull(), F.col("part"))).alias(c)
        for c in head]).withColumn("document_type", F.coalesce("document_type", F.lit("unknown"))))
    items = (read.select("doc_id", "part", F.posexplode("result.items").alias("pos", "x"))
             .select("doc_id", "part", "pos", "x.item_number", "x.isbn", "x.raw_description",
                     "x.title", "x.author", "x.quantity", "x.unit_price", "x.total_price"))
    lines = number_rows(items, "doc_id", ["part", "pos"], [F.col("part")], "line_pos")\
        .drop("part", "pos")
    return docs, lines, rejects
