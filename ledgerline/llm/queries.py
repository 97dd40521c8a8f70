"""The registered queries of the operators, and their DuckDB equivalents where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (align, bpe, decontaminate, fingerprints, langid, licenses, mixture, neardup, pii,
               sharding, tokens, trie, warc)
from .common import shared_folder, stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.replace(docs).select("doc_id", "text", "n_entities", "n_kinds")


def op2_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(_table(spark, folder, "documents"), shingle=3, percent=85)


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents")).filter("confirmed")


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_edits(_table(spark, folder, "documents"))


def op5_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, folder, "documents"),
                               _table(spark, folder, "benchmark"), short_inside=True)


def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op9_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, folder, "documents"),
                               public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write(_table(spark, folder, "pages"), shared_folder(spark))
    return warc.read(manifest).filter(F.col("last")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    encoded = bpe.encode(_table(spark, folder, "documents"), path).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"))
    kept = ("doc_id", "n_tokens", "ids_sha256")
    return bpe.decode(encoded, path, kept).select(*kept, F.sha2("text", 256).alias(
        "decoded_sha256"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    aligned = align.align(_table(spark, folder, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    kept = stored(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return align.with_counts(kept).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                          "count_sum", "groups_sha256")


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = stored(trie.numbered_turns(_table(spark, folder, "conversations")))
    return trie.trie(trie.rebuilt(turns)).drop("k1", "k2")


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_neardup, op3_licenses, op4_fingerprints, op5_mixture, op6_sharding,
    op7_decontaminate, op8_langid, op9_tokens, op10_warc, op11_bpe, op12_alignment, op13_trie)}

#: CRC-32 of the decimal digits of an id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
  string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, zero: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLES: dict[str, str] = {"op13_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
           length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format('conv_id')} % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, t.k AS place, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k + 1000000000, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
steps AS (
  SELECT conv_id, row_number() OVER along AS depth, text,
         list(sha256(length(role) || ':' || role || text)) OVER along AS path
  FROM built WINDOW along AS (PARTITION BY conv_id ORDER BY place)),
members AS (
  SELECT conv_id, depth, text, path FROM steps
  UNION ALL SELECT conv_id, 0, '', [] FROM convs),
ends AS (SELECT conv_id, max(depth) AS last FROM members GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS saves,
         sha256(coalesce(string_agg(CASE WHEN depth = last THEN conv_id::VARCHAR END, ','
                         ORDER BY conv_id), '')) AS ends_sha256
  FROM members JOIN ends USING (conv_id) GROUP BY path, depth),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0
         GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children
          FROM nodes LEFT JOIN kids USING (path)),
below AS (
  SELECT path[:d] AS path, sum(saves) AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM known, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM known n JOIN below b USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]"""}
