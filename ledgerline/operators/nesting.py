"""From the working form to one record per document."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.totals import part_of
from ledgerline.schemas import ITEM_FIELDS, RESULT


def nest(docs: DataFrame, lines: DataFrame, reasons: DataFrame,
         part_size: int | None = None) -> DataFrame:
    """One record per document, whatever its size: (doc_id, part, fields of schemas.RESULT).

    The record is the format of the results, so it holds all lines of its document. Where documents
    are too large for a record, `part_size` limits its lines: a larger document then continues in
    further records with the same header fields, each with the items and line reasons of its part.
    """
    whole, part_size = not part_size, part_size or 2**62
    item = F.struct("line_pos", *[F.col(f.name).cast(f.dataType).alias(f.name)
                                  for f in ITEM_FIELDS]).alias("item")
    grouped = lines.select("doc_id", part_of(F.col("line_pos"), part_size).alias("part"), item,
                           F.lit(None).cast("struct<place:struct<rank:int,sort_text:string,"
                                            "line_pos:bigint,step:int>,reason:string>")
                           .alias("entry"))
    entries = reasons.select(
        "doc_id", part_of(F.col("place.line_pos"), part_size).alias("part"),
        F.lit(None).cast(grouped.schema["item"].dataType).alias("item"),
        F.struct("place", "reason").alias("entry"))
    heads = docs.select("doc_id", F.lit(0).cast("bigint").alias("part"),
                        F.lit(None).cast(grouped.schema["item"].dataType).alias("item"),
                        F.lit(None).cast(grouped.schema["entry"].dataType).alias("entry"))
    rows = grouped.unionByName(entries).unionByName(heads)
    if whole:
        # A record is built by one task: its rows meet once, for the record and for its header.
        rows = rows.repartition("doc_id")
    parts = (rows.groupBy("doc_id", "part")
             .agg(F.sort_array(F.collect_list("item")).alias("items"),
                  F.sort_array(F.collect_list("entry")).alias("entries")))
    names = [f.name for f in ITEM_FIELDS]
    return (parts.join(docs, "doc_id")
            .withColumn("items", F.transform("items", lambda x: F.struct(
                *[x[n].alias(n) for n in names])))
            .withColumn("review_reasons", F.col("entries.reason"))
            .select("doc_id", "part", *[F.col(f.name).cast(f.dataType).alias(f.name)
                                        for f in RESULT.fields]))
