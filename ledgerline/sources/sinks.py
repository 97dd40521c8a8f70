"""Writing results."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(results: DataFrame, folder: str) -> None:
    """One JSON object per record, nulls kept."""
    results.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def write_routed(results: DataFrame, folder: str) -> None:
    """Approved and to-be-reviewed records in separate folders (needs_review=false / true)."""
    results.write.mode("overwrite").partitionBy("needs_review").parquet(folder)


def publish(folder: str, **sides: DataFrame) -> int:
    """Write tables that belong together, and make them visible together -> version.

    Each version has a folder of its own. Readers go by the list of versions, to which one small
    file is added when all tables are complete; a failure before that leaves the last version as
    it was, and what it wrote is never read. One publisher at a time.
    """
    spark = next(iter(sides.values())).sparkSession
    last = _last_version(spark, folder)
    version = (last["version"] if last else 0) + 1
    run = f"{version:08d}-{uuid.uuid4().hex}"
    for name, rows in sides.items():
        rows.write.parquet(f"{folder}/runs/{run}/{name}")
    spark.createDataFrame([(version, run, sorted(sides))],
                          "version long, run string, tables array<string>")\
        .coalesce(1).write.mode("append").json(f"{folder}/versions")
    return version


def _last_version(spark: SparkSession, folder: str):
    try:
        listed = spark.read.schema("version long, run string, tables array<string>").json(
            f"{folder}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return listed.orderBy(F.col("version").desc(), F.col("run")).first()


def published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last complete version."""
    last = _last_version(spark, folder)
    if last is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return {name: spark.read.parquet(f"{folder}/runs/{last['run']}/{name}")
            for name in last["tables"]}


def publish_routed(results: DataFrame, reasons: DataFrame, folder: str) -> int:
    """Approved records, records to be reviewed, and the review queue, as one version.

    results (needs_review, ...) are read twice: pass a written table.
    """
    return publish(folder, approved=results.filter(~F.col("needs_review")),
                   review=results.filter("needs_review"), queue=review_queue(reasons))


def review_queue(reasons: DataFrame) -> DataFrame:
    """reasons(doc_id, reason, place) -> one row per document and reason, with its place."""
    return reasons.select("doc_id", F.col("place.rank").alias("rank"),
                          F.col("place.line_pos").alias("line_pos"), "reason")
