"""Session settings that suit the jobs of this package."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Long column expressions compile to methods that the JVM will not optimise beyond 8000 bytes;
    # with this limit such a stage is split into small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture costs several driver calls for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A grouping of sorted rows collects its lists in one pass; a hash table of lists would sort the
    # rows on both sides of a shuffle.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # Adaptive execution merges small parts of a shuffle but splits none of a grouping: many parts
    # to begin with, so that those of large tables are sorted and grouped in memory.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    # What a task reads is combined in memory before its shuffle.
    "spark.sql.files.maxPartitionBytes": "32m",
    # Hot documents and values are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def compiled_small(spark: SparkSession) -> None:
    """Sets what decides the work of a plan in a session that was not built by `configured`."""
    for name in ("spark.sql.codegen.hugeMethodLimit",
                 "spark.sql.execution.replaceHashWithSortAgg",
                 "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                 "spark.sql.files.maxPartitionBytes"):
        spark.conf.set(name, SETTINGS[name])


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
