"""Finding, routing and reading input documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.sources.csv_scan import read_csv_rows


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name; "" without one (a leading dot starts no suffix)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_type(extension: Column) -> Column:
    return (F.when(extension.isin(K.SPREADSHEET_SUFFIXES), "spreadsheet")
            .when(extension.isin(K.PDF_SUFFIXES), "pdf")
            .when(extension.isin(K.IMAGE_SUFFIXES), "image"))


def route_files(files: DataFrame):
    """files(path) -> (inputs(path, filename, extension, file_type), rejects(path, error))."""
    named = (files.withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1))
             .withColumn("extension", suffix(F.col("path")))
             .withColumn("file_type", file_type(F.col("extension"))))
    rejects = named.filter(F.col("file_type").isNull()).select(
        "path", F.concat(F.lit("Unsupported file extension: "), "extension").alias("error"))
    inputs = named.filter(F.col("file_type").isNotNull())\
        .select("path", "filename", "extension", "file_type")
    return inputs, rejects


def as_listed(path: Column) -> Column:
    """The path of a file in a scan, spelled as in a listing: no escapes, one slash after `file:`."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """files(path) of a folder, not its subfolders; file contents are never read.

    A scan passes over files of zero bytes, so these are taken from the index that every scan of
    the folder keeps: the paths, and nothing else, are held where Spark holds that index.
    """
    scan = spark.read.format("binaryFile").load(folder)
    listed = spark.createDataFrame([(p,) for p in scan.inputFiles()], "path string")
    found = listed.select(as_listed(F.col("path")).alias("path")).unionByName(
        scan.select("path")).distinct()
    inputs, _ = route_files(found)
    if inputs.isEmpty():
        raise FileNotFoundError(f"no supported input documents in {folder}")
    return found


def read_csv_grids(spark: SparkSession, path) -> DataFrame:
    """CSV documents -> rows(doc_id, row_idx, cells); see `csv_scan.read_csv_rows`."""
    return read_csv_rows(spark, path)
