"""From a folder of documents to written results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.lineage import written
from ledgerline.operators.nesting import nest
from ledgerline.plans import pipeline
from ledgerline.sources import documents, sinks
from ledgerline.sources.result_files import write_result_files

NOT_READ = "no content could be read"


def read_folder(spark: SparkSession, folder: str, grids: DataFrame | None = None,
                pages: DataFrame | None = None, tables: DataFrame | None = None,
                images: DataFrame | None = None):
    """-> (routes for `pipeline.combine`, inputs, rejects(doc_id, error) of unsupported files).

    CSV files are read here. What needs a decoder arrives decoded, with the paths of `discover` as
    doc_id: other spreadsheets as `grids`, PDF files as `pages` and `tables`, images as `images`
    (recognised texts).
    """
    inputs, rejects = documents.route_files(documents.discover(spark, folder))
    routes = []
    if not inputs.filter(F.col("extension") == ".csv").isEmpty():
        rows = documents.read_csv_grids(spark, folder.rstrip("/") + "/*.[cC][sS][vV]")
        routes.append(pipeline.extract_spreadsheets(
            rows.withColumn("doc_id", documents.as_listed(F.col("doc_id")))))
    if grids is not None:
        routes.append(pipeline.extract_spreadsheets(grids))
    if pages is not None:
        routes.append(pipeline.extract_pdfs(pages, tables))
    if images is not None:
        routes.append(pipeline.extract_images(images))
    return routes, inputs, rejects.select(F.col("path").alias("doc_id"), "error")


def run(spark: SparkSession, folder: str, out: str, customers: DataFrame, items: DataFrame,
        fallback=None, ledger: str | None = None, **decoded: DataFrame):
    """Process a folder and write `out`/json (a file for each document), `out`/routed and
    `out`/rejects -> (results, rejects).

    Every file of the folder ends in the results or in the rejects(doc_id, error): files of
    unsupported types, documents that gave no line, and files without any content, such as a
    file of no bytes, a CSV file of blank lines or a PDF file that the decoder left out.
    ledger: a folder for the replies of the fallback function (see `fallback.fallback_replies`).
    A folder without any supported file raises FileNotFoundError. `decoded`: see `read_folder`.
    """
    routes, inputs, unsupported = read_folder(spark, folder, **decoded)
    rejects = unsupported
    files = inputs.select(F.col("path").alias("doc_id"))
    if not routes:
        results = None
    else:
        docs, lines, unread = pipeline.combine(routes, fallback, ledger)
        docs = written(docs)
        rejects = rejects.unionByName(unread)
        files = (files.join(docs.select("doc_id"), "doc_id", "left_anti")
                 .join(unread.select("doc_id"), "doc_id", "left_anti"))
        rows = pipeline.process_rows(docs, lines, customers, items)
        write_result_files(*rows, f"{out}/json")
        results = written(nest(*rows))
        sinks.write_routed(results, f"{out}/routed")
    rejects = written(rejects.unionByName(files.withColumn("error", F.lit(NOT_READ))))
    sinks.write_json(rejects, f"{out}/rejects")
    return results, rejects
