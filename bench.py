"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from ledgerline.plans.queries import QUERIES
from ledgerline.session import configured

HEADLINE = ["line_positions", "validate_grand_total", "business_rules", "doc_confidence",
            "parse_numbers", "counterparty_text", "text_line_items", "page_line_items",
            "counterparty_grid", "grid_line_items", "pdf_table_items", "match_items_fuzzy",
            "match_customers_fuzzy", "resolve_and_write_back", "process_documents"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (configured(SparkSession.builder).master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "unit": "sec",
                      "value": round(sum(seconds.values()), 3), "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
