"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1), BENCH_CPUS: local cores (default 8),
BENCH_QUERIES: names separated by commas (default: the headline queries).
"""

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from pricetrail.session import session

HEADLINE = (
    "latest_price search compare products_with_history canonical_categories category_page "
    "price_changes top_movers inflation_by_category inflation_by_store fake_sales price_index "
    "detect_unit_changes flag_price_jumps first_price_per_day resolve_products upsert_products "
    "normalize_units exact_matches fuzzy_matches comparison_table extract_observations search_index"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pricetrail-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # One machine, small files: spread the reading and the work over all cores.
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["latest_price"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
