"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: table folder, BENCH_CPUS: local cores, BENCH_QUERIES: names to run.
"""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from tallybook.plans.fixtures import SCAN_PARTITIONS
from tallybook.plans.queries import QUERIES

HEADLINE = [
    "summary", "monthly", "top_merchants", "tx_types", "daily_balance_account", "by_category",
    "category_month_pivot", "enrich", "parse_dates", "parse_amounts", "normalise", "dedup_first",
    "merge_new_rows", "scan_csv", "rule_category", "merchant_stats", "amount_zscore", "global_rank",
    "forecast_linear", "forecast_seasonal", "char_ngrams", "anomaly_scores", "stream_daily_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config(SCAN_PARTITIONS, os.environ.get("BENCH_SCAN_PARTITIONS", cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run("monthly")  # warms up the JVM and the Python workers
    times = {name: run(name) for name in names}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline query time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
