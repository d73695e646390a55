"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# History in both forms of request, one-pass reports, rank metrics, audit and the feed join.
HEADLINE = [
    "all_history", "point_in_time_lookup", "error_contribution", "cutoff_table", "category_audit",
    "support_by_group", "validate_route_location", "fuzzy_location", "threshold_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cores)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
        # The test tables are single small files: smaller splits use all cores.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "0")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks.cases import CASES
    from priorline.sources.durable import drop_durable

    CASES["rows_by_mode"][0](spark, sf_dir).collect()  # warm up the session
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        CASES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        drop_durable(spark)
    factor = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(factor.group(1)) if factor else None,
            }
        )
    )


if __name__ == "__main__":
    main()
