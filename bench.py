"""Times the headline queries on the tables in $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "flagship", "hop_table_counts", "type_node_counts", "onehop_overlap", "twohop_palindrome_dedup", "threehop_overlap", "dup_direction_filter",
    "metapath_variants", "target_exact_pairs", "grouped_metrics", "metrics_full", "merge_sum", "set_diff_compare", "summed_variants",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from hopweave.queries import queries

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = queries(), {}
    known["type_node_counts"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts the JVM's and Python's parts
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
