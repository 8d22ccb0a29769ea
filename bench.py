"""Times the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from foliant.plans import catalogue

HEADLINES = [
    "micro_accuracy_by_role", "acceptance_normalise", "transcript_normalise", "greedy_suppression", "box_overlaps", "formulas_relabelled", "layout_post_process", "otsl_html", "frame_energy",
    "resampled", "event_sessions", "reconciled_files", "strict_json", "vector_measures", "pricing_summary", "revenue_by_nation",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("foliant-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["pricing_summary"](spark, sf_dir).collect()  # starts the JVM's code cache
    times = {}
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
