"""Time the headline jobs.  Prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1).  BENCH_CPUS: cores (default all).
Every job is planned and run to the end with the no-op sink, so nothing is pruned away.
The given tables are one file of one row group each, which only one task can read: they are
first written as a file per core, which is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from pagedrift.plans.jobs import JOBS
from pagedrift.session import configure

# One or more per part of the engine.
HEADLINE = (
    "normalize_text", "filter_noise", "content_hash", "html_to_text", "promos_from_text",
    "similar_price", "similar_dates", "material_change", "promo_ids",
    "page_promos", "price_mentions", "generic_deals", "page_content_hash",
    "detect_changes", "change_counts", "material_changes", "digest_top3", "change_digest",
    "state_lookup", "state_upsert", "hash_gated_update", "snapshot_run",
    "history_append", "latest_history", "prune_history", "store_and_prune",
    "crawl_accept", "validate_targets", "run_summary", "duration_stats", "window_quota",
)


def spread_tables(spark: SparkSession, sf_dir: str, parts: int) -> str:
    folder = tempfile.mkdtemp(prefix="pagedrift-bench-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            rows = spark.read.parquet(f"{sf_dir}/{name}")
            rows.repartition(parts).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagedrift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagedrift-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    sf_dir = spread_tables(spark, sf_dir, int(cpus))
    JOBS["duration_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline jobs",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": scale,
            }
        )
    )


if __name__ == "__main__":
    main()
