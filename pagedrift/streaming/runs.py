"""Snapshots or crawled pages as a stream of runs: every micro-batch is one run over the stored state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import material_changes
from ..operators.digest import change_digest, messages
from ..operators.history import KEEP, store_and_prune
from ..operators.report import run_counts, run_report, stats_sentence
from ..operators.state import newest_per_key, states_from_snapshots
from ..plans.run import crawl_snapshots, fresh_pages, history_rows, marked_changes, page_results
from ..schemas import CRAWL, HISTORY, SNAPSHOT, STATE
from ..sources import tables


def read_snapshots(spark: SparkSession, source: str, files_per_run: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SNAPSHOT)
    if files_per_run:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    return reader.parquet(source)


def run_batch(
    rows: DataFrame, run_id: int, out: str, keep: int = KEEP,
    buckets: int | None = None, every: int | None = None,
) -> None:
    """One run.  Of several snapshots of a url in a run the newest counts, as for a scheduled
    run that sees a page once.

    The work follows the batch: of the stored state and history only the rows of its urls are
    read, the changes are found once, written, and read again for results and digest.  The history
    of a url with material changes is pruned to its newest ``keep`` snapshots; one of the same time
    is replaced.  Everything goes to sub-folders of this run and is read from earlier runs only,
    so a repeated micro-batch rebuilds the same output.
    """
    spark = rows.sparkSession
    states = states_from_snapshots(rows)
    current = newest_per_key(states, ["url"], ["last_seen", "hash"]).select(*states.columns).persist()
    fresh = None
    try:
        stored = tables.read_keyed(
            spark, f"{out}/state", STATE, run_id, current, buckets=buckets, every=every
        )
        fresh = fresh_pages(current, stored).persist()
        tables.write_run(material_changes(marked_changes(fresh)), f"{out}/changes", run_id)
        changes = spark.read.parquet(f"{out}/changes/run_id={run_id}")
        tables.write_run(
            page_results(fresh, changes.withColumn("material", F.lit(True))), f"{out}/results", run_id
        )
        results = spark.read.parquet(f"{out}/results/run_id={run_id}")
        state = fresh.select(*current.columns)
        new = history_rows(state, results)
        old = tables.read_keyed(
            spark, f"{out}/history", HISTORY, run_id, new, buckets=buckets, every=every
        )
        tables.write_keyed(
            store_and_prune(old, new, keep), f"{out}/history", run_id, buckets=buckets, every=every
        )
        detected = current.select(
            "url",
            F.lit(None).cast("string").alias("name"),
            F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"),
        )
        blocks = change_digest(results.join(detected, "url"), changes, F.current_timestamp())
        tables.write_digest(messages(blocks), f"{out}/digest", run_id)
        # The state comes last: a run without it is repeated from the start.
        tables.write_keyed(state, f"{out}/state", run_id, buckets=buckets, every=every)
    finally:
        current.unpersist()
        if fresh is not None:
            fresh.unpersist()


OUTCOME = ("url", "name", "success", "has_changes", "notified", "summary", "error")


def crawl_batch(
    crawl: DataFrame, targets: DataFrame, run_id: int, out: str, allowed_domains: Sequence[str] | None = None,
    mode: str = "lazy", **options: int,
) -> None:
    """One run from crawled pages to its report.

    The accepted pages go through :func:`run_batch`.  Their results and the failed fetches are the
    ``outcomes`` of the run, one row for each page, and ``report`` says the same in words.  The totals are
    observed while the outcomes are written and make up ``stats``, so they cost no pass of their own.
    A repeated micro-batch rebuilds all of it.
    """
    spark = crawl.sparkSession
    snapshots, failed = crawl_snapshots(crawl, targets, allowed_domains, mode)
    run_batch(snapshots, run_id, out, **options)
    done = spark.read.parquet(f"{out}/results/run_id={run_id}").join(
        targets.groupBy("url").agg(F.min("name").alias("name")), "url", "left"
    ).select(
        "url", "name", F.lit(True).alias("success"), "has_changes", F.col("has_changes").alias("notified"), "summary",
        F.lit(None).cast("string").alias("error"),
    )
    lost = failed.select("url", "name", F.lit(False).alias("success"), "error")
    outcomes = done.unionByName(lost, allowMissingColumns=True).select(*OUTCOME)
    seen = Observation(f"run-{run_id}-{uuid.uuid4().hex}")
    tables.write_run(outcomes.observe(seen, *run_counts()), f"{out}/outcomes", run_id)
    tables.write_run(run_report(spark.read.parquet(f"{out}/outcomes/run_id={run_id}")), f"{out}/report", run_id)
    totals = spark.range(1).select(*[F.lit(n).cast("bigint").alias(k) for k, n in seen.get.items()])
    tables.write_run(totals.withColumn("summary", stats_sentence()), f"{out}/stats", run_id)


def read_crawls(spark: SparkSession, source: str, files_per_run: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CRAWL)
    if files_per_run:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    return reader.parquet(source)


def start_crawl_runs(
    crawl: DataFrame, targets: Callable[[], DataFrame], out: str, allowed_domains: Sequence[str] | None = None,
    trigger_every: str | None = None, mode: str = "lazy", **options: int,
) -> StreamingQuery:
    """Like :func:`start_runs`, from crawled pages.  ``targets`` gives the list as it is when a run starts."""
    writer = crawl.writeStream.foreachBatch(
        lambda rows, run_id: crawl_batch(rows, targets(), run_id, out, allowed_domains, mode, **options)
    ).option("checkpointLocation", f"{out}/checkpoint")
    trigger = {"processingTime": trigger_every} if trigger_every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def start_runs(
    snapshots: DataFrame, out: str, trigger_every: str | None = None, **options: int
) -> StreamingQuery:
    """Start the run stream: all pending files once, or every so often (``3 hours``).

    ``options``: see :func:`run_batch`.
    """
    writer = snapshots.writeStream.foreachBatch(
        lambda rows, run_id: run_batch(rows, run_id, out, **options)
    ).option("checkpointLocation", f"{out}/checkpoint")
    trigger = {"processingTime": trigger_every} if trigger_every else {"availableNow": True}
    return writer.trigger(**trigger).start()
