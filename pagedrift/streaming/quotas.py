"""Quotas on a stream: allow or deny every request, and counters that expire."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.quota import cut_off, mark_allowed, quota_counts, ranked, with_bucket
from ..sources import tables
from .keyed import ROCKSDB

USED = T.StructType([
    T.StructField("counter", T.StringType()), T.StructField("window", T.LongType()), T.StructField("n", T.LongType())
])


def decide_batch(
    rows: DataFrame, run_id: int, out: str, key: str, ts: str, seq: str, limit: int, window_ms: int,
    keep_windows: int | None = None, buckets: int | None = None, every: int | None = None,
) -> None:
    """Flag one micro-batch, given how many requests earlier ones allowed per window.

    Only the counters of this batch's keys and windows are read, from the buckets they lie in.
    ``keep_windows``: a new epoch leaves out counters that many windows older than the batch
    (default: it keeps all).
    """
    spark = rows.sparkSession
    counter = F.concat_ws(":", F.col(key).cast("string"), F.col("bucket").cast("string"))
    requests = with_bucket(rows, ts, window_ms).withColumn("counter", counter).persist()
    try:
        used = tables.read_keyed(
            spark, f"{out}/used", USED, run_id, requests, "counter", buckets, every
        ).select("counter", F.col("n").alias("n_used"))
        by_window = Window.partitionBy("counter").orderBy(ts, seq)
        first = (
            ranked(requests.select("counter", ts, seq, F.col("bucket").alias("window")), by_window)
            .where(F.col("rn") <= limit)
            .join(used, "counter", "left")
            .where(F.col("rn") <= limit - F.coalesce("n_used", F.lit(0)))
        )
        cutoff = first.groupBy("counter").agg(
            cut_off(ts, seq),
            F.max("window").alias("window"),
            (F.count("*") + F.coalesce(F.max("n_used"), F.lit(0))).alias("n"),
        )
        limits = requests.join(cutoff.select("counter", "cutoff"), "counter", "left")
        flagged = mark_allowed(limits, ("counter",), ts, seq)
        tables.write_run(flagged.drop("counter"), f"{out}/decisions", run_id)
        keep = None
        if keep_windows is not None:
            newest = requests.agg(F.max("bucket")).first()[0] or 0
            keep = F.col("window") > newest - keep_windows
        tables.write_keyed(
            cutoff.select("counter", "window", "n"), f"{out}/used", run_id, "counter", buckets, every, keep
        )
    finally:
        requests.unpersist()


def start_decisions(
    requests: DataFrame, out: str, key: str, ts: str, seq: str, limit: int, window_ms: int, **options: int
) -> StreamingQuery:
    """Decide all pending requests.  Order is by ``ts`` within a micro-batch."""
    return (
        requests.writeStream.foreachBatch(
            lambda rows, run_id: decide_batch(rows, run_id, out, key, ts, seq, limit, window_ms, **options)
        )
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


GRANTED = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("window", T.LongType()), T.StructField("ts", T.LongType()),
    T.StructField("seq", T.LongType()), T.StructField("nth", T.LongType()),
])


#: State is dealt into so many parts by key and window.  A part is one call to Python and one entry of the state
#: whatever it holds, so the number of calls does not grow with the counters.  Fixed for a checkpoint.
PARTS = 4_096
COUNTERS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("window", T.LongType()), T.StructField("n", T.LongType())
])


class WindowGrants(StatefulProcessor):
    """Counts what each key of a part was granted in a window; a counter goes when its window has closed.

    Of the requests of a micro-batch only the first that still fit are held, so memory follows the limit
    and the open windows of the part.
    """

    def __init__(self, limit: int, window_ms: int):
        self._limit, self._window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._used = handle.getListState("used", COUNTERS)

    def _end(self, window: int) -> int:
        return (window + 1) * self._window_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        used = {(k, w): n for k, w, n in self._used.get()}
        waiting = max((w for _, w in used), default=None)
        firsts: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for chunk in rows:
            # Negated: the heap's top is the last of those held.
            for k, w, ts, seq in zip(
                chunk["key"].tolist(), chunk["window"].tolist(), chunk["at"].tolist(), chunk["seq"].tolist()
            ):
                first = firsts.setdefault((k, w), [])
                if len(first) < self._limit - used.get((k, w), 0):
                    heapq.heappush(first, (-ts, -seq))
                elif first and (-ts, -seq) > first[0]:
                    heapq.heapreplace(first, (-ts, -seq))
        found = []
        for (k, w), first in firsts.items():
            before = used.get((k, w), 0)
            used[k, w] = before + len(first)
            granted = sorted((-ts, -seq) for ts, seq in first)
            found.extend((k, w, ts, seq, before + i + 1) for i, (ts, seq) in enumerate(granted))
        # Rows of this batch may lie before its watermark, those of later ones do not.
        passed = timerValues.getCurrentWatermarkInMs()
        left = [(k, w, n) for (k, w), n in used.items() if self._end(w) > passed]
        self._wait_until(waiting, max((w for _, w, _ in left), default=None))
        self._used.put(left) if left else self._used.clear()
        if found:
            yield pd.DataFrame(found, columns=GRANTED.names)

    def _wait_until(self, old: int | None, new: int | None) -> None:
        """One timer for a part, at the end of its last window."""
        if old == new:
            return
        if old is not None:
            self._handle.deleteTimer(self._end(old))
        if new is not None:
            self._handle.registerTimer(self._end(new))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._used.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_grants(
    requests: DataFrame, key: str, ts: str, seq: str, limit: int, window_ms: int, delay: str = "0 seconds"
) -> DataFrame:
    """The granted requests of a stream: ``key window ts seq nth`` (``ts`` in microseconds).

    A micro-batch grants the first requests by ``ts`` and ``seq`` of each key and window that still fit; all
    others are denied.  Counters are keyed state of parts of the keys and windows and end with the window, so
    no table of them is read or kept.  A request that comes later than ``delay`` behind the newest one
    gets no grant.
    """
    spark: SparkSession = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.col(ts).cast("timestamp")
    rows = with_bucket(requests, ts, window_ms).select(
        F.col(key).cast("string").alias("key"), F.col("bucket").alias("window"), at.alias("__at"),
        F.unix_micros(at).alias("at"), F.col(seq).cast("long").alias("seq"),
        F.pmod(F.xxhash64(F.col(key).cast("string"), "bucket"), F.lit(PARTS)).alias("part"),
    ).withWatermark("__at", delay)
    return rows.groupBy("part").transformWithStateInPandas(
        statefulProcessor=WindowGrants(limit, window_ms), outputStructType=GRANTED, outputMode="Append", timeMode="EventTime",
    )


def expiring_counts(
    requests: DataFrame, key: str, ts: str, window: str = "5 minutes", delay: str = "0 seconds"
) -> DataFrame:
    """Counters per key and window; the watermark closes a window and frees its state."""
    return quota_counts(requests.withWatermark(ts, delay), key, ts, window)


def start_counts(
    requests: DataFrame, out: str, key: str, ts: str, window: str = "5 minutes", delay: str = "0 seconds"
) -> StreamingQuery:
    """Count all pending requests.  Every run writes the counters that it moved, open windows too."""
    return (
        expiring_counts(requests, key, ts, window, delay)
        .writeStream.outputMode("update")
        .foreachBatch(lambda rows, run_id: tables.write_run(rows, f"{out}/counts", run_id))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def start_closed_counts(
    requests: DataFrame, out: str, key: str, ts: str, window: str = "5 minutes", delay: str = "0 seconds"
) -> StreamingQuery:
    """Count all pending requests.  Each counter is written once, when its window has closed; open ones are
    in the state of the stream only."""
    return (
        expiring_counts(requests, key, ts, window, delay)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/closed")
    )


def read_counts(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The last value of each counter; a counter never falls."""
    return spark.read.parquet(f"{out}/counts").groupBy(key, "window_start").agg(
        F.max("n_requests").alias("n_requests")
    )
