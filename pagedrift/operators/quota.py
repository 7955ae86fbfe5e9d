"""Fixed-window quota: the first ``limit`` requests of a key in a window are allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WINDOW_MS = 300_000


def with_bucket(requests: DataFrame, ts: str, window_ms: int = WINDOW_MS) -> DataFrame:
    millis = F.unix_millis(F.col(ts).cast("timestamp"))
    return requests.withColumn("bucket", F.floor(millis / window_ms).cast("bigint"))


def window_quota(
    requests: DataFrame,
    key: str,
    ts: str,
    seq: str,
    limit: int,
    window_ms: int = WINDOW_MS,
) -> DataFrame:
    """Every request with ``allowed``; order is ``ts`` then ``seq``, and of equal ones any come first.

    Only the first ``limit`` requests of a window are ranked (Spark cuts to that many per task
    before the shuffle).  The last of them is the window's cut-off, one narrow row, and every
    request is compared with it; only those equal to it are counted.  A key holding a third of all
    requests is never sorted in one task.
    """
    bucketed = with_bucket(requests, ts, window_ms)
    by_window = Window.partitionBy(key, "bucket").orderBy(ts, seq)
    first = ranked(bucketed.select(key, "bucket", ts, seq), by_window).where(F.col("rn") <= limit)
    found = first.groupBy(F.col(key).alias("__key"), F.col("bucket").alias("__bucket")).agg(cut_off(ts, seq))
    here = F.col(key).eqNullSafe(F.col("__key")) & F.col("bucket").eqNullSafe(F.col("__bucket"))
    return mark_allowed(bucketed.join(found, here), (key, "bucket"), ts, seq).drop("__key", "__bucket")


def ranked(rows: DataFrame, window: WindowSpec) -> DataFrame:
    """With the place of each row, ``rn``, and that of the first row equal to it, ``rk``."""
    return rows.withColumns({"rn": F.row_number().over(window), "rk": F.rank().over(window)})


def cut_off(ts: str, seq: str) -> Column:
    """The last of the :func:`ranked` rows that fit: ``ts seq``, and with ``rn`` and ``rk`` how many equal ones do."""
    return F.max(F.struct(ts, seq, "rn", "rk")).alias("cutoff")


def mark_allowed(rows: DataFrame, window: tuple[str, ...], ts: str, seq: str) -> DataFrame:
    """Rows with the ``cutoff`` of their window (null: nothing fits), as rows with ``allowed``."""
    own, last = F.struct(ts, seq), F.struct(F.col(f"cutoff.{ts}"), F.col(f"cutoff.{seq}"))
    equal = F.row_number().over(Window.partitionBy(*window, ts, seq).orderBy(F.lit(0)))
    fits = (own < last) | ((own == last) & (equal <= F.col("cutoff.rn") - F.col("cutoff.rk") + 1))
    return rows.withColumn("allowed", F.col("cutoff").isNotNull() & fits).drop("cutoff")


def quota_counts(requests: DataFrame, key: str, ts: str, window: str = "5 minutes") -> DataFrame:
    """Requests per key and window; on a stream with a watermark the counters expire with it."""
    return (
        requests.groupBy(F.window(ts, window), key)
        .agg(F.count("*").alias("n_requests"))
        .select(key, F.col("window.start").alias("window_start"), "n_requests")
    )
