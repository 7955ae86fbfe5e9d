"""Current state per url: lookup, hash gate, upsert and delete.

State rows are documents (one per url, records as an array).  The operators join on ``url_key``
and never collect rows into arrays themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import snapshot_valid
from ..functions.text import content_hash, promos_hash

STATE_FIELDS = ("hash", "promos", "last_seen")


def states_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows (url, ts, promos) as state rows with key and hash."""
    return snapshots.select(
        content_hash(F.col("url")).alias("url_key"),
        "url",
        promos_hash(F.col("promos")).alias("hash"),
        "promos",
        F.col("ts").alias("last_seen"),
    )


def state_valid() -> Column:
    return snapshot_valid(F.col("hash"), F.col("last_seen").cast("string"), F.col("promos"))


def with_previous_state(current: DataFrame, state: DataFrame) -> DataFrame:
    """Current rows with ``previous`` (a struct, null when absent or invalid)."""
    known = state.where(state_valid()).select(
        "url_key", F.struct(*STATE_FIELDS).alias("previous")
    )
    return current.join(known, "url_key", "left")


def hash_gate(current: DataFrame, state: DataFrame) -> DataFrame:
    """Only rows whose url is new or whose hash differs: the rest needs no diff and no write."""
    known = state.where(state_valid()).select("url_key", F.col("hash").alias("known_hash"))
    return (
        current.join(known, "url_key", "left")
        .where(F.col("known_hash").isNull() | (F.col("known_hash") != F.col("hash")))
        .drop("known_hash")
    )


def newest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the highest by ``order``.  Reduced before the shuffle."""
    fields = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("row"))
    return newest.select(*keys, "row.*")


def newest_pages(pages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Like :func:`newest_per_key` for wide rows: only key and order columns are aggregated,
    the winning rows are fetched by a semi join.  ``order`` must identify a row of a key."""
    wanted = pages.groupBy(key).agg(F.max(F.struct(*order)).alias("top"))
    wanted = wanted.select(key, *[F.col(f"top.{c}").alias(c) for c in order])
    return pages.join(wanted, [key, *order], "left_semi")


def state_upsert(state: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """State with the valid new rows put in; the last write of a url wins."""
    last = newest_per_key(new.where(state_valid()), ["url_key"], order).select(*state.columns)
    return state.join(last.select("url_key"), "url_key", "left_anti").unionByName(last)


def state_delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("url_key").distinct(), "url_key", "left_anti")
