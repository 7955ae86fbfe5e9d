"""Bounded history per url: append, newest N, prune, clear.

"Newest N" is ``row_number() <= N``, for which Spark keeps only N rows of a url per task before
the shuffle.  What is pruned is found by comparing with the oldest kept row, so no task ever
ranks the whole history of a hot url.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import snapshot_valid

KEEP = 5


def valid_history(history: DataFrame) -> DataFrame:
    return history.where(
        snapshot_valid(F.col("hash"), F.col("ts").cast("string"), F.col("promos"))
    )


def history_append(history: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """History with the new snapshots; the same url and time overwrites."""
    keys = ["url_key", "ts"]
    fields = [c for c in history.columns if c not in keys]
    last = (
        new.groupBy(*keys)
        .agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("row"))
        .select(*keys, "row.*")
        .select(*history.columns)
    )
    return history.join(last.select(*keys), keys, "left_anti").unionByName(last)


def newest(history: DataFrame, keep: int = KEEP, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The newest ``keep`` snapshots of every url, with their rank ``rn``."""
    window = Window.partitionBy("url_key").orderBy(*[F.desc(c) for c in order])
    return history.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= keep)


def latest_history(
    history: DataFrame, limit: int = KEEP, order: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """Newest snapshots per url.  The limit comes before the validity check, so an invalid
    snapshot takes a place and is then left out."""
    return valid_history(newest(history, limit, order))


def prune_history(
    history: DataFrame, keep: int = KEEP, order: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """What stays after pruning."""
    return newest(history, keep, order).drop("rn")


def pruned_rows(
    history: DataFrame, keep: int = KEEP, order: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """What pruning deletes: rows older than the oldest one kept."""
    oldest = (
        newest(history.select("url_key", *order), keep, order)
        .groupBy("url_key")
        .agg(F.min(F.struct(*order)).alias("oldest"))
    )
    return history.join(oldest, "url_key").where(F.struct(*order) < F.col("oldest")).drop("oldest")


def prune_counts(history: DataFrame, keep: int = KEEP) -> DataFrame:
    """Per url: how many snapshots stay and how many go."""
    n = F.count("*")
    return history.groupBy("url_key").agg(
        F.least(n, F.lit(keep)).cast("bigint").alias("n_kept"),
        F.greatest(n - keep, F.lit(0)).cast("bigint").alias("n_deleted"),
    )


def store_and_prune(
    history: DataFrame,
    new: DataFrame,
    keep: int = KEEP,
    append_order: tuple[str, ...] = ("ts",),
    order: tuple[str, ...] = ("ts",),
) -> DataFrame:
    return prune_history(history_append(history, new, list(append_order)), keep, order)


def clear_history(history: DataFrame, keys: DataFrame) -> DataFrame:
    return history.join(keys.select("url_key").distinct(), "url_key", "left_anti")


def clear_counts(history: DataFrame, keys: DataFrame) -> DataFrame:
    """Per requested url: how many snapshots clearing deletes."""
    counts = history.groupBy("url_key").agg(F.count("*").alias("n"))
    return (
        keys.select("url_key")
        .distinct()
        .join(counts, "url_key", "left")
        .select("url_key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_deleted"))
    )
