"""Snapshot diff: added, removed, changed and unchanged records.

Inputs are record tables: key columns, ``pos`` and the four fields.  Several rows may share a
key.  Rows keep their duplicates; the last previous row of a key is the one compared with.

Plan: both sides are first reduced to one row per key with partial aggregation, so a hot key
is one row when it crosses the network.  The full rows are then the streamed (left) side of a
left outer and a left anti join, the two join kinds whose left side adaptive execution may
split when a key is skewed.  A full outer join would pin a hot key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import material_change, material_promo, promo_equal
from ..schemas import FIELDS
from .common import compute_once

CHANGE_TYPES = ("added", "changed", "removed")


def record(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + f).alias(f) for f in FIELDS])


def last_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row with the highest ``pos`` of each key, as one struct ``last``."""
    return rows.groupBy(*keys).agg(F.max_by(record(), F.col("pos")).alias("last"))


def added_promos(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(previous.select(*keys).distinct(), list(keys), "left_anti")


def removed_promos(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    return previous.join(current.select(*keys).distinct(), list(keys), "left_anti")


def changed_promos(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = (
        current.select(*keys, "pos", record().alias("current"))
        .join(last_per_key(previous, keys), list(keys))
        .withColumnRenamed("last", "previous")
    )
    return pairs.where(~promo_equal(F.col("previous"), F.col("current")))


def classify(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every record with its class: keys, ``pos``, ``change_type``, ``previous``, ``current``."""
    seen = last_per_key(previous, keys).withColumnRenamed("last", "previous")
    now = current.select(*keys, "pos", record().alias("current")).join(seen, list(keys), "left")
    kind = (
        F.when(F.col("previous").isNull(), "added")
        .when(promo_equal(F.col("previous"), F.col("current")), "same")
        .otherwise("changed")
    )
    gone = removed_promos(current, previous, keys)
    return compute_once(now, "change_type", kind).unionByName(
        gone.select(*keys, "pos", F.lit("removed").alias("change_type"), record().alias("previous")),
        allowMissingColumns=True,
    )


def classify_pages(pages: DataFrame, current: Column, previous: Column, by: str = "url") -> DataFrame:
    """:func:`classify` for pages that have both record arrays in one row, keyed by page and id.

    The records of a page leave their row once, marked old or new, and meet in a window over the
    page and the id.  A window holds records of one page, so it is never larger than a row was.
    """
    def side(records: Column, old: bool) -> Column:
        return F.transform(records, lambda p, i: F.struct(
            F.lit(old).alias("old"), p["id"].alias("id"), i.cast("bigint").alias("pos"),
            F.struct(*[p[f].alias(f) for f in FIELDS]).alias("record"),
        ))

    rows = pages.select(by, F.inline(F.concat(side(current, False), side(previous, True))))
    same_key = Window.partitionBy(by, "id")
    last = F.max(F.when(F.col("old"), F.struct("pos", "record"))).over(same_key)["record"]
    n_now = F.count(F.when(~F.col("old"), 1)).over(same_key)
    met = rows.select("*", last.alias("last"), n_now.alias("n_now")).where(~F.col("old") | (F.col("n_now") == 0))
    pairs = met.select(
        by, "id", "pos", "old",
        F.when(F.col("old"), F.col("record")).otherwise(F.col("last")).alias("previous"),
        F.when(~F.col("old"), F.col("record")).alias("current"),
    )
    kind = (
        F.when(F.col("old"), "removed")
        .when(F.col("previous").isNull(), "added")
        .when(promo_equal(F.col("previous"), F.col("current")), "same")
        .otherwise("changed")
    )
    return compute_once(pairs, "change_type", kind).select(by, "id", "pos", "change_type", "previous", "current")


def detect_changes(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The change table: :func:`classify` without the unchanged records."""
    return classify(current, previous, keys).where(F.col("change_type") != "same")


def change_union(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The change table put together from its three parts (equal to :func:`detect_changes`)."""
    added = added_promos(current, previous, keys).select(
        *keys, "pos", F.lit("added").alias("change_type"), record().alias("current")
    )
    removed = removed_promos(current, previous, keys).select(
        *keys, "pos", F.lit("removed").alias("change_type"), record().alias("previous")
    )
    changed = changed_promos(current, previous, keys).withColumn("change_type", F.lit("changed"))
    return changed.unionByName(added, allowMissingColumns=True).unionByName(
        removed, allowMissingColumns=True
    )


def is_material() -> Column:
    """Whether a change row matters: its record for added and removed, its edit for changed."""
    previous, current = F.col("previous"), F.col("current")
    kind = F.col("change_type")
    return (
        F.when(kind.isin("added", "removed"), material_promo(F.coalesce(current, previous)))
        .when(kind == "changed", material_change(previous, current))
        .otherwise(False)
    )


def mark_material(classified: DataFrame) -> DataFrame:
    """The rows with ``material``, for use by several of the functions below."""
    return compute_once(classified, "material", is_material())


def material_changes(changes: DataFrame) -> DataFrame:
    """The change rows that matter (unchanged records never do)."""
    marked = changes if "material" in changes.columns else mark_material(changes)
    return marked.where("material").drop("material")


def change_sentence(added: Column, removed: Column, changed: Column, none: str) -> Column:
    """``2 new promotions, 1 promotion removed, and 3 promotions updated``."""

    def counted(n: Column, before: str, after: str) -> Column:
        return F.when(
            n > 0,
            F.concat(
                n.cast("string"),
                F.lit(f" {before}promotion"),
                F.when(n == 1, "").otherwise("s"),
                F.lit(after),
            ),
        )

    parts = F.array_compact(
        F.array(
            counted(added, "new ", ""),
            counted(removed, "", " removed"),
            counted(changed, "", " updated"),
        )
    )
    return (
        F.when(F.size(parts) == 0, none)
        .when(F.size(parts) <= 2, F.array_join(parts, " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(parts, 1, 2), ", "), F.lit(", and "), F.element_at(parts, -1)
            )
        )
    )


def count_changes(classified: DataFrame, by: Sequence[str], material: bool = False) -> DataFrame:
    """Counts and sentence per source, sources without any change included.

    Give it :func:`classify` rows: unchanged records keep their source in the result, so no
    join back to a list of sources is needed.
    """
    rows, counts_as = classified, F.lit(True)
    if material:
        rows = classified if "material" in classified.columns else mark_material(classified)
        counts_as = F.col("material")
    counts = rows.groupBy(*by).agg(
        *[
            F.count_if((F.col("change_type") == kind) & counts_as).alias(f"n_{kind}")
            for kind in CHANGE_TYPES
        ]
    )
    any_change = (F.col("n_added") + F.col("n_removed") + F.col("n_changed")) > 0
    none = "No material changes detected" if material else "No changes detected"
    return counts.withColumn("has_changes", any_change).withColumn(
        "summary",
        change_sentence(F.col("n_added"), F.col("n_removed"), F.col("n_changed"), none),
    )
