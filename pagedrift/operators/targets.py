"""The watch list: validation, filtering, keyed merge, and the join to crawled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import host_domains, host_public, target_problem, url_host


def tenant_urls(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """``urls`` (``tenant``, ``url``, and others) with ``allowed``: on or below a domain of their tenant.

    ``domains`` (``tenant``, ``domain``) may have any number of rows: a host is looked up by the
    domains it lies below, so the join is by key and the plan does not grow with the list.  A
    tenant without domains is allowed nothing, as is a row without a tenant.
    """
    listed = domains.select("tenant", F.lower("domain").alias("__domain")).where("tenant is not null").distinct()
    hosts = urls.select("tenant", "url").distinct().withColumn("__host", url_host(F.col("url")))
    asked = hosts.where(host_public(F.col("__host"))).select(
        "tenant", "url", F.explode(host_domains(F.col("__host"))).alias("__domain")
    )
    fine = asked.join(listed, ["tenant", "__domain"], "left_semi").select("tenant", "url").distinct()
    return urls.join(fine.withColumn("__fine", F.lit(True)), ["tenant", "url"], "left").select(
        *urls.columns, F.coalesce("__fine", F.lit(False)).alias("allowed")
    )


def enabled_targets(targets: DataFrame) -> DataFrame:
    """Targets that are not switched off; a missing flag means on."""
    return targets.where(F.coalesce(F.col("enabled"), F.lit(True)))


def check_targets(targets: DataFrame, allowed_domains: Sequence[str]) -> DataFrame:
    """The rows with ``problem`` (null when fine) and ``valid``."""
    checked = targets.withColumn("problem", target_problem(allowed_domains))
    return checked.withColumn("valid", F.col("problem").isNull())


def accepted_targets(
    targets: DataFrame, allowed_domains: Sequence[str], strict: bool = False
) -> DataFrame:
    """Valid targets.  ``strict`` returns none at all when any single row is invalid."""
    checked = check_targets(targets, allowed_domains)
    if strict:
        all_valid = checked.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("v")).scalar()
        return targets.where(all_valid)
    return checked.where("valid").drop("problem", "valid")


def rejected_targets(targets: DataFrame, allowed_domains: Sequence[str]) -> DataFrame:
    """The quarantine: invalid targets with the reason."""
    return check_targets(targets, allowed_domains).where(~F.col("valid")).drop("valid")


def pages_with_targets(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Pages of enabled targets with the target's selector and name.

    No broadcast hint: the list may grow, so the size check at run time picks the strategy.
    """
    wanted = enabled_targets(targets).select("url", "selector", "name")
    return pages.join(wanted, "url")


def upsert_targets(targets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keyed merge of ordered lists (``pos``): the first row of a url is replaced in place, an
    unknown url is appended; of several incoming rows for a url the last (``pos``) counts."""
    fields = [c for c in targets.columns if c not in ("url", "pos")]
    newest = incoming.groupBy("url").agg(
        F.max_by(F.struct(*fields), "pos").alias("new"), F.max("pos").alias("seq")
    )
    first = targets.groupBy("url").agg(F.min("pos").alias("first_pos"))
    merged = newest.join(first, "url", "left")
    tail = targets.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("n")).scalar()
    placed = merged.select(
        "url",
        F.coalesce(F.col("first_pos"), tail + 1 + F.col("seq")).alias("pos"),
        *[F.col(f"new.{f}").alias(f) for f in fields],
    )
    replaced = merged.where(F.col("first_pos").isNotNull()).select(
        "url", F.col("first_pos").alias("pos")
    )
    return targets.join(replaced, ["url", "pos"], "left_anti").unionByName(placed)


def remove_targets(targets: DataFrame, urls: DataFrame) -> DataFrame:
    """The list without any row of the given urls."""
    return targets.join(urls.select("url").distinct(), "url", "left_anti")


def removal_report(targets: DataFrame, urls: DataFrame) -> DataFrame:
    """Per requested url: how many rows go, and whether it was found."""
    counts = targets.groupBy("url").agg(F.count("*").alias("n"))
    return (
        urls.select("url")
        .distinct()
        .join(counts, "url", "left")
        .select(
            "url",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_removed"),
            F.col("n").isNotNull().alias("found"),
        )
    )
