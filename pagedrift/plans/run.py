"""One run: new snapshots against the stored state, up to changes, results and history rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diff import classify_pages, count_changes, mark_material, material_changes
from ..operators.extract import page_promos, selector_supported
from ..operators.state import newest_pages, state_valid, with_previous_state
from ..operators.targets import pages_with_targets
from ..sources.tables import check_crawl, written

class Run(NamedTuple):
    """Outputs of a run, lazy over its pages."""

    results: DataFrame
    changes: DataFrame
    state: DataFrame
    history: DataFrame


def crawl_snapshots(
    crawl: DataFrame,
    targets: DataFrame,
    allowed_domains: Sequence[str] | None = None,
    mode: str = "lazy",
) -> tuple[DataFrame, DataFrame]:
    """Newest fetch of every enabled target as a snapshot row, and the failed fetches.

    A page that failed, or whose selector is of a kind that is not supported, keeps its stored
    state: it appears in the failures only.  ``crawl`` has the columns of ``schemas.CRAWL``.
    ``mode``: see :func:`..operators.extract.container_blocks`.
    """
    newest = newest_pages(crawl, "url", ["ts", "fetch_id"])
    checked = check_crawl(pages_with_targets(newest, targets), allowed_domains).withColumn(
        "error",
        F.when(F.col("error").isNotNull(), F.col("error")).when(
            ~selector_supported(F.col("selector"), mode),
            F.concat(F.lit("Selector not supported: "), F.coalesce("selector", F.lit(""))),
        ),
    )
    promos = page_promos(F.col("html"), F.col("selector"), mode)
    snapshots = checked.where(F.col("error").isNull()).select("url", "ts", promos.alias("promos"))
    failed = checked.where(F.col("error").isNotNull()).select("url", "name", "error")
    return snapshots, failed


def fresh_pages(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid current rows that are not older than the stored state, which is ``previous``."""
    found = with_previous_state(current.where(state_valid()), stored)
    return found.where(
        F.col("previous").isNull() | (F.col("last_seen") >= F.col("previous.last_seen"))
    )


def marked_changes(fresh: DataFrame, min_records: int = 0) -> DataFrame:
    """Record changes of the pages that differ, with ``material``."""
    touched = fresh.where(
        (F.col("previous.hash") != F.col("hash")) & (F.size("promos") >= min_records)
    )
    return mark_material(classify_pages(touched, F.col("promos"), F.col("previous.promos")))


def page_results(fresh: DataFrame, marked: DataFrame) -> DataFrame:
    """One row for each fresh page, with its material changes and the sentence for them."""
    counts = count_changes(marked, ["url"], material=True)
    results = fresh.select("url", F.col("previous").isNull().alias("first_run"), "hash", "last_seen")
    return results.join(counts, "url", "left").select(
        "url",
        "first_run",
        F.coalesce("has_changes", F.lit(False)).alias("has_changes"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_added", "n_changed", "n_removed")],
        F.when(F.col("first_run"), "Initial state captured")
        .otherwise(F.coalesce("summary", F.lit("No material changes detected")))
        .alias("summary"),
    )


def run_snapshots(current: DataFrame, stored: DataFrame, min_records: int = 0) -> Run:
    """``current``: one state row per url.  ``stored``: the state table.

    A url without a valid stored state is a first run and reports nothing.  A snapshot older
    than the stored one is ignored.  Equal hashes skip the diff, so only the records of pages
    that differ leave their row.  ``min_records`` (off by default) leaves pages with fewer records
    out of the diff, for sites that sometimes answer with an empty page.

    The pages with what was stored of them are written once: every output reads them, and their records
    were cut out of the crawled pages.
    """
    fresh = written(fresh_pages(current, stored), "fresh")
    marked = marked_changes(fresh, min_records)
    results = page_results(fresh, marked)
    state = fresh.select(*current.columns)
    return Run(results, material_changes(marked), state, history_rows(state, results))


def history_rows(state: DataFrame, results: DataFrame) -> DataFrame:
    """A history row for each page with material changes."""
    changed = results.where("has_changes").select("url")
    return state.join(changed, "url", "left_semi").select(
        "url_key", F.col("last_seen").alias("ts"), "hash", "promos"
    )


def run_results(run: Run, failed: DataFrame) -> DataFrame:
    """Run-result rows for the reports: successes and failures together."""
    done = run.results.select(
        "url", F.lit(True).alias("success"), "has_changes", "summary",
        F.col("has_changes").alias("notified"),
    )
    lost = failed.select("url", "name", "error", F.lit(False).alias("success"))
    return done.unionByName(lost, allowMissingColumns=True)
