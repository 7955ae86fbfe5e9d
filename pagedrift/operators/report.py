"""Run statistics and reports over run-result rows (one per target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_counts() -> list[Column]:
    """The totals of a run, as aggregates; they may also be observed while rows are written."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.coalesce("has_changes", F.lit(False))).alias("with_changes"),
        F.count_if(F.coalesce("notified", F.lit(False))).alias("notified"),
    ]


def run_stats(results: DataFrame) -> DataFrame:
    """One row: totals of a run."""
    return results.agg(*run_counts())


def run_sentence() -> Column:
    """``3 targets processed, 2 successful, 1 failed``: zero parts are left out."""
    total, notified = F.col("total"), F.col("notified")

    def part(n: Column, text: Column | str) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), text))

    def plural(n: Column, word: str) -> Column:
        return F.concat(F.lit(word), F.when(n == 1, "").otherwise("s"))

    return F.concat_ws(
        ", ",
        F.concat(total.cast("string"), F.lit(" "), plural(total, "target"), F.lit(" processed")),
        part(F.col("successful"), "successful"),
        part(F.col("failed"), "failed"),
        part(F.col("with_changes"), "with changes"),
        part(notified, F.concat(plural(notified, "notification"), F.lit(" sent"))),
    )


def stats_sentence() -> Column:
    """The sentence for the totals of a run."""
    return F.when(F.col("total") == 0, "No enabled targets found in configuration").otherwise(run_sentence())


def run_summary(results: DataFrame) -> DataFrame:
    return run_stats(results).withColumn("summary", stats_sentence())


def run_report(results: DataFrame) -> DataFrame:
    """Per target: name, url, status and message."""
    message = (
        F.when(
            F.col("success") & F.coalesce("has_changes", F.lit(False)),
            F.concat(F.lit("Changes detected: "), F.col("summary")),
        )
        .when(F.col("success"), "No changes detected")
        .otherwise(F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("Processing failed")))
    )
    return results.select(
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unnamed Target")).alias("name"),
        "url",
        F.when(F.col("success"), "success").otherwise("failed").alias("status"),
        message.alias("message"),
    )


def duration_stats(timings: DataFrame, name: str, value: str) -> DataFrame:
    """Count, average, minimum and maximum per timer name."""
    return timings.groupBy(name).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
