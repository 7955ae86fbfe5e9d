"""Connected components by alternating star steps, for any degree and depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def connected(links: DataFrame, purpose: str) -> DataFrame:
    """``node root`` of every node with a link; ``links`` has the longs ``a`` and ``b``.

    Each round hangs the larger neighbours of a node, then all its smaller ones, to the smallest
    node around.  A hub's minimum is a partial aggregate and its rows join by key, where a hot key
    can be split.  Rounds end when the links no longer change; each one is written.
    """
    now = written(_tidy(links.select("a", "b")), f"{purpose}-links")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Written in between: otherwise each side of each later join would compute it again.
        after = written(_tidy(large), f"{purpose}-large")
        small = _star(after)
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        now = written(_tidy(hung), f"{purpose}-small")
        mark, before = _mark(now), mark
        if mark == before:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    raise RuntimeError(f"components still changed after {MAX_ROUNDS} rounds")


def _tidy(links: DataFrame) -> DataFrame:
    """Larger end first, no loops, each link once."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        "a <> b"
    ).distinct()


def _star(links: DataFrame) -> DataFrame:
    """The links with ``m``: the smallest of ``a`` and all its ``b``."""
    least = links.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    return links.join(least, F.col("a") == F.col("k")).select("a", "b", F.least("a", "m").alias("m"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
