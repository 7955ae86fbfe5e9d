"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens (words) to the power of an exponent, normalised.  The
exponent is bisected between 0 (all sources alike) and 1 (as they come): to the smallest one that
repeats no source more than ``max_repeats`` times, or to the one whose weights have
``target_entropy``.  The budget defaults to what gives every source one whole pass at least, so no
document is left out.  A source's budget is spent on permutations of its documents, one after the
other; the last one ends with the document that fills the budget.  Blocks of ``BLOCK_TOKENS`` words
take from each source in proportion.

Sources may be many: every pass of the bisection sums over a table of them, for 64 exponents at a
time, and the plan joins as a table.  A hot source is dealt into buckets for its running sums.

Defined cases: null is a source of its own; documents without words cost nothing and come with
every permutation; a source without words gets the whole passes that its weight of zero leaves
(one); rows may repeat, rows of one ``doc_id`` and source share whether the last permutation has
them; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded, columns_of, dealt, prepare, ranked, running, table, written

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
STEPS = 64


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, max_repeats: float | None, target_entropy: float | None) -> float:
    """Between 0 and 1; ``sources`` has ``tokens``.  Each pass narrows the range 64 times."""
    facts = sources.where("tokens > 0").agg(
        F.sum("tokens").alias("all"), F.min("tokens").alias("least"), F.max("tokens").alias("most")
    ).first()
    if not facts["all"]:
        return 1.0
    low, high = 0.0, 1.0
    while high - low > 1e-9:
        tried = [low + (high - low) * i / STEPS for i in range(1, STEPS)]
        if max_repeats is not None:
            # The largest source has the fewest passes (one), the smallest the most.
            fits = [(facts["most"] / facts["least"]) ** (1 - a) <= max_repeats for a in tried]
        else:
            share = F.col("tokens") / facts["all"]
            sums = sources.where("tokens > 0").agg(*[
                F.struct(F.sum(F.pow(share, F.lit(a))).alias("z"), F.sum(F.pow(share, F.lit(a)) * F.ln(share)).alias("l")).alias(f"a{i}")
                for i, a in enumerate(tried)
            ]).first()
            # Entropy falls as the exponent grows.
            fits = [math.log(s["z"]) - a * s["l"] / s["z"] <= target_entropy for a, s in zip(tried, sums)]
        n = fits.index(True) if True in fits else len(fits)
        low, high = (tried[n - 1] if n else low), (tried[n] if n < len(fits) else high)
    return high


def plan(narrow: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
         budget: int | None = None) -> DataFrame:
    """A row for each source: ``of tokens weight repeats whole cut_b cut_h``.

    ``narrow`` has ``doc_id source tokens``.  ``whole`` passes take every document; one more takes
    those up to (``cut_b``, ``cut_h``) in the order of :func:`dealt`.
    """
    sums = written(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    power = exponent(sums, max_repeats, target_entropy)
    facts = sums.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    every = facts["all"] or 1
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / every, F.lit(power))).otherwise(0.0)
    z = sums.agg(F.sum(raw)).first()[0] or 1.0
    if budget is None:
        largest = ((facts["most"] or 1) / every) ** power / z
        total = (facts["most"] or 1) / largest
    else:
        total = float(budget)
    weights = sums.select(
        F.col("source").alias("of"), F.col("tokens").alias("of_tokens"), (raw / z).alias("weight")
    ).withColumn(
        "repeats", F.when(F.col("of_tokens") > 0, F.lit(total) * F.col("weight") / F.col("of_tokens")).otherwise(1.0)
    ).withColumn("whole", F.floor(F.col("repeats") + 1e-9).cast("long"))
    weights = weights.withColumn(
        "rest", F.greatest(F.lit(0.0), (F.col("repeats") - F.col("whole")) * F.col("of_tokens"))
    )
    summed = running(dealt(narrow, ["doc_id", "source"]), ["source"], ["doc_id", "source"], "tokens", "before")
    last = summed.join(bounded(weights), F.col("source").eqNullSafe(F.col("of"))).where(
        F.col("before") < F.floor(F.col("rest"))
    ).groupBy(F.col("source").alias("cut_of")).agg(F.max(F.struct("__b", "__h")).alias("cut"))
    return weights.join(last, F.col("of").eqNullSafe(F.col("cut_of")), "left").select(
        "of", "of_tokens", "weight", "repeats", "whole",
        F.col("cut.__b").alias("cut_b"), F.col("cut.__h").alias("cut_h"),
    )


def with_epochs(rows: DataFrame, passes: DataFrame, name: str | None) -> DataFrame:
    """Each row of ``rows`` as often as its source's plan says; ``name`` takes the number of the pass.

    Whatever other columns ``rows`` has goes along.
    """
    few = passes.select(*[F.col(c).alias(f"__mix_{c}") for c in ("of", "whole", "cut_b", "cut_h")])
    hashed = dealt(rows, [F.col("doc_id").cast("long"), F.col("source")])
    after = F.struct(F.col("__b"), F.col("__h")) <= F.struct(F.col("__mix_cut_b"), F.col("__mix_cut_h"))
    extra = F.when(F.col("__mix_cut_b").isNotNull() & after, 1).otherwise(0)
    copies = F.col("__mix_whole") + extra
    joined = hashed.join(bounded(few), F.col("source").eqNullSafe(F.col("__mix_of"))).where(copies > 0)
    out = joined.select(*columns_of(rows), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("__epoch"))
    return out.drop("__epoch") if name is None else out.withColumnRenamed("__epoch", name)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``doc_id source epoch tokens weight block slot``: every place of every document."""
    narrow = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tokens(F.col("text")).alias("tokens")), "mix"
    )
    passes = written(plan(narrow, **options), "mix-plan")
    placed = with_epochs(narrow, passes.select("of", "whole", "cut_b", "cut_h"), "epoch")
    # The position within the pass, then within all passes of the source as a share of its budget.
    summed = running(placed, ["source", "epoch"], ["epoch", "doc_id", "source"], "tokens", "before")
    total = passes.agg(F.sum(F.col("repeats") * F.col("of_tokens"))).first()[0] or 0.0
    blocks = max(1, math.ceil(total / BLOCK_TOKENS))
    done = (F.col("epoch") * F.col("of_tokens") + F.col("before")) / F.greatest(F.col("repeats") * F.col("of_tokens"), F.lit(1.0))
    spread = summed.join(
        bounded(passes.select("of", "of_tokens", "repeats", "weight")), F.col("source").eqNullSafe(F.col("of"))
    ).select(
        "doc_id", "source", "epoch", "tokens", "weight",
        F.least(F.lit(blocks - 1), F.floor(done * blocks)).cast("long").alias("block"),
    )
    return ranked(written(spread, "mix-places"), ["block"], ["doc_id", "source", "epoch"], "slot")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mixture has them, with all their columns."""
    narrow = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tokens(F.col("text")).alias("tokens")), "mix"
    )
    return with_epochs(docs, written(plan(narrow, **options), "mix-plan"), None)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixture(table(spark, sf_dir, "documents"))
