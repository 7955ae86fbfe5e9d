"""Periodic run detection: stretches of words that repeat with a period, by minimizers of many scales.

A run is a stretch whose smallest period is ``q``, of at least four periods and six words, which no
neighbouring word extends.  Periods below ``SHORT`` come from a direct comparison of the words at
each lag.  For longer ones there is a scale for each doubling: periods from ``W`` to ``2 W - 1``
are looked for with grams of ``2 W`` words and windows of ``W`` grams.  Within a run, grams at least
as long as the period are different at all distances below it, and a window and the same window one
period on hold the same grams; so the minimum of the one comes back in the other, and is the next
place with that gram: every run has a pair of equal neighbouring minimizers at the distance of its
period.  Such pairs seed an extension to both sides, by steps of halving length over the hashes of
all grams of 1, 2, 4, ... words.  What is found is compared word by word before it counts.

Documents of a batch that are about equally long are scanned as one array, with a mark of its own
after each document.  Memory is about ``8 log2(words)`` bytes a word of the longest document or of
``WORDS_AT_ONCE`` words.

Defined cases: a null, empty or blank text has no words and no runs, its lists are empty texts.
Documents are judged one by one, so repeated rows, ids and nulls change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, prepare, table

#: Periods below this are compared lag by lag; a power of two.
SHORT = 8
#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Documents are scanned together up to so many words.
WORDS_AT_ONCE = 1 << 18


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two neighbouring grams; wraps around."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(marked: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the grams of 1, 2, 4, ... words from each place on, up to ``longest`` words."""
    out = [_mixed(marked.astype(np.uint64), np.uint64(1))]
    reach = 1
    while 2 * reach <= longest:
        # What reaches beyond the last mark holds it, so it is equal to nothing.
        on = np.concatenate([out[-1][reach:], np.zeros(min(reach, len(marked)), np.uint64)])
        out.append(_mixed(out[-1], on))
        reach *= 2
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` (a power of two) values from a place on, or fewer at the end."""
    out, reach = values.copy(), 1
    while reach < min(width, len(out)):
        out[:-reach] = pick(out[:-reach], out[reach:])
        reach *= 2
    return out


def _minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places whose gram is the least of a window of grams that holds it; equal ones all count."""
    least = _sliding(grams, window, np.minimum)
    # The window that starts at a place or up to window - 1 before it and has the largest minimum.
    before = np.concatenate([np.zeros(window - 1, np.uint64), least])
    return np.flatnonzero(_sliding(before, window, np.maximum)[: len(grams)] == grams)


def _at_lag(marked: np.ndarray, lag: int) -> np.ndarray:
    """``start length period`` of what repeats with this lag, compared directly."""
    equal = marked[lag:] == marked[:-lag]
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    start, length = edges[::2], edges[1::2] - edges[::2] + lag
    enough = length >= max(LEAST_WORDS, LEAST_PERIODS * lag)
    start, length = start[enough], length[enough]
    return np.column_stack([start, length, np.full(len(start), lag)])


def _at_scale(marked: np.ndarray, hashes: list[np.ndarray], scale: int) -> np.ndarray:
    """``start length period`` of runs with periods from ``scale`` to twice as much."""
    grams = hashes[scale.bit_length()]
    places = _minimizers(grams, scale)
    order = np.argsort(grams[places], kind="stable")
    places = places[order]
    lag = np.diff(places)
    seed = (np.diff(grams[places]) == 0) & (lag >= scale) & (lag < 2 * scale)
    at, lag = places[:-1][seed], lag[seed]
    if not len(at):
        return np.empty((0, 3), np.int64)
    on, back = at.copy(), at.copy()
    for m in reversed(range(len(hashes))):
        h = hashes[m]
        on += np.where(h[on] == h[on + lag], 1 << m, 0)
        low = np.maximum(back - (1 << m), 0)
        back = np.where((back >= 1 << m) & (h[low] == h[low + lag]), low, back)
    length = on - back + lag
    enough = length >= LEAST_PERIODS * lag
    found = _different(np.column_stack([back, length, lag])[enough])
    # Hashes proposed them, the words decide.
    sure = [np.array_equal(marked[s : s + n - q], marked[s + q : s + n]) for s, n, q in found]
    if not all(sure):
        found = np.concatenate([_at_lag(marked, q) for q in np.unique(found[:, 2])])
    return found


def _different(found: np.ndarray) -> np.ndarray:
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.diff(found, axis=0, prepend=-1).any(axis=1)]


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``document start length period`` of all runs, ordered so by document, start and period.

    ``words`` are numbers, equal for equal words; documents of ``sizes`` words lie one after another.
    """
    ends = np.cumsum(sizes)
    marked = np.insert(words.astype(np.int64), ends, -1 - np.arange(len(sizes)))
    longest = int(sizes.max(initial=0))
    found = [_at_lag(marked, q) for q in range(1, SHORT) if longest >= max(LEAST_WORDS, LEAST_PERIODS * q)]
    if longest >= LEAST_PERIODS * SHORT:
        hashes = _grams(marked, longest)
        scale = SHORT
        while LEAST_PERIODS * scale <= longest:
            found.append(_at_scale(marked, hashes, scale))
            scale *= 2
    whole = np.concatenate([np.empty((0, 3), np.int64), *found]).astype(np.int64)
    whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
    # A multiple of a period gives the same stretch: the smallest one counts.
    whole = whole[np.diff(whole[:, :2], axis=0, prepend=-1).any(axis=1)]
    starts = ends - sizes + np.arange(len(sizes))
    document = np.searchsorted(starts, whole[:, 0], side="right") - 1
    whole[:, 0] -= starts[document]
    return np.column_stack([document, whole])[np.lexsort((whole[:, 2], whole[:, 0], document))]


# --- documents ---------------------------------------------------------------------------------

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Documents scanned together: of the same size up to a factor of two, so many words at once."""
    kinds = np.frexp(sizes)[1]
    for kind in np.unique(kinds):
        some = np.flatnonzero(kinds == kind)
        part = (np.cumsum(sizes[some]) - 1) // WORDS_AT_ONCE
        for p in np.unique(part):
            yield some[part == p]


def _scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    # The blanks at which bytes are split are the six ASCII ones.
    words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
    sizes = np.array([len(w) for w in words], np.int64)
    runs: list[list] = [[] for _ in words]
    for some in _groups(sizes):
        numbers = pa.array([w for i in some for w in words[i]], pa.binary()).dictionary_encode().indices.to_numpy()
        for document, start, length, period in runs_of(numbers, sizes[some]).tolist():
            runs[some[document]].append({"start": start, "length": length, "period": period})
    kept = []
    for mine, found in zip(words, runs):
        if found:
            drop = np.zeros(len(mine) + 1, np.int64)
            for r in found:
                drop[r["start"] + r["period"]] += 1
                drop[r["start"] + r["length"]] -= 1
            mine = [mine[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
        kept.append(b" ".join(mine))
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id n_words runs collapsed``: the runs by start and period, and the text without repeats.

    Of a run the words of its first period stay; kept words are joined by one blank.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, RUNS)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, of which one in ten goes on from some word on with the words it has from there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
        ), " ")

    # One element: the words are split once.
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)))[0]
    return F.when(h % 10 == 0, F.coalesce(changed, F.lit(""))).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_join(lines, "").alias("lines"), "collapsed",
        best.alias("best"),
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
