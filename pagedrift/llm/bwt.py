"""Repeated byte strings by interval expansion on a Burrows-Wheeler transform.

The candidates of a task (see :mod:`.repeats`) are put end to end and sorted by a little more than
the least length.  From the interval of the empty string, breadth-first, each interval is extended
backwards by every byte before it; where the extended interval ends, the common prefix of the
neighbours is as long as the string before the extension, unless a shorter one is known.  So the
common prefixes come by increasing value, and the search stops at the least length: borders not
found by then lie within groups of windows that are equal.

Defined cases: a null text is empty; texts shorter than the least length have no window; rows may
repeat and are treated alike, as one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table, utf8
from .repeats import FIRST_ID, START, Kind, applied, covered, keyed, spans

KIND = Kind(window=100, gram=28, words=False)
PACKED = 7  # symbols of nine bits in the first sort key


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the first ``depth`` symbols (0 to 256) at least, by doubling."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for i in range(PACKED):
        key <<= 9
        key[: n - i] |= text[i:].astype(np.int64) + 1
    have = PACKED
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, ranked[1:] != ranked[:-1]])
        if have >= depth:
            return order
        key = rank << 32
        key[: n - have] |= rank[have:]
        have *= 2


def borders(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether a suffix shares fewer than ``least`` symbols with the one before it in ``order``."""
    n = len(text)
    last = text[order - 1].astype(np.int64)  # the transform; the text is taken as a ring
    stable = np.argsort(last, kind="stable")
    lf = np.empty(n, np.int64)
    lf[stable] = np.arange(n)
    keys = last[stable] * n + stable
    following = np.full(n, n, np.int64)  # the next place of the same symbol
    same = last[stable[1:]] == last[stable[:-1]]
    following[stable[:-1][same]] = stable[1:][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
        ends = following[at] >= high[which]
        at, which = at[ends], which[ends]
        border = lf[at] + 1
        new = ~known[border]
        at, which, border = at[new], which[new], border[new]
        known[border] = True
        low, high = np.searchsorted(keys, last[at] * n + low[which]), border
        if not len(low):
            break
    return known[:n]


def earlier(values: np.ndarray, n: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of all windows of all contexts: does the same window start at an earlier place?"""
    least = KIND.window
    sizes = n + least - 1
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    within = np.ones(len(text), bool)
    within[starts + sizes] = False  # the symbol 0 parts the contexts
    text[within] = values.astype(np.uint16) + 1
    order = sorted_suffixes(text, least + 1)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(borders(text, order, least))
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return later_in_group(group[starts[owner] + step], doc[owner], tag[owner], place[owner] + (step << START))


def later_in_group(group: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    place = place >> START
    order = np.lexsort((place, tag, doc, group))
    g, d, t, p = group[order], doc[order], tag[order], place[order]
    first = np.r_[True, g[1:] != g[:-1]]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    out = np.empty(len(group), bool)
    out[order] = (d != d[head]) | (t != t[head]) | (p != p[head])
    return out


def repeats(rows: DataFrame) -> DataFrame:
    """``of of_tag spans`` of :func:`.repeats.keyed` rows: bytes covered by a string of 100 that
    starts earlier; spans may touch and overlap."""
    return spans(rows, KIND, "bwt", earlier, within=True)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """``doc_id n_bytes n_removed n_spans kept_sha256 kept`` of each row of ``docs`` (``doc_id``, ``text``)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc, text, found in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            gone = covered(len(text), found)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if found else text
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
            out.append((
                None if doc == FIRST_ID else doc, len(text), len(text) - len(kept), runs,
                hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None,
            ))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")])

    rows = keyed(docs)
    return applied(rows, repeats(rows), run, SCHEMA)


def op5_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")
