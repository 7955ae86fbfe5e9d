"""Repeated word sequences by prefix-partitioned suffix trees.

Suffixes are dealt to groups by a prefix, the anchor of :mod:`.repeats`; a group that would be too
large for a task goes on by a longer prefix, the whole window.  The tree of a group is kept as its
sorted suffixes with the lengths of the common prefixes: an inner node is a run of suffixes with a
common prefix, and the uppermost nodes of 13 words or more hold all suffixes that repeat a window.

Defined cases: a null text has no words; documents of fewer than 13 words have no window; rows may
repeat and are treated alike, as one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table, utf8
from .repeats import FIRST_ID, Kind, applied, covered, keyed, spans

KIND = Kind(window=13, gram=5, words=True)


def suffix_tree(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(``starts`` in tree order, words shared with the one before, up to ``depth``).

    Ranks by one, two, four ... words until ``depth`` is reached.
    """
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    powers = [rank]
    have = 1
    while have < depth:
        step = min(have, depth - have)
        key = rank << 32
        key[: len(rank) - step] |= rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        have += step
        powers.append(rank)
    order = starts[np.argsort(rank[starts], kind="stable")]
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    size = [1]
    while size[-1] < depth:
        size.append(min(2 * size[-1], depth))
    for have, ranks in zip(reversed(size), reversed(powers)):
        # Both suffixes move on by what they share; stretches may overlap by less than depth.
        fits = (common[1:] + have <= depth) & (np.maximum(a, b) < len(ranks))
        same = fits & (ranks[np.minimum(a, len(ranks) - 1)] == ranks[np.minimum(b, len(ranks) - 1)])
        common[1:][same] += have
        a[same] += have
        b[same] += have
    return order, common


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the uppermost node of ``depth`` words or more that each suffix is below."""
    return np.cumsum(common < depth)


def earlier(values: np.ndarray, n: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of all windows of all contexts: does the same window start in a smaller document?"""
    depth = KIND.window
    sizes = n + depth - 1
    text = values
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[owner] + step  # suffixes of 13 words end within their context
    order, common = suffix_tree(text, starts, depth)
    node = deep_nodes(common, depth) - 1
    who = np.empty(len(text), np.int64)
    who[starts] = doc[owner]
    smallest = np.minimum.reduceat(who[order], np.flatnonzero(np.diff(np.r_[-1, node])))
    out = np.empty(len(text), bool)
    out[order] = who[order] > smallest[node]
    return out[starts]


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def without_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id n_words n_removed kept_sha256 kept`` of each row of ``docs`` (``doc_id``, ``text``)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc, text, found in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            words = text.split()  # bytes: the six ASCII blanks
            rest = words
            if found:
                rest = [w for w, gone in zip(words, covered(len(words), found).tolist()) if not gone]
            kept = b" ".join(rest)
            out.append((
                None if doc == FIRST_ID else doc, len(words), len(words) - len(rest),
                hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None,
            ))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")])

    rows = keyed(docs)
    return applied(rows, spans(rows, KIND, "suffix-tree", earlier, within=False), run, SCHEMA)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return without_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


OP6_SQL = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
win as (select doc_id, generate_subscripts(ks, 1) as i, unnest(ks) as k from (
 select doc_id, list_transform(generate_series(1, len(l) - 12), lambda i: array_to_string(l[i:i + 12], ' ')) as ks
 from w where len(l) >= 13)),
firsts as (select k, min(doc_id) as f from win group by k),
gone as (select distinct doc_id, i + j as p from (select doc_id, i from win join firsts using (k) where f < doc_id) b,
 (select unnest(generate_series(0, 12)) as j) t),
words as (select doc_id, generate_subscripts(l, 1) as p, unnest(l) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from words x
 where not exists (select 1 from gone g where g.doc_id = x.doc_id and g.p = x.p) group by doc_id)
select w.doc_id, len(l) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
left join (select doc_id, count(*) as n from gone group by doc_id) g on g.doc_id = w.doc_id"""
