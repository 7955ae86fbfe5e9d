"""SimHash near-duplicates by the generalised pigeonhole principle.

64 bits are grouped into four parts of 16 so that correlated bits share a part (covariance over
all different fingerprints).  For a distance of t a fingerprint gets thresholds of -1 to t for its
parts that add up to t - 3: a neighbour must then lie within the threshold in one part at least.
Dynamic programming picks the thresholds with the least estimated work, from the number of
fingerprints within each radius of each part value and the number of probes.  Fingerprints are
dealt to the buckets of their part values, probes to the buckets around them; a bucket compares
its probes with its members and hands on a spanning forest of the links, never all pairs.
Buckets of many rows are cut into blocks that meet pairwise in tasks of their own.

Defined cases: a null text has no words, and a text without words the fingerprint zero, which is
linked like any other; texts of fewer words than a shingle are one shingle.  Rows may repeat.
A null ``doc_id`` keeps its row and never names a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, columns_of, partitions, prepare, table, utf8, written
from .graph import connected

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
#: A probe row costs about as much as comparing so many fingerprints.
PROBE_COST = 1000
#: Rows of a bucket that one task compares with as many others.
BLOCK = 8192
#: Buckets up to this size are compared as whole columns.
SMALL = 16


# --- fingerprints ----------------------------------------------------------------------------

def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned: a bit is 1 if it is set in over half of the shingle hashes (XXH64, seed 42)."""
    found = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(found) > words:
        spans = zip(starts[: 1 - words].tolist() if words > 1 else starts.tolist(), ends[words - 1:].tolist())
    else:
        spans = iter([(0, len(joined))])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        block = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id text_hash fp``: the fingerprint of each text as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints = np.array([fingerprint(t, words) for t in utf8(batch.column(2))], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "fp"]
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return arrow_map(rows, run, "doc_id long, text_hash long, fp long")


# --- parts and thresholds --------------------------------------------------------------------

def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(prints: DataFrame) -> list[list[int]]:
    """The 64 bits in four groups of 16 of correlated bits, by the counts of all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = _bits(_prints(batch)).astype(np.float64)
            gram += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.triu_indices(BITS)
        if n:
            columns = [np.append(i, BITS), np.append(j, BITS), np.append(gram[i, j], n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n"])

    counts = prints.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(
        F.sum("n").alias("n")
    ).collect()  # 2081 rows at any size
    gram, n = np.zeros((BITS, BITS)), 1
    for r in counts:
        if r["i"] == BITS:
            n = r["n"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["n"]
    share = np.diag(gram) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs((gram / n - np.outer(share, share)) / np.outer(spread, spread))
    free, groups = set(range(BITS)), []
    for _ in range(PARTS):
        first = max(sorted(free), key=lambda b: sum(sorted((close[b, x] for x in free if x != b))[-WIDTH:]))
        group = [first]
        free.discard(first)
        while len(group) < WIDTH:
            best = max(sorted(free), key=lambda b: close[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(group)
    return groups


def part_values(prints: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(n, parts) of 16-bit values."""
    bits = _bits(prints)
    return np.stack([
        np.ascontiguousarray(np.packbits(bits[:, g], axis=1, bitorder="little")).view(np.uint16).reshape(-1)
        for g in groups
    ], axis=1).astype(np.int64)


def radius_counts(prints: DataFrame, groups: list[list[int]], most: int) -> np.ndarray:
    """(parts, values, most + 1): fingerprints whose part lies within each radius of a value."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = part_values(_prints(batch), groups)
        keys, n = np.unique(values + (np.arange(PARTS) << WIDTH), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["k", "n"])

    # At most 4 x 65536 rows, whatever the number of fingerprints.
    found = arrow_map(prints.select("fp"), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    pairs = found.toPandas()
    exact = np.zeros(PARTS << WIDTH, np.int64)
    exact[pairs["k"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    at = np.zeros((most + 1, PARTS, 1 << WIDTH), np.int64)
    at[0] = exact.reshape(PARTS, -1)
    index = np.arange(1 << WIDTH)
    for b in range(WIDTH):  # at[r]: so far r of the first b bits differ
        for r in range(most, 0, -1):
            at[r] += at[r - 1][:, index ^ (1 << b)]
    return np.cumsum(at, axis=0).transpose(1, 2, 0)


def balls(most: int) -> list[np.ndarray]:
    """Masks of up to 0, 1, ... differing bits of a part."""
    out = [np.zeros(1, np.int64)]
    for r in range(1, most + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(WIDTH), r)]
        out.append(np.concatenate([out[-1], np.array(masks, np.int64)]))
    return out


def thresholds(within: np.ndarray, values: np.ndarray, distance: int) -> np.ndarray:
    """(n, parts) of thresholds that add up to ``distance`` - parts + 1, of least estimated work.

    Dynamic programming over the parts; the state is what the parts so far add up to.
    """
    n, choices = len(values), list(range(-1, distance + 1))
    probes = [0] + [len(b) for b in balls(distance)]
    best = {0: np.zeros(n)}
    back: list[dict[int, np.ndarray]] = []
    for p in range(PARTS):
        near = within[p][values[:, p]]
        after: dict[int, np.ndarray] = {}
        took: dict[int, np.ndarray] = {}
        for total, cost in best.items():
            for t in choices:
                more = 0 if t < 0 else near[:, t] + PROBE_COST * (probes[t + 1] - 1)
                new, key = cost + more, total + t
                if key not in after:
                    after[key], took[key] = new, np.full(n, t)
                else:
                    less = new < after[key]
                    after[key] = np.where(less, new, after[key])
                    took[key] = np.where(less, t, took[key])
        best = after
        back.append(took)
    out = np.zeros((n, PARTS), np.int64)
    left = np.full(n, distance - PARTS + 1)
    for p in range(PARTS - 1, -1, -1):
        keys = np.array(sorted(back[p]))
        stack = np.stack([back[p][k] for k in keys])
        out[:, p] = stack[np.searchsorted(keys, left), np.arange(n)]
        left = left - out[:, p]
    return out


# --- probe and verify ------------------------------------------------------------------------

def bucket_rows(prints: DataFrame, groups, within: np.ndarray, distance: int) -> DataFrame:
    """``bucket fp active``: each fingerprint in its four buckets, and its probes around them."""
    masks = balls(distance)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = _prints(batch)
        values = part_values(fps, groups)
        limits = thresholds(within, values, distance)
        keys, who, active = [], [], []
        for p in range(PARTS):
            keys.append(values[:, p] + (p << WIDTH))
            who.append(np.arange(len(fps)))
            active.append(limits[:, p] >= 0)
            for t in range(1, distance + 1):
                mine = np.flatnonzero(limits[:, p] == t)
                around = masks[t][1:]
                keys.append((values[mine, p][:, None] ^ around[None, :]).ravel() + (p << WIDTH))
                who.append(np.repeat(mine, len(around)))
                active.append(np.ones(len(mine) * len(around), bool))
        k, w, a = map(np.concatenate, (keys, who, active))
        for i in range(0, len(k), 1 << 17):
            part = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[part]), pa.array(fps[w[part]].view(np.int64)), pa.array(a[part])],
                names=["bucket", "fp", "active"],
            )

    return arrow_map(prints.select("fp"), run, "bucket long, fp long, active boolean")


def _spanning(fps: np.ndarray, active: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between an active row and any other."""
    left, out = np.arange(len(fps)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        root = fps[frontier[0]]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            if not active[at]:
                near &= active[left]
            found = left[near]
            if len(found):
                left = left[~near]
                frontier.extend(found.tolist())
                out.extend((root, f) for f in fps[found])
    return out


def _verified(keys: np.ndarray, fps: np.ndarray, active: np.ndarray, distance: int):
    """Links of whole buckets, whose rows stand together."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    a, b = [], []
    small = np.flatnonzero(size_of <= SMALL)
    k, f, on = keys[small], fps[small], active[small]
    for step in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        near = (k[step:] == k[:-step]) & (on[step:] | on[:-step])
        near &= np.bitwise_count(f[step:] ^ f[:-step]) <= distance
        a.append(f[step:][near])
        b.append(f[:-step][near])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        pairs = _spanning(fps[s : s + n], active[s : s + n], distance)
        a.append(np.array([x for x, _ in pairs], np.uint64))
        b.append(np.array([y for _, y in pairs], np.uint64))
    x, y = np.concatenate(a or [fps[:0]]), np.concatenate(b or [fps[:0]])
    pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1)[x != y], axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``a b``: links that connect all fingerprints (``fp``, each once) at ``distance`` or less."""
    groups = bit_groups(prints)
    rows = bucket_rows(prints, groups, radius_counts(prints, groups, distance), distance)
    large = rows.groupBy(F.col("bucket").alias("large")).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    ).where("blocks > 1")
    met = rows.join(large, F.col("bucket") == F.col("large"), "left").select(
        "bucket", "fp", "active", F.coalesce("blocks", F.lit(1)).alias("blocks")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other),
    ))
    dealt = met.select("bucket", pair.alias("pair"), "fp", "active").repartition(
        partitions(prints.sparkSession), "bucket", "pair"
    ).sortWithinPartitions("bucket", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key = new[0].astype(np.int64) << 32 | new[1].astype(np.int64)
            now = (key, new[2].view(np.uint64), new[3].astype(bool))
            held = now if held is None else tuple(map(np.concatenate, zip(held, now)))
            end = int(np.flatnonzero(np.r_[True, held[0] != held[0][-1]])[-1])  # the last bucket may go on
            done, held = tuple(x[:end] for x in held), tuple(x[end:] for x in held)
            if end:
                yield from batch_of(done)
        if held is not None and len(held[0]):
            yield from batch_of(held)

    def batch_of(rows) -> Iterator[pa.RecordBatch]:
        a, b = _verified(*rows, distance)
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id text_hash fp component component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    ``component`` is a fingerprint of the component, ``component_id`` its smallest ``doc_id``.
    """
    rows = written(fingerprints(docs, words), "simhash")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(prints.select("fp"), distance), "simhash")
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("print"), "least", F.coalesce("root", "fp").alias("component")
    )
    least = named.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    of = named.join(least, F.col("component") == F.col("of")).select("print", "component", "component_id")
    return rows.join(of, F.col("fp") == F.col("print")).drop("print")


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: that of the smallest ``doc_id``."""
    return one_of_each_component(docs, near_duplicates(docs, words, distance), "simhash-stay")


def one_of_each_component(docs: DataFrame, named: DataFrame, purpose: str) -> DataFrame:
    """One row of ``docs`` of each ``component`` of ``named`` (``doc_id text_hash component``).

    A null ``doc_id`` comes last; of rows that share it the one with the smaller text hash stays,
    of equal rows any.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    stay = written(named.groupBy("component").agg(
        F.min(F.struct(key.alias("__id"), F.col("text_hash").alias("__text"))).alias("s")
    ).select("s.*"), purpose)
    rows = docs.select("*", key.alias("__key"), F.xxhash64("text").alias("__hash"))
    kept = rows.join(stay, (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__text")), "left_semi")
    return kept.dropDuplicates(["__key", "__hash"]).select(*columns_of(docs))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
