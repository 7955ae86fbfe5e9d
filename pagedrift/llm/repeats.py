"""What the two removers of repeated passages share: tiles of windows, and spans from them.

Every document falls into *tiles*: runs of window starts whose windows share their least hashed
gram (the *anchor*), the leftmost one where it occurs twice.  Which tile a window belongs to
depends on the window alone, so equal windows have equal anchors.  So:

1. count the anchors and keep the tiles whose anchor occurs again;
2. tiles of equal content (a *class*) repeat the first of them as a whole;
3. where an anchor has several classes, their first tiles may share some windows: their texts are
   fetched, dealt by anchor, and the caller's ``expand`` finds the shared windows among them;
4. the spans go back to the documents.

Texts cross the network once, grams and tiles as a few longs.  An anchor with more than
``MOST_CLASSES`` classes is dealt by whole windows instead, so no task needs all of it; a class of
any size is met by partial aggregates and by a join that may be split.

A place is (doc_id, 64-bit hash of the text, start); the first two name a row in all joins.  A null ``doc_id`` comes before all others; rows that
share a ``doc_id`` come in the order of a hash of their text, and equal rows share their places.
Hashes have 64 bits for anchors and 64 more for contents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, utf8, written

PIECE = 1 << 17  # units worked on at a time: what fits a core's cache
MOST_CLASSES = 6000
FIRST_ID = -(1 << 63)
#: Bits of a place: the start, where the anchor is of 7, number of windows of 8.
START, ANCHOR = 15, 8

_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_SALT = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(256, dtype=np.uint64) + _SALT)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE + 1024)
        _POWERS[:] = [
            np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b, np.uint64))])
            for b in (_BASE, _BACK)
        ]
    return _POWERS[0], _POWERS[1]


class Sums:
    """Hashes of any stretch of a row of values, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        power, self.back = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[at]


@dataclass(frozen=True)
class Kind:
    """``window``: units that make a repeat; ``gram``: units of an anchor."""

    window: int
    gram: int
    words: bool

    def values(self, data: bytes) -> np.ndarray:
        """A 64-bit value for each unit."""
        if self.words:
            found = data.split()
            return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        return _BYTES[np.frombuffer(data, np.uint8)]


def least(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least value of each window of ``width`` is."""
    value, at, have = (grams >> np.uint64(32)).astype(np.uint32), np.arange(len(grams), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def tiles(values: np.ndarray, sizes: np.ndarray, kind: Kind):
    """(start, number of windows, anchor, hash of the content, where in the tile the anchor is) of
    the tiles of pieces put end to end."""
    none = np.zeros(0, np.int64)
    if len(values) < kind.window:
        return none, none, none.view(np.uint64), none.view(np.uint64), none
    sums, k = Sums(values), kind.gram
    grams = mix(sums.of(slice(None, -k), slice(k, None), slice(len(values) - k + 1)))
    at = least(grams, kind.window - k + 1)
    ends = np.cumsum(sizes)
    last = np.repeat(ends, sizes)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + kind.window <= last)
    if not len(starts):
        return none, none, none.view(np.uint64), none.view(np.uint64), none
    at = at[starts]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)])
    start = starts[first]
    end = start + n + kind.window - 1
    other = Sums(mix(values ^ _SALT))
    content = mix(sums.of(start, end, start) + mix(other.of(start, end, start) + n.view(np.uint64)))
    return start, n, grams[at[first]], content, at[first] - start


def pieces(texts: list[bytes], kind: Kind):
    """Texts put end to end up to a size; long ones are cut so that every window is in a piece.

    Yields (values, sizes, row of each piece, where in its text it starts).
    """
    held, rows, offsets, total = [], [], [], 0
    for row, text in enumerate(texts):
        values = kind.values(text)
        for offset in range(0, max(1, len(values) - kind.window + 1), PIECE):
            part = values[offset : offset + PIECE + kind.window - 1]
            if len(part) < kind.window:
                continue
            held.append(part)
            rows.append(row)
            offsets.append(offset)
            total += len(part)
            if total >= PIECE:
                yield np.concatenate(held), np.array([*map(len, held)]), np.array(rows), np.array(offsets)
                held, rows, offsets, total = [], [], [], 0
    if held:
        yield np.concatenate(held), np.array([*map(len, held)]), np.array(rows), np.array(offsets)


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc tag text``: the id without nulls, a 64-bit text hash, the text without nulls."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"),
        F.xxhash64(text).alias("tag"),
        text.alias("text"),
    )


def _repeated_tiles(rows: DataFrame, kind: Kind, purpose: str) -> DataFrame:
    """``anchor tile doc tag place`` of the tiles whose anchor occurs more than once.

    The anchors are written first: a join of two plain shuffles may be split at a hot one.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for values, sizes, _, _ in pieces(utf8(batch.column(0)), kind):
            anchor, n = np.unique(tiles(values, sizes, kind)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays(_longs(anchor, n), names=["again", "n"])

    def all_tiles(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(1).to_numpy(zero_copy_only=False)
        texts = utf8(batch.column(2))
        for values, sizes, row, offset in pieces(texts, kind):
            start, n, anchor, content, inside = tiles(values, sizes, kind)
            ends = np.cumsum(sizes)
            piece = np.searchsorted(ends, start, "right")
            at = start - (ends - sizes)[piece] + offset[piece]
            place = (at << START) | (inside << ANCHOR) | n
            yield pa.RecordBatch.from_arrays(
                _longs(anchor, content, docs[row[piece]], tags[row[piece]], place),
                names=["anchor", "tile", "doc", "tag", "place"],
            )

    again = written(arrow_map(rows.select("text"), count, "again long, n long").groupBy("again").agg(
        F.sum("n").alias("n")
    ).where("n > 1").select("again"), f"{purpose}-anchors")
    schema = "anchor long, tile long, doc long, tag long, place long"
    found = arrow_map(rows.select("doc", "tag", "text"), all_tiles, schema)
    return found.join(again, F.col("anchor") == F.col("again")).drop("again")


def spans(rows: DataFrame, kind: Kind, purpose: str, expand: Callable[..., np.ndarray], within: bool) -> DataFrame:
    """``doc tag spans``: stretches of units covered by a window that also starts earlier.

    ``expand(values, n, doc, tag, place)`` gets contexts of ``n`` windows each put end to end, and returns
    for all their windows whether an earlier place starts the same one.  ``within``: an earlier
    start in the same document counts; otherwise only other documents do.
    """
    size = kind.window
    same = written(_repeated_tiles(rows, kind, purpose), f"{purpose}-tiles")
    first = written(same.groupBy("anchor", "tile").agg(F.min(F.struct("doc", "tag", "place")).alias("f")).select(
        "anchor", "tile", "f.doc", "f.tag", "f.place"
    ), f"{purpose}-first")
    several = first.groupBy(F.col("anchor").alias("of")).agg(F.count("*").alias("classes")).where("classes > 1")
    asked = first.join(several, F.col("anchor") == F.col("of")).groupBy("doc", "tag").agg(F.collect_list(F.struct(
        "anchor", "tile", "place", (F.col("classes") > MOST_CLASSES).alias("hot")
    )).alias("asked"))
    shared = _shared(_contexts(rows, asked, kind), kind, expand).groupBy(
        F.col("anchor").alias("s_anchor"), F.col("tile").alias("s_tile")
    ).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    named = first.select(
        F.col("anchor").alias("f_anchor"), F.col("tile").alias("f_tile"),
        F.col("doc").alias("f_doc"), F.col("tag").alias("f_tag"), F.col("place").alias("f_place"),
    ).join(shared, (F.col("f_anchor") == F.col("s_anchor")) & (F.col("f_tile") == F.col("s_tile")), "left")
    at = F.shiftright("place", START)
    n = F.col("place").bitwiseAND((1 << ANCHOR) - 1)
    is_first = F.col("doc") == F.col("f_doc")
    if within:
        is_first = is_first & (F.col("tag") == F.col("f_tag")) & (F.col("place") == F.col("f_place"))
    span = lambda lo, hi: F.struct((at + lo).alias("start"), (at + hi + (size - 1)).alias("end"))
    own = F.transform("ranges", lambda r: span(r["lo"], r["hi"]))
    return same.join(named, (F.col("anchor") == F.col("f_anchor")) & (F.col("tile") == F.col("f_tile"))).where(
        ~is_first | F.col("ranges").isNotNull()
    ).select(
        F.col("doc").alias("of"), F.col("tag").alias("of_tag"),
        F.explode(F.when(is_first, own).otherwise(F.array(span(F.lit(0), n)))).alias("span"),
    ).groupBy("of", "of_tag").agg(F.collect_list("span").alias("spans"))


def _contexts(rows: DataFrame, asked: DataFrame, kind: Kind) -> DataFrame:
    """``key hot anchor tile doc tag place lo data``: the values of the tiles asked for, or of each
    window of those whose anchor is hot."""
    few = asked.select(F.col("doc").alias("of"), F.col("tag").alias("of_tag"), "asked")
    # Equal rows are one place: a text is fetched once, however many rows have it.
    joined = rows.join(few, (F.col("doc") == F.col("of")) & (F.col("tag") == F.col("of_tag"))).dropDuplicates(["doc", "tag"])
    names = ["key", "hot", "anchor", "tile", "doc", "tag", "place", "lo", "data"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for doc, tag, text, tiles_ in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()
        ):
            values = kind.values(text) if kind.words else np.frombuffer(text, np.uint8)
            for tile in tiles_:
                start = tile["place"] >> START
                n = tile["place"] & ((1 << ANCHOR) - 1)
                for lo, many in ((i, 1) for i in range(n)) if tile["hot"] else ((0, n),):
                    part = values[start + lo : start + lo + many + kind.window - 1].tobytes()
                    key = xxhash.xxh64_intdigest(part) - (1 << 63) if tile["hot"] else tile["anchor"]
                    for column, x in zip(out, (
                        key, tile["hot"], tile["anchor"], tile["tile"], doc, tag, tile["place"], lo, part
                    )):
                        column.append(x)
            if len(out[0]) > 20_000:
                yield _context_batch(out)
                out = [[] for _ in names]
        if out[0]:
            yield _context_batch(out)

    def _context_batch(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_()] + [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    schema = "key long, hot boolean, anchor long, tile long, doc long, tag long, place long, lo long, data binary"
    return arrow_map(joined.select("doc", "tag", "text", "asked"), run, schema)


#: Units of contexts that are searched at a time.
BLOCK = 1 << 20
#: Parts of a tile by how much of a window lies before the anchor.
BINS = 4


def _likely(values: np.ndarray, sizes: np.ndarray, inside: np.ndarray, kind: Kind):
    """(values, number of windows, which context, windows left out at its start) of the stretches of
    contexts that can hold a shared window.

    The windows of a bin all hold the anchor with a certain stretch around it; a window can only be
    shared if that stretch is.
    """
    n = sizes - kind.window + 1
    begin = np.cumsum(sizes) - sizes
    rest = kind.window - kind.gram
    step = -(-(rest + 1) // BINS)
    sums = Sums(values if kind.words else _BYTES[values])
    low, high = np.full(len(n), 1 << 30), np.zeros(len(n), np.int64)
    for b in range(BINS):
        before, most = b * step, min(rest, (b + 1) * step - 1)
        # Windows r of this bin: inside - r within [before, most].
        first, last = np.maximum(0, inside - most), np.minimum(n - 1, inside - before)
        has = np.flatnonzero((first <= last) & (before <= most))
        if not len(has):
            continue
        start = begin[has] + inside[has] - before
        end = begin[has] + inside[has] + kind.gram + (rest - most)
        key = sums.of(start, end, start)
        order = np.argsort(key)
        k = key[order]
        twin = np.r_[False, k[1:] == k[:-1]] | np.r_[k[1:] == k[:-1], False]
        mine = has[order[twin]]
        low[mine] = np.minimum(low[mine], first[mine])
        high[mine] = np.maximum(high[mine], last[mine] + 1)
    which = np.flatnonzero(low < high)
    skip, n = low[which], (high - low)[which]
    size = n + kind.window - 1
    at = np.arange(int(size.sum())) + np.repeat(begin[which] + skip - (np.cumsum(size) - size), size)
    return values[at], n, which, skip


def _shared(contexts: DataFrame, kind: Kind, expand) -> DataFrame:
    """``anchor tile lo hi``: runs of windows of a context that an earlier one shares."""
    dealt = contexts.repartition(partitions(contexts.sparkSession), "key").sortWithinPartitions(
        "key", "hot", "doc", "tag", "place", "lo"
    )
    unit = np.uint64 if kind.words else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield from search(held)
                    held, size = [], 0
                elif size >= 3 * BLOCK and row[1]:  # whole windows of one key: the first stands for all
                    yield from search(held)
                    held = [next(r for r in held if r[0] == row[0])]
                    size = len(held[0][-1])
                held.append(row)
                size += len(row[-1]) // unit().itemsize
        if held:
            yield from search(held)

    def search(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*held))
        values = np.frombuffer(b"".join(columns[-1]), unit)
        anchor, tile, doc, tag, place, lo = (np.array(c, np.int64) for c in columns[2:-1])
        sizes = np.array([*map(len, columns[-1])], np.int64) // unit().itemsize
        values, n, which, skip = _likely(values, sizes, (place >> ANCHOR & 127) - lo, kind)
        if not len(which):
            return
        anchor, tile, doc, tag, place, lo = (c[which] for c in (anchor, tile, doc, tag, place, lo))
        lo = lo + skip
        found = expand(values, n, doc, tag, (place >> START << START) + (lo << START))
        edges = np.flatnonzero(np.diff(np.r_[0, found.astype(np.int8), 0]))
        # A run of shared windows is cut where a context ends.
        starts = np.cumsum(n) - n
        inside = starts[1:][found[starts[1:]] & found[starts[1:] - 1]] if len(starts) > 1 else starts[:0]
        begin, end = np.sort(np.r_[edges[::2], inside]), np.sort(np.r_[edges[1::2], inside])
        if len(begin):
            which = np.searchsorted(starts, begin, "right") - 1
            low = begin - starts[which] + lo[which]
            yield pa.RecordBatch.from_arrays(
                _longs(anchor[which], tile[which], low, low + (end - begin)),
                names=["anchor", "tile", "lo", "hi"],
            )

    return dealt.mapInArrow(run, "anchor long, tile long, lo long, hi long")


def covered(size: int, found: list[dict] | None) -> np.ndarray:
    """Which of ``size`` units lie in a span."""
    edges = np.zeros(size + 1, np.int64)
    for s in found or ():
        edges[s["start"]] += 1
        edges[s["end"]] -= 1
    return np.cumsum(edges[:-1]) > 0


def applied(rows: DataFrame, spans_: DataFrame, run, schema: str) -> DataFrame:
    """Each row of ``rows`` with its spans through ``run``, which takes batches ``doc text spans``."""
    joined = rows.join(spans_, (F.col("doc") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    return arrow_map(joined.select("doc", "text", "spans"), run, schema)
