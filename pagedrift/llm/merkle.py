"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A paragraph is a line, a leaf is a sentence of it with the blanks that follow.  A section ends
after a blank paragraph and after a paragraph whose hash says so, so an insertion moves no later
border.  Hashes are SHA-256 cut to 16 bytes, of different tags for leaves and inner nodes.  Equal
roots mean equal texts.  :func:`likeness` goes down from the roots: branches that are equal and in the
same order count as a whole, and only below the others it looks further; so what has moved counts
less than what has stayed.  :func:`edits` names the paragraphs that differ.

Defined cases: a null text is the empty text, which has one empty paragraph; two empty texts are
alike (1.0).  Rows may repeat; a null ``doc_id`` comes after all others, rows of one ``doc_id``
are ordered by a hash of their text.  ``edits`` compares null ids with each other, and of rows that share an id in
a table only the one with the smallest root.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, prepare, table, written

SENTENCE = re.compile(r"[^.!?]+[.!?]*[^\S\n]*|[.!?]+[^\S\n]*")
#: One paragraph in so many ends a section.
PARAGRAPHS_PER_SECTION = 16


def _leaf(text: str) -> bytes:
    return hashlib.sha256(b"\0" + text.encode()).digest()[:16]


def _node(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"\1" + b"".join(children)).digest()[:16]


class Tree:
    """``sections``: (hash, [index of its paragraphs]); ``paragraphs``: (hash, text)."""

    def __init__(self, text: str, known: dict[str, tuple[bytes, list]] | None = None):
        self.size = len(text)
        self.below: dict[str, tuple[bytes, list]] = {}
        self.paragraphs: list[tuple[bytes, str]] = []
        self.sections: list[tuple[bytes, list[int]]] = []
        open_: list[int] = []
        for i, line in enumerate(text.split("\n")):
            found = self.below.get(line) or (known or {}).get(line)
            if found is None:
                leaves = [(_leaf(s), len(s)) for s in SENTENCE.findall(line)]
                found = (_node([h for h, _ in leaves]), leaves)
            self.below[line] = found
            self.paragraphs.append((found[0], line))
            open_.append(i)
            if not line.strip() or found[0][0] % PARAGRAPHS_PER_SECTION == 0:
                self._close(open_)
                open_ = []
        if open_:
            self._close(open_)
        self.root = _node([h for h, _ in self.sections])

    def _close(self, members: list[int]) -> None:
        self.sections.append((_node([self.paragraphs[i][0] for i in members]), members))

    def weight(self, paragraph: int) -> int:
        """Characters of a paragraph and its line end."""
        return len(self.paragraphs[paragraph][1]) + 1

    def leaves(self, paragraphs: list[int]) -> list[tuple[bytes, int]]:
        """The leaves below paragraphs, in order, with their characters."""
        return [leaf for i in paragraphs for leaf in self.below[self.paragraphs[i][1]][1]]


def in_order(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of equal hashes in both lists, the most that stand in the same order.

    The n-th of a hash in the one list is held against the n-th in the other.
    """
    places: dict[bytes, list[int]] = {}
    for j in reversed(range(len(b))):
        places.setdefault(b[j], []).append(j)
    pairs = [(i, places[h].pop()) for i, h in enumerate(a) if places.get(h)]
    # The longest rising run of places in b: the least end of a run of each length, and where it came from.
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def likeness(a: Tree, b: Tree) -> float:
    """Share of the characters of both that lie in equal branches in the same order, 0 to 1."""
    if a.root == b.root:
        return 1.0
    if a.size == 0 or b.size == 0:
        return 0.0
    common, same = 0, in_order([h for h, _ in a.sections], [h for h, _ in b.sections])
    common += sum(a.weight(p) for i, _ in same for p in a.sections[i][1])
    # Only what lies between the same equal branches is held against each other.
    for mine, theirs in _between(a.sections, b.sections, same):
        left = [[p for _, members in part for p in members] for part in (mine, theirs)]
        same = in_order(*[[t.paragraphs[p][0] for p in ps] for t, ps in zip((a, b), left)])
        common += sum(a.weight(left[0][i]) for i, _ in same)
        for rest in _between(*left, same):
            leaves = [t.leaves(ps) for t, ps in zip((a, b), rest)]
            common += sum(leaves[0][i][1] for i, _ in in_order(*[[h for h, _ in x] for x in leaves]))
    # Every paragraph has a line end, the last one included.
    return 2.0 * common / (a.size + b.size + 2)


def _between(a: list, b: list, same: list[tuple[int, int]]) -> Iterator[tuple[list, list]]:
    """The parts of both lists before, between and after their equal places, where both have any."""
    i = j = 0
    for x, y in [*same, (len(a), len(b))]:
        if i < x and j < y:
            yield a[i:x], b[j:y]
        i, j = x + 1, y + 1


def edited(text: str, following: str) -> str:
    """The last half replaced by as many characters from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# --- trees as a table ------------------------------------------------------------------------

TREES = (
    "doc_id long, n_chars long, fingerprint string, sections array<struct<hash:string,"
    "paragraphs:array<struct<hash:string,start:long,length:long>>>>"
)


def _tree_row(text: str) -> list[dict]:
    tree, at, starts = Tree(text), 0, []
    for _, line in tree.paragraphs:
        starts.append(at)
        at += len(line) + 1
    return [
        {"hash": h.hex(), "paragraphs": [
            {"hash": tree.paragraphs[i][0].hex(), "start": starts[i], "length": len(tree.paragraphs[i][1])}
            for i in members
        ]}
        for h, members in tree.sections
    ]


def trees(docs: DataFrame) -> DataFrame:
    """``doc_id n_chars fingerprint sections``: the tree of each document down to paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            schema = schema or pa.schema([
                ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()),
                ("sections", pa.list_(pa.struct([("hash", pa.string()), ("paragraphs", pa.list_(
                    pa.struct([("hash", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))]))),
            ])
            rows = [
                {"doc_id": i, "n_chars": len(t), "fingerprint": Tree(t).root.hex(), "sections": _tree_row(t)}
                for i, t in zip(batch.column(0).to_pylist(), texts)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TREES)


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraphs that only one version of a document has: ``doc_id side hash start length``.

    Takes two results of :func:`trees`; documents with equal roots and sections with equal hashes
    are passed over.
    """
    def one_of_each(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.min(F.struct("fingerprint", "sections")).alias("t")).select("doc_id", "t.*")

    pair = one_of_each(before).alias("a").join(
        one_of_each(after).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    ).where(F.col("a.fingerprint") != F.col("b.fingerprint"))

    def only(mine: str, other: str) -> DataFrame:
        hashes = F.transform(F.col(f"{other}.sections"), lambda s: s["hash"])
        changed = F.filter(F.col(f"{mine}.sections"), lambda s: ~F.array_contains(hashes, s["hash"]))
        theirs = F.transform(
            F.flatten(F.transform(F.col(f"{other}.sections"), lambda s: s["paragraphs"])), lambda p: p["hash"]
        )
        found = F.filter(
            F.flatten(F.transform(changed, lambda s: s["paragraphs"])),
            lambda p: ~F.array_contains(theirs, p["hash"]),
        )
        return pair.select(
            F.col("a.doc_id").alias("doc_id"), F.lit("before" if mine == "a" else "after").alias("side"), F.inline(found)
        )

    return only("a", "b").unionByName(only("b", "a"))


# --- documents next to their edited texts ----------------------------------------------------

RESULT = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string",
    "edited_fingerprint": "string", "near_edited": "double", "near_next": "double",
    "n_sections": "long", "n_paragraphs": "long",
}
ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _compare(doc_id, text: str, following: str, tree: Tree, after: Tree) -> tuple:
    new = edited(text, following)
    changed = Tree(new, {**tree.below, **after.below})
    return (
        doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), tree.root.hex(), changed.root.hex(),
        likeness(tree, changed), likeness(tree, after),
        len(tree.sections), len(tree.paragraphs),
    )


def _batches(rows: Iterator[tuple], names: dict[str, str], at_a_time: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(c, ARROW[k]) for c, k in zip(zip(*held), names.values())]
        return pa.RecordBatch.from_arrays(arrays, names=list(names))

    for row in rows:
        held.append(row)
        if len(held) == at_a_time:
            yield batch()
            held = []
    if held:
        yield batch()


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text edited with that of the next smaller doc_id.

    Texts move once: to ranges of ``doc_id``, where a task walks down its sorted rows.  Rows that share an id
    lie in ranges of a hash of their text, and equal rows where they stood.  The first and last row of
    each range are written out and paired with those of the next range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"__h": F.xxhash64("text"), "__stood": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "__h", "__stood").sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), F.desc("__h"), "text"
    ).select("doc_id", "text")
    names = {**RESULT, "kind": "string", "part": "long", "text": "string"}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            last = None
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tree = Tree(text)
                    now = (doc_id, text, tree)
                    if last is None:
                        yield (doc_id, *[None] * (len(RESULT) - 1), "head", part, text)
                    else:
                        yield (*_compare(*last[:2], text, last[2], tree), "done", part, None)
                    last = now
            if last is not None:
                yield (last[0], *[None] * (len(RESULT) - 1), "tail", part, last[1])

        yield from _batches(rows(), names)

    done = written(dealt.mapInArrow(walk, ", ".join(f"{c} {k}" for c, k in names.items())), "merkle")
    heads = done.where(F.col("kind") == "head").select("part", F.col("text").alias("following"))
    # One row for each partition that has rows: after the last comes the first.
    order = Window.orderBy(F.desc("part"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = done.where(F.col("kind") == "head").select("part").select(
        F.col("part").alias("of"),
        F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("to"),
    )
    tails = done.where(F.col("kind") == "tail").select("doc_id", "text", "part")
    pairs = tails.join(steps, tails["part"] == steps["of"]).drop("part").join(
        heads, F.col("to") == heads["part"]
    ).select("doc_id", "text", "following")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns]):
                    yield _compare(doc_id, text, following, Tree(text), Tree(following))

        yield from _batches(rows(), RESULT)

    borders = pairs.mapInArrow(compare, ", ".join(f"{c} {k}" for c, k in RESULT.items()))
    return done.where(F.col("kind") == "done").select(*RESULT).unionByName(borders)


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return with_edits(table(spark, sf_dir, "documents"))
