"""Sharding by balanced label propagation.

Documents start dealt evenly over the shards.  Each round a group of linked documents (here: of
equal texts) counts its members by shard and picks the shards it is drawn to: the one with most
members, or as many as its size needs.  Its other members ask to move there.  Requests are granted
along circles of shards, and along chains that end where there is room, so no shard ever holds
more linked documents than its quota; the groups that are nearest to being whole go first.  Large
groups settle before small ones.  Pairs that are still cut then swap: either member may go to the
other, so pairs along a circle of shards, taken in any direction, all close at once.  Unlinked
documents fill what is left.  The law is ``rows``: the counts of any two shards differ by one at most.

Only counts by (shard, shard, level) come to the driver.  Groups are counted by partial aggregates;
the join that tells members where to go may be split at a hot group.

Defined cases: null texts form one group, as empty texts do; rows may repeat and are placed one by
one; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, prepare, ranked, table, written

SHARDS, ROUNDS, LEVELS = 24, 5, 10
#: Groups of this share of a quota and more settle first.
LARGE = 1 / 16


def quotas(wanted: dict[tuple[int, int, int], int], room: dict[int, int]) -> dict[tuple[int, int, int], int]:
    """How many requests (from, to, level) are granted; ``room`` is what each shard can still take.

    Requests into shards with room go first, and make room where they come from; then requests
    that form circles, whose shards take as many as they give.
    """
    flow: dict[int, dict[int, int]] = defaultdict(dict)
    for (a, b, _), n in wanted.items():
        flow[a][b] = flow[a].get(b, 0) + n
    granted: dict[tuple[int, int], int] = defaultdict(int)
    room = dict(room)

    def grant(steps: list[tuple[int, int]], n: int) -> None:
        for a, b in steps:
            flow[a][b] -= n
            granted[a, b] += n
            room[a] += n
            room[b] -= n

    def circle(start: int) -> list[int] | None:
        """The shortest way from ``start`` back to it."""
        came, queue = {}, [start]
        for a in queue:
            for b in sorted(x for x, n in flow.get(a, {}).items() if n):
                if b == start:
                    way = [a]
                    while way[-1] != start:
                        way.append(came[way[-1]])
                    return way[::-1]
                if b not in came:
                    came[b] = a
                    queue.append(b)
        return None

    open_ = True
    while open_:
        open_ = [(a, b) for a in sorted(flow) for b in sorted(flow[a]) if flow[a][b] and room[b] > 0]
        for a, b in open_:
            if (n := min(flow[a][b], room[b])) > 0:
                grant([(a, b)], n)
    for start in sorted(flow):
        while way := circle(start):
            steps = list(zip(way, [*way[1:], start]))
            grant(steps, min(flow[a][b] for a, b in steps))
    out = {}
    for (a, b, level), n in sorted(wanted.items(), key=lambda x: (x[0][:2], -x[0][2])):
        out[a, b, level] = take = min(n, granted[a, b])
        granted[a, b] -= take
    return out


def swaps(cut: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Of the pairs cut between two shards (the smaller one first): how many close in the second one and
    how many in the first, so that no shard gets more than ``room``.

    Two pairs of the same shards swap.  Of the others, those along a circle move on by one shard each;
    what is then left has no circles, and moves to where there is room.
    """
    out = {k: (n // 2, n // 2) for k, n in cut.items()}
    odd = {k for k, n in cut.items() if n % 2}
    room = dict(room)

    def close(a: int, b: int) -> None:
        """One pair of a and b closes in b."""
        key = (min(a, b), max(a, b))
        up, down = out[key]
        out[key] = (up + 1, down) if a < b else (up, down + 1)
        odd.discard(key)

    def neighbours(a: int) -> list[int]:
        return sorted(x if y == a else y for x, y in odd if a in (x, y))

    def circle(start: int) -> list[int] | None:
        """A way that comes back to where it was, over shards that ``start`` leads to."""
        way, seen = [start], {start: 0}
        tried: set[tuple[int, int]] = set()
        while way:
            a = way[-1]
            step = next((b for b in neighbours(a) if (min(a, b), max(a, b)) not in tried), None)
            if step is None:
                del seen[way.pop()]
                continue
            tried.add((min(a, step), max(a, step)))
            if step in seen:
                return way[seen[step]:]
            seen[step] = len(way)
            way.append(step)
        return None

    for start in sorted(room):
        while found := circle(start):
            for a, b in zip(found, [*found[1:], found[0]]):
                close(a, b)
    while move := next(((a, b) for x, y in sorted(odd) for a, b in ((x, y), (y, x)) if room[b] > 0), None):
        close(*move)
        room[move[0]] += 1
        room[move[1]] -= 1
    return out


def _swapped(linked: DataFrame, left: dict[int, int]) -> DataFrame:
    """With the cut pairs closed, as far as :func:`swaps` says."""
    pairs = linked.where("__size = 2").groupBy(F.col("group").alias("__g")).agg(
        F.min("__label").alias("__lo"), F.max("__label").alias("__hi")
    ).where("__lo < __hi")
    counted = {(r["__lo"], r["__hi"]): r["count"] for r in pairs.groupBy("__lo", "__hi").count().collect()}  # shards^2 at most
    if not counted:
        return linked
    have = _counts(linked)
    closed = [(*k, *n) for k, n in swaps(counted, {s: left[s] - have.get(s, 0) for s in left}).items()]
    allowed = linked.sparkSession.createDataFrame(closed, "__la int, __lb int, __up long, __down long")
    moves = ranked(pairs, ["__lo", "__hi"], ["__g"], "__nth").join(
        F.broadcast(allowed), (F.col("__lo") == F.col("__la")) & (F.col("__hi") == F.col("__lb"))  # shards^2 at most
    ).select("__g", F.when(F.col("__nth") < F.col("__up"), F.col("__hi")).when(
        F.col("__nth") < F.col("__up") + F.col("__down"), F.col("__lo")).alias("__to"))
    return written(linked.join(moves, F.col("group").eqNullSafe(F.col("__g")), "left").withColumn(
        "__label", F.coalesce("__to", "__label")
    ).select(*linked.columns), "shard-swapped")


def _counts(rows: DataFrame) -> dict[int, int]:
    """Rows by shard."""
    return {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}


def propagate(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``nodes`` (with ``group``, a long) and ``shard`` and ``slot``; rows differ by one at most."""
    columns = nodes.columns
    rows = written(ranked(nodes, [], columns, "__node"), "shard-nodes")
    sizes = rows.groupBy(F.col("group").alias("__g")).agg(F.count("*").alias("__size"))
    started = written(rows.join(sizes, F.col("group").eqNullSafe(F.col("__g"))).drop("__g").withColumn(
        "__label", (F.col("__node") % shards).cast("int")
    ), "shard-start")
    total = started.count()
    left = {s: total // shards + (s < total % shards) for s in range(shards)}
    quota = max(1, total // shards)
    large = max(2, int(LARGE * quota))
    done = []
    for of_level in (F.col("__size") >= large, (F.col("__size") < large) & (F.col("__size") > 1)):
        linked = started.where(of_level)
        have = _counts(linked)
        if not have:
            continue
        share = sum(have.values()) / sum(left.values())
        room = {s: min(n, math.ceil(n * share)) for s, n in left.items()}
        if any(have.get(s, 0) > room[s] for s in room):
            linked = written(_fill(linked, have, room), "shard-level")
        for _ in range(rounds):
            linked, moved = _round(linked, left, quota)
            if not moved:
                break
        linked = _swapped(linked, left)
        for s, n in _counts(linked).items():
            left[s] -= n
        done.append(linked)
    free = started.where("__size = 1")
    done.append(_fill(free, _counts(free), left))
    placed = functools.reduce(DataFrame.unionByName, done).select(*columns, "__node", F.col("__label").alias("shard"))
    return ranked(written(placed, "shard-placed"), ["shard"], ["__node"], "slot").drop("__node")


def _round(linked: DataFrame, room: dict[int, int], quota: int) -> tuple[DataFrame, int]:
    """The rows after one round, and how many moved; ``room`` is for all of them."""
    wants = written(_requests(linked, quota), "shard-wants")
    counted = wants.groupBy("__label", "__to", "__level").count().collect()  # shards^2 levels at most
    free, wanted = dict(room), {}
    for r in counted:
        free[r["__label"]] -= r["count"]
        if r["__to"] != r["__label"]:
            wanted[r["__label"], r["__to"], r["__level"]] = r["count"]
    granted = [(*k, n) for k, n in quotas(wanted, free).items() if n]
    if not granted:
        return wants.select(*linked.columns), 0
    allowed = linked.sparkSession.createDataFrame(granted, "__la int, __lb int, __ll int, __n long")
    same = (F.col("__label") == F.col("__la")) & (F.col("__to") == F.col("__lb")) & (F.col("__level") == F.col("__ll"))
    asking = ranked(wants.where("__to <> __label"), ["__label", "__to", "__level"], ["__node"], "__nth").join(
        F.broadcast(allowed), same, "left"  # shards^2 levels at most
    ).withColumn("__label", F.when(F.col("__nth") < F.col("__n"), F.col("__to")).otherwise(F.col("__label")))
    return written(asking.select(*linked.columns).unionByName(
        wants.where("__to = __label").select(*linked.columns)
    ), "shard-round"), sum(g[-1] for g in granted)


def _requests(linked: DataFrame, quota: int) -> DataFrame:
    """With ``__to``, the shard a row is drawn to (its own, if that is one of its group's), and
    ``__level``, how much of the group is there already."""
    votes = linked.groupBy(F.col("group").alias("__g"), "__label").agg(
        F.count("*").alias("__v"), F.max("__size").alias("__s")
    )
    order = Window.partitionBy("__g").orderBy(F.desc("__v"), F.xxhash64("__g", "__label"))
    goals = votes.withColumn("__nth", F.row_number().over(order)).where(
        F.col("__nth") <= F.ceil(F.col("__s") / quota)
    ).groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("__nth", "__label", "__v"))).alias("__goals"))
    # At most as many goals as there are shards.
    drawn = F.get("__goals", F.pmod(F.xxhash64("__node"), F.size("__goals")).cast("int"))
    at_home = F.exists("__goals", lambda g: g["__label"] == F.col("__label"))
    return linked.join(goals, F.col("group").eqNullSafe(F.col("__g"))).withColumns({
        "__to": F.when(at_home, F.col("__label")).otherwise(drawn["__label"]),
        "__level": F.least(F.lit(LEVELS - 1), F.floor(LEVELS * drawn["__v"] / F.col("__size"))).cast("int"),
    }).drop("__g", "__goals")


def _fill(rows: DataFrame, have: dict[int, int], room: dict[int, int]) -> DataFrame:
    """Rows stay while their shard has room; the others fill the remaining room in order."""
    offset, given, first, ends = {}, 0, 0, []
    for s in room:
        offset[s] = given
        given += max(0, have.get(s, 0) - room[s])
        first += max(0, room[s] - have.get(s, 0))
        ends.append(first)
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at, nth = F.col("__label"), F.col("__nth")
    mine = F.get(array(room.values()), at)
    to = F.size(F.filter(array(ends), lambda e: e <= F.get(array(offset.values()), at) + nth - mine))
    return ranked(rows, ["__label"], ["__node"], "__nth").withColumn(
        "__label", F.when(nth < mine, at).otherwise(to.cast("int"))
    ).select(*rows.columns)


def cut(placed: DataFrame) -> DataFrame:
    """``n_groups n_shards``: linked groups, and how many shards they touch in all."""
    touched = placed.groupBy("group", "shard").agg(F.count("*").alias("n")).groupBy("group").agg(
        F.sum("n").alias("n"), F.count("*").alias("shards")
    ).where("n > 1")
    return touched.agg(F.count("*").alias("n_groups"), F.sum("shards").alias("n_shards"))


def documents_in_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id size text_crc32 group shard slot``; groups are equal texts."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return propagate(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("group"),
    ), shards)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with all their columns, and ``shard`` and ``slot``.

    Equal rows are interchangeable: the n-th of them takes the n-th of their places.
    """
    # Maps have no hash.
    plain = [
        F.to_json(F.struct(c.alias("v"))) if "map<" in f.dataType.simpleString() else c
        for c, f in zip(columns_of(docs), docs.schema.fields)
    ]
    key = F.xxhash64(*plain)
    nodes = docs.select(key.alias("__key"), F.xxhash64("text").alias("group"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    places = propagate(nodes, shards).withColumn("__nth_place", nth).select(
        F.col("__key").alias("__of"), "__nth_place", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")
    )
    rows = docs.withColumn("__key", key).withColumn("__nth", nth)
    return rows.join(
        places, (F.col("__key") == F.col("__of")) & (F.col("__nth") == F.col("__nth_place"))
    ).select(*[c for c, name in zip(columns_of(docs), docs.columns) if name not in ("shard", "slot")],
             F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return documents_in_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
