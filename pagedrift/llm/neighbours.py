"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one a shard.

Different vectors are dealt into shards of bounded bytes by their hash.  In each shard a directed
graph is built: a greedy search from the middle proposes neighbours of a new vector, pruning keeps
a candidate unless one kept before is nearer to it by the factor ``alpha``, and the edges are
entered backwards as well.  The index is a table with one row for each shard.  Every query walks
the graph of every shard with a beam; the best of all shards are the result.

Largest inner product becomes smallest distance by one more component, which gives all vectors
of a shard the same length (it is zero in a query).  Walks compare in single precision; what they
find is scored in double precision on the original vectors.

Defined cases: null, empty and zero vectors and those that hold a null or a non-finite component
take no part.  Vectors of different length are never compared.  Equal vectors are one node that
keeps its ``k + 1`` smallest ids, all that a result can name.  Repeated rows count once; rows that
share a ``vec_id`` are never each other's neighbours, and each of their different vectors is a
query.  A row without a ``vec_id`` may be found (after all others of its score), but asks nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, table, written

#: Neighbours asked for; rows whose id is divisible by ``EVERY`` ask.
NEAREST, EVERY = 20, 20
#: Bytes of the vectors (single precision) of a shard; small tables are dealt into some shards too.
SHARD_BYTES = 16 << 20
SMALL_SHARDS, SMALL_ROWS = 8, 1024
#: Edges of a node after pruning, and the room for edges entered backwards until it is pruned again.
DEGREE, ROOM = 32, 48
#: Width of the beam while building, nodes opened at a time, the factor of the relaxed pruning.
BUILD_WIDTH, OPENED, ALPHA = 24, 8, 1.1
#: The beam of a shard is widened from ``LEAST_WIDTH`` until its search finds this share of the nearest
#: of so many of its own nodes (compared with all nodes of the shard).
LEAST_WIDTH, RECALL, PROBES = 32, 0.97, 128
#: Searches that walk side by side; bytes of the queries of one task and of the vectors scored at once.
SIDE_BY_SIDE = 256
QUERY_BYTES, SCORED_BYTES = 16 << 20, 16 << 20


def level(vectors: np.ndarray) -> np.ndarray:
    """Single precision, with one more component that makes all of them equally long."""
    wide = vectors.astype(np.float64)
    # Scaling changes no order and keeps squares finite.
    wide /= max(np.abs(wide).max(initial=0.0), 1e-300)
    squares = np.einsum("ij,ij->i", wide, wide)
    rest = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))
    scale = np.sqrt(squares.max(initial=0.0)) or 1.0
    return (np.column_stack([wide, rest]) / scale).astype(np.float32)


def as_queries(vectors: np.ndarray) -> np.ndarray:
    """Queries for the nodes of :func:`level`; their length does not matter."""
    wide = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    wide /= np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
    return np.column_stack([wide, np.zeros(len(wide))]).astype(np.float32)


def beam(nodes: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, width: int,
         opened: int = OPENED) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes each query met, best first (-1: none), and their inner products."""
    n, many = len(nodes), len(queries)
    met = np.full((many, width), -1, np.int32)
    score = np.full((many, width), -np.inf, np.float32)
    fresh = np.zeros((many, width), bool)
    met[:, 0], score[:, 0], fresh[:, 0] = start, queries @ nodes[start], True
    unseen = np.ones(many * n, bool)
    unseen[np.arange(many, dtype=np.int64) * n + start] = False
    # Rows whose walk goes on; ``of`` says which query each one is.
    of = np.arange(many)
    done_met, done_score = met.copy(), score.copy()
    while len(of):
        turn = fresh & (fresh.cumsum(axis=1, dtype=np.int16) <= opened)
        row, column = np.divmod(np.flatnonzero(turn), width)
        fresh[turn] = False
        beyond = edges.take(met[row, column], axis=0)
        place = (beyond + (of[row] * n)[:, None]).ravel()
        # Of a node that two opened nodes lead to, only one entry stays.
        new = np.flatnonzero((beyond >= 0).ravel() & unseen.take(place, mode="clip"))
        place = np.sort(place.take(new))
        place = place[np.diff(place, prepend=-1) > 0]
        unseen[place] = False
        asked, beyond = np.divmod(place, n)
        near = np.einsum("ij,ij->i", nodes.take(beyond, axis=0), queries.take(asked, axis=0))
        count = np.bincount(asked, minlength=many).take(of)
        total = width + int(count.max(initial=0))
        flat = np.repeat(np.arange(len(of)) * total + width - count.cumsum() + count, count) + np.arange(len(place))
        all_score = np.full((len(of), total), -np.inf, np.float32)
        all_met = np.full((len(of), total), -1, np.int32)
        all_fresh = np.zeros((len(of), total), bool)
        all_score[:, :width], all_met[:, :width], all_fresh[:, :width] = score, met, fresh
        all_score.ravel()[flat], all_met.ravel()[flat], all_fresh.ravel()[flat] = near, beyond, True
        best = np.argsort(-all_score, axis=1)[:, :width] + (np.arange(len(of)) * total)[:, None]
        score, met, fresh = all_score.take(best), all_met.take(best), all_fresh.take(best)
        on = fresh.any(axis=1)
        if not on.all():
            done_score[of[~on]], done_met[of[~on]] = score[~on], met[~on]
            of, score, met, fresh = of[on], score[on], met[on], fresh[on]
    return done_met, done_score


def prune(nodes: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of the candidates (-1: none) of each node, near ones in different directions."""
    rows = np.arange(len(of))
    candidates = np.sort(np.where(candidates == of[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    away = 1.0 - np.matmul(nodes[candidates], nodes[of][:, :, None])[:, :, 0]
    away[candidates < 0] = np.inf
    order = np.argsort(away, axis=1)
    away = np.take_along_axis(away, order, 1)
    candidates = np.take_along_axis(candidates, order, 1)
    vectors = nodes[candidates]
    between = alpha * (1.0 - np.matmul(vectors, vectors.transpose(0, 2, 1)))
    alive = candidates >= 0
    out = np.full((len(of), degree), -1, np.int32)
    for i in range(degree):
        kept = alive.argmax(axis=1)
        some = alive[rows, kept]
        if not some.any():
            break
        out[some, i] = candidates[rows[some], kept[some]]
        # The relaxed rule: only what lies nearer to the kept one, by the factor, goes.
        alive &= between[rows, kept] > away
        alive[rows, kept] = False
    return out


def middle(nodes: np.ndarray) -> int:
    return int((nodes @ nodes.mean(axis=0)).argmax())


def graph(nodes: np.ndarray, degree: int = DEGREE, room: int = ROOM, width: int = BUILD_WIDTH,
          alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The edges (-1: none) of each node and the node at which searches start.

    Nodes enter in the order given, in growing batches; nodes of one batch are proposed to each
    other directly, as no search can meet them.
    """
    n = len(nodes)
    start = middle(nodes)
    edges = np.full((n, room), -1, np.int32)
    filled = np.zeros(n, np.int32)
    waiting = np.delete(np.arange(n, dtype=np.int32), start)
    at = 0
    while at < len(waiting):
        new = waiting[at : at + min(max(16, (at + 1) // 8), SIDE_BY_SIDE)]
        at += len(new)
        found, _ = beam(nodes, edges, nodes[new], start, width)
        mates = nodes[new] @ nodes[new].T
        np.fill_diagonal(mates, -np.inf)
        beside = new[np.argsort(-mates, axis=1)[:, : width // 4]]
        kept = prune(nodes, new, np.concatenate([found, beside.astype(np.int32)], axis=1), degree, alpha)
        edges[new, :degree] = kept
        filled[new] = (kept >= 0).sum(axis=1)
        _enter(nodes, edges, filled, np.repeat(new, degree), kept.ravel(), degree, alpha)
    return _reach(nodes, edges, filled, start, width), start


def _enter(nodes, edges, filled, tail, head, degree, alpha) -> None:
    """Enter the edges tail -> head backwards; a node without room is pruned together with them."""
    there = head >= 0
    tail, head = tail[there], head[there]
    order = np.argsort(head, kind="stable")
    tail, head = tail[order], head[order]
    to, first, count = np.unique(head, return_index=True, return_counts=True)
    slot = np.arange(len(head)) - np.repeat(first, count)
    full = filled[to] + count > edges.shape[1]
    fits = ~np.repeat(full, count)
    edges[head[fits], filled[head[fits]] + slot[fits]] = tail[fits]
    filled[to[~full]] += count[~full].astype(np.int32)
    for some in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // SIDE_BY_SIDE))):
        if not len(some):
            continue
        more = np.full((len(some), int(count[some].max())), -1, np.int32)
        for i, f in enumerate(some):
            more[i, : count[f]] = tail[first[f] : first[f] + count[f]]
        kept = prune(nodes, to[some], np.concatenate([edges[to[some]], more], axis=1), degree, alpha)
        edges[to[some]] = -1
        edges[to[some], :degree] = kept
        filled[to[some]] = (kept >= 0).sum(axis=1)


def _reach(nodes, edges, filled, start, width) -> np.ndarray:
    """Edges in which every node can be reached: one more for each group that could not."""
    n = len(nodes)
    reached = np.zeros(n, bool)

    def walk(front: np.ndarray) -> None:
        reached[front] = True
        while len(front):
            front = np.unique(edges[front])
            front = front[front >= 0]
            front = front[~reached[front]]
            reached[front] = True

    walk(np.array([start]))
    while not reached.all():
        lost = int(np.flatnonzero(~reached)[0])
        found, _ = beam(nodes, edges, nodes[[lost]], start, width)
        # The nearest that has room, or else a new column of edges.
        found = found[0][found[0] >= 0]
        free = found[filled[found] < edges.shape[1]]
        if not len(free):
            edges = np.column_stack([edges, np.full(n, -1, np.int32)])
            free = found
        edges[free[0], filled[free[0]]] = lost
        filled[free[0]] += 1
        walk(np.array([lost]))
    return edges


def width_for(vectors: np.ndarray, nodes: np.ndarray, edges: np.ndarray, start: int, nearest: int) -> int:
    """The beam width that finds the share ``RECALL`` of the ``nearest`` nodes of some of the vectors."""
    n = len(nodes)
    probes = np.unique(np.linspace(0, n - 1, PROBES).astype(np.int64))
    queries = as_queries(vectors[probes])
    near = queries @ nodes.T
    near[np.arange(len(probes)), probes] = -np.inf
    nearest = min(nearest, n - 1)
    if nearest < 1:
        return 1
    wanted = -np.partition(-near, nearest - 1, axis=1)[:, nearest - 1 : nearest]
    width = LEAST_WIDTH
    while width < n:
        found, _ = beam(nodes, edges, queries, start, width)
        hit = np.take_along_axis(near, np.maximum(found, 0), 1)
        hit[found < 0] = -np.inf
        if np.minimum((hit >= wanted).sum(axis=1), nearest).sum() >= RECALL * nearest * len(probes):
            return width
        width = width * 3 // 2
    return n


# --- the index as a table ----------------------------------------------------------------------

INDEX = (
    "dim int, shard int, width int, start int, room int, ids array<array<long>>, vectors binary, edges binary"
)


def vectors_of(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id vec dim h``: rows that take part, repeated ones once; ``h`` is a hash of the vector."""
    plain = rows.select(
        F.col(id_column).cast("long").alias("vec_id"),
        # Adding zero makes one of the two zeros.
        F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"),
    )
    usable = (
        F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vec", lambda x: x != F.lit(0.0))
    )
    return plain.where(usable).distinct().select(
        "vec_id", "vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h")
    )


def shards_of(vectors: DataFrame) -> DataFrame:
    """``dim shards blocks``: for each length of vectors, its shards and the blocks of its queries."""
    n, dim = F.col("n"), F.col("dim")
    asks = F.count_if(F.col("vec_id") % EVERY == 0)
    return vectors.groupBy("dim").agg(F.count("*").alias("n"), asks.alias("q")).select(
        "dim",
        F.greatest(
            F.ceil(n * dim * 4 / SHARD_BYTES), F.least(F.lit(SMALL_SHARDS), F.ceil(n / SMALL_ROWS))
        ).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("q") * dim * 8 / QUERY_BYTES)).cast("int").alias("blocks"),
    )


def index(vectors: DataFrame, sizes: DataFrame, k: int = NEAREST) -> DataFrame:
    """One row for each shard: its different vectors, the ids of each, and the graph."""
    same = Window.partitionBy("dim", "h", "vec").orderBy(F.col("vec_id").asc_nulls_last())
    nodes = (
        vectors.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
        .groupBy("dim", "h", "vec").agg(F.collect_list("vec_id").alias("some"), F.count_if(F.isnull("vec_id")).alias("no_id"))
        .select("dim", "h", "vec", F.concat(F.array_sort("some"), F.when(
            F.col("no_id") > 0, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))).alias("ids"))
        .join(sizes, "dim").withColumn("shard", F.pmod("h", "shards").cast("int"))
    )
    schema = pa.schema([
        ("dim", pa.int32()), ("shard", pa.int32()), ("width", pa.int32()), ("start", pa.int32()), ("room", pa.int32()),
        ("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("edges", pa.binary()),
    ])

    def build(rows: pa.Table) -> pa.Table:
        # The order of the nodes, and so the graph, does not depend on how rows arrived.
        rows = rows.sort_by("h").combine_chunks()
        dim = rows["dim"][0].as_py()
        vectors = rows["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        wide = level(vectors)
        edges, start = graph(wide)
        nearest = -(-2 * k // rows["shards"][0].as_py()) + 2
        return pa.Table.from_pylist([{
            "dim": dim, "shard": rows["shard"][0].as_py(),
            "width": width_for(vectors, wide, edges, start, min(nearest, k)), "start": start, "room": edges.shape[1],
            "ids": rows["ids"].to_pylist(), "vectors": vectors.tobytes(), "edges": edges.tobytes(),
        }], schema=schema)

    return nodes.select("dim", "shard", "shards", "h", "vec", "ids").groupBy("dim", "shard").applyInArrow(build, INDEX)


def search(queries: DataFrame, indexed: DataFrame, sizes: DataFrame, k: int = NEAREST) -> DataFrame:
    """``query_id h vec_id score``: the best ``k`` of each shard for each query (``vec_id vec dim h``)."""
    asked = queries.join(sizes, "dim").select(
        F.col("vec_id").alias("query_id"), "vec", "dim", "h",
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("vec_id", "h"), "blocks").cast("int").alias("block"),
    )
    shards = indexed.join(sizes, "dim").select(
        *indexed.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    schema = pa.schema([("query_id", pa.int64()), ("h", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def walk(asking: pa.Table, shard: pa.Table) -> pa.Table:
        if not asking.num_rows or not shard.num_rows:
            return schema.empty_table()
        dim = shard["dim"][0].as_py()
        vectors = np.frombuffer(shard["vectors"][0].as_py()).reshape(-1, dim)
        edges = np.frombuffer(shard["edges"][0].as_py(), np.int32).reshape(len(vectors), -1)
        lists = shard["ids"].combine_chunks().flatten()
        ids = lists.flatten()
        nameless = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        first = lists.offsets.to_numpy().astype(np.int64)
        nodes, start, width = level(vectors), shard["start"][0].as_py(), shard["width"][0].as_py()
        asking = asking.combine_chunks()
        query = asking["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        # Equal queries walk once.
        _, one, of = np.unique(asking["h"].to_numpy(), return_index=True, return_inverse=True)
        same = (query == query[one][of]).all(axis=1)
        one, of = (one, of) if same.all() else (np.arange(len(query)), np.arange(len(query)))
        flat = as_queries(query)
        # So many queries are scored at once that their vectors stay small.
        few = max(1, min(SIDE_BY_SIDE, SCORED_BYTES // (8 * dim * width)))
        met = np.concatenate([
            beam(nodes, edges, flat[one[i : i + SIDE_BY_SIDE]], start, width)[0]
            for i in range(0, len(one), SIDE_BY_SIDE)
        ])
        out = []
        for i in range(0, len(query), few):
            row, column = np.nonzero(met[of[i : i + few]] >= 0)
            node = met[of[i + row], column]
            score = np.einsum("ij,ij->i", vectors[node], query[i + row])
            many = first[node + 1] - first[node]
            place = np.repeat(first[node] - many.cumsum() + many, many) + np.arange(many.sum())
            row, score = np.repeat(row + i, many), np.repeat(score, many)
            own = (ids[place] == asking["query_id"].to_numpy()[row]) & ~nameless[place]
            row, score, place = row[~own], score[~own], place[~own]
            order = np.lexsort((ids[place], nameless[place], -score, row))
            row, score, place = row[order], score[order], place[order]
            count = np.bincount(row - i, minlength=1)
            nth = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
            row, score, place = row[nth < k], score[nth < k], place[nth < k]
            out.append(pa.table([
                pa.array(asking["query_id"].to_numpy()[row]), pa.array(asking["h"].to_numpy()[row]),
                pa.array(ids[place], mask=nameless[place]), pa.array(score),
            ], schema=schema))
        return pa.concat_tables(out)

    keys = ("dim", "shard", "block")
    return asked.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInArrow(
        walk, "query_id long, h long, vec_id long, score double"
    )


def nearest(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """``query_id rank vec_id score`` for every row whose ``vec_id`` is divisible by ``EVERY``."""
    vectors = written(vectors_of(rows), "vectors")
    sizes = shards_of(vectors)
    indexed = written(index(vectors, sizes, k), "graphs")
    found = search(vectors.where(F.col("vec_id") % EVERY == 0), indexed, sizes, k)
    best = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return nearest(table(spark, sf_dir, "embeddings"))
