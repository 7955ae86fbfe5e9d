"""Runs of words, the manifest and the neighbour graphs against plain versions."""

import math
import random

import duckdb
import numpy as np
import pytest
from conftest import SF_DIR
from llm import brute
from pyspark.sql import functions as F

from pagedrift.llm import jobs, manifest, neighbours, runs


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


# --- runs of words -----------------------------------------------------------------------------


def test_runs_of_the_given_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet' where length(text) < 20000").fetchall()
    expected = brute.run_digests(docs)
    found = {r.pop("doc_id"): r for r in rows_of(jobs.QUERIES["op11_runs"](spark, SF_DIR))}
    assert len(found) >= len(expected) > 100
    assert {i: found[i] for i in expected} == expected
    assert sum(r["n_runs"] > 0 for r in expected.values()) > 10
    assert any((r["period"] or 0) >= runs.SHORT for r in expected.values())


def test_runs_of_odd_documents(spark, tables):
    pick = random.Random(5)
    cycle = [f"w{i}" for i in range(37)]
    docs = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "ha " * 400), (5, "a b " * 3), (6, "a b " * 2), (7, "x " * 6), (8, "x " * 5),
        (9, " ".join(cycle * 4)), (10, " ".join((cycle * 4)[:-1])), (11, " ".join(["p", *cycle * 9, "q"])),
        (12, "a a a a a a b " * 4 + "c"), (13, "  　 " * 9), (14, "é 世 \U0001f600 " * 40),
        (15, " ".join(pick.choice("ab") for _ in range(600))), (16, " ".join(str(i % 5000) for i in range(20000))),
        *[(100 + i, " ".join(pick.choice("abc") * pick.randrange(1, 3) for _ in range(pick.randrange(90)))) for i in range(80)],
    ]
    folder = tables(documents=[*docs, (None, "a b " * 20), (None, "a b " * 20)])
    found = [(r.pop("doc_id"), r) for r in rows_of(jobs.QUERIES["op11_runs"](spark, folder))]
    assert len(found) == len(docs) + 2
    expected = brute.run_digests(docs)
    assert {i: r for i, r in found if i is not None} == expected
    nameless = [r for i, r in found if i is None]
    assert nameless[0] == nameless[1] and nameless[0]["n_runs"] == 1 and nameless[0]["length"] == 40


def test_runs_of_no_documents(spark, tables):
    assert jobs.QUERIES["op11_runs"](spark, tables()).collect() == []


def test_many_small_runs_of_every_scale():
    pick = random.Random(11)
    for _ in range(150):
        docs = []
        for _ in range(pick.randrange(1, 6)):
            words = []
            while pick.random() < 0.8:
                part = [pick.randrange(pick.choice([2, 3, 50])) for _ in range(pick.randrange(1, 40))]
                words += [part[i % len(part)] for i in range(pick.randrange(len(part) * 7))]
            docs.append(words)
        found = runs.runs_of(np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs]))
        assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, d in enumerate(docs) for r in brute.periodic(d)]


def test_operator_returns_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "so  so\nso so so so it is", 9)], "doc_id long, text string, runs int")
    row = runs.periodic_runs(docs).first()
    assert row.asDict(True) == {
        "doc_id": 1, "n_words": 8, "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "so it is",
    }


# --- the manifest ------------------------------------------------------------------------------

MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(frame):
    assert tuple(frame.columns) == MANIFEST
    return sorted(map(tuple, frame.collect()), key=str)


def test_manifest_of_the_given_documents(spark):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    docs = connection.execute("select doc_id, source, lang, n_chars, text from documents").fetchall()
    expected = sorted(brute.manifest(docs), key=str)
    assert manifest_rows(jobs.QUERIES["op12_manifest"](spark, SF_DIR)) == expected
    assert sorted(connection.execute(jobs.SQL["op12_manifest"]).fetchall(), key=str) == expected
    assert 0 < sum(not r[-1] for r in expected) < len(expected) / 4


def test_manifest_of_odd_rows(spark, tables, monkeypatch):
    # Four slots a block: many rounds.
    monkeypatch.setattr(manifest, "LEVELS", 2)
    docs = [
        *[(i, f"text {i}", "en", "a", i) for i in range(77)], (200, "é世", "", "b", 2), (201, None, None, None, None),
        (203, "", None, "", 0), (None, "x", "de", "a", 1), (None, "y", "de", "a", 1), (204, "z", "ééé", "a", 1),
        *[(205, "same", "de", "a", 4)] * 3, (206, "-", "-", "-", 1), (-7, "1:a", "de", "a", 3),
    ]
    folder = tables(documents=docs)
    expected = brute.manifest([(i, source, lang, n, text) for i, text, lang, source, n in docs])
    assert manifest_rows(jobs.QUERIES["op12_manifest"](spark, folder)) == sorted(expected, key=str)


@pytest.mark.parametrize("docs", [[], [(7, "only", "en", "a", 4)], [(1, "a", "en", "a", 1), (2, "b", "de", "a", 1)]])
def test_manifest_of_few_rows(spark, tables, docs):
    expected = brute.manifest([(i, source, lang, n, text) for i, text, lang, source, n in docs]) if docs else []
    assert manifest_rows(jobs.QUERIES["op12_manifest"](spark, tables(documents=docs))) == sorted(expected, key=str)


def test_manifest_does_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(manifest_rows(jobs.QUERIES["op12_manifest"](spark, SF_DIR)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


# --- neighbours --------------------------------------------------------------------------------


def write_vectors(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, h long, dim string, score double").write.parquet(
        f"{path}/embeddings.parquet"
    )
    return str(path)


def found_rows(frame):
    assert frame.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0], r[1], r[3]))


def test_neighbours_of_odd_rows(spark, tmp_path, monkeypatch):
    # Beams as wide as the shard find all.
    monkeypatch.setattr(neighbours, "RECALL", 2.0)
    pick = np.random.default_rng(3)
    vector = lambda n=5: [float(x) for x in pick.integers(-3, 4, n)]
    same = vector()
    odd = [None, [], [0.0] * 5, [0.0, -0.0], [1.0, None, 2.0], [math.nan, 1.0], [math.inf, 1.0, 1.0, 1.0, 1.0]]
    rows = [(i, vector(), 1, 5, "x", 0.5) for i in range(300)]
    rows += [(1000 + i, same, None, None, None, None) for i in range(60)]
    rows += [(2000 + 20 * i, v, None, None, None, None) for i, v in enumerate(odd)]
    rows += [(3000 + i, vector(3), None, None, None, None) for i in range(30)] + [(4000, [1.0], None, None, None, None)]
    rows += [(None, vector(), None, None, None, None), (None, same, None, None, None, None), rows[20], (40, vector(), 0, 0, "", 0.0)]
    rows += [(-20, [2.0**100] * 5, None, None, None, None)]
    folder = write_vectors(spark, tmp_path, rows)
    assert found_rows(jobs.QUERIES["op13_neighbours"](spark, folder)) == sorted(
        brute.nearest([r[:2] for r in rows]), key=lambda r: (r[0], r[1], r[3])
    )


def test_neighbours_of_no_rows(spark, tmp_path):
    assert jobs.QUERIES["op13_neighbours"](spark, write_vectors(spark, tmp_path, [])).collect() == []


def test_recall_of_the_given_vectors(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.1")
    data = duckdb.sql(f"select vec_id, embedding from '{sf_dir}/embeddings.parquet'").fetchall()
    ids, vectors = np.array([r[0] for r in data]), np.array([r[1] for r in data], np.float64)
    asked = ids % 20 == 0
    score = vectors[asked] @ vectors.T
    score[ids[asked][:, None] == ids] = -np.inf
    nearest = ids[np.argsort(-score, axis=1)[:, :20]]
    found = {}
    for query, rank, vec, value in found_rows(jobs.QUERIES["op13_neighbours"](spark, sf_dir)):
        assert rank == len(found.setdefault(query, [])) + 1
        found[query].append(vec)
        assert abs(value - vectors[ids == query][0] @ vectors[ids == vec][0]) < 1e-12
    hits = [len(set(found[q]) & set(n)) / 20 for q, n in zip(ids[asked].tolist(), nearest.tolist())]
    assert set(map(len, found.values())) == {20}
    assert np.mean(hits) >= 0.9


def test_one_huge_vector_does_not_hide_the_others(spark, tmp_path):
    pick = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in pick.normal(size=12)], 0, 0, "", 0.0) for i in range(900)]
    rows.append((901, [2.0**90] + [0.0] * 11, 0, 0, "", 0.0))
    found = {r[:3] for r in found_rows(jobs.QUERIES["op13_neighbours"](spark, write_vectors(spark, tmp_path, rows)))}
    wanted = {r[:3] for r in brute.nearest([r[:2] for r in rows])}
    assert len({(q, v) for q, _, v in found} & {(q, v) for q, _, v in wanted}) >= 0.9 * len(wanted)


def test_graphs_reach_every_node():
    pick = np.random.default_rng(7)
    far = np.concatenate([pick.normal(size=(400, 8)) * 0.01 + c * 50 for c in np.eye(8)[:5]])
    edges, start = neighbours.graph(neighbours.level(far))
    reached, front = {start}, [start]
    while front:
        front = [v for n in front for v in edges[n].tolist() if v >= 0 and v not in reached]
        reached.update(front)
    assert len(reached) == len(far)


def test_pruning_keeps_different_directions():
    nodes = neighbours.level(np.array([[1, 0], [1, 0.1], [1, 0.11], [1, -0.5]], np.float64))
    kept = neighbours.prune(nodes, np.array([0]), np.array([[3, 2, 1, 0, -1, 1]]), 3, 1.1)
    assert kept.tolist() == [[1, 3, -1]]
