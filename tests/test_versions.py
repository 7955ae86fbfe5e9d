"""Committed versions of stored tables: parameters, deletes, epochs, interrupted writes, lookups."""

import os

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from pagedrift.sources import commits, tables

ROW = "url_key string, n long"


def frame(spark, rows, schema=ROW):
    return spark.createDataFrame(rows, schema)


def stored(spark, path, schema, run=None, **how):
    return {r["url_key"]: r["n"] for r in tables.read_keyed(spark, path, schema, run, **how).collect()}


def test_other_parameters_are_an_error_never_fewer_keys(spark, tmp_path):
    path, rows = str(tmp_path), frame(spark, [(f"k{i}", i) for i in range(1000)])
    tables.write_keyed(rows, path, 0, buckets=64, every=4)
    assert len(stored(spark, path, rows.schema)) == 1000
    assert len(stored(spark, path, rows.schema, 1, buckets=64, every=4)) == 1000
    for how in ({"buckets": 32}, {"every": 20}):
        with pytest.raises(ValueError, match="stored with"):
            tables.read_keyed(spark, path, rows.schema, 1, **how)
        with pytest.raises(ValueError, match="stored with"):
            tables.write_keyed(rows, path, 1, **how)
    other = frame(spark, [("a", 1.5)], "url_key string, n double")
    for action in (lambda: tables.read_keyed(spark, path, other.schema), lambda: tables.write_keyed(other, path, 1),
                   lambda: tables.read_keyed(spark, path, rows.schema, key="n"), lambda: tables.scan_keyed(spark, path, other.schema, "a")):
        with pytest.raises(ValueError, match="stored with"):
            action()
    keys = frame(spark, [(f"k{i}",) for i in range(0, 2000, 7)], "url_key string")
    assert len(stored(spark, path, rows.schema, keys=keys)) == 143


def test_deletes_hold_until_a_key_comes_back(spark, tmp_path):
    path, schema = str(tmp_path), frame(spark, [("a", 1)]).schema
    gone = lambda *keys: frame(spark, [(k,) for k in keys], "url_key string")
    expected = [{}]
    steps = [
        ([("a", 1), ("b", 1), ("c", 1), (None, 1)], ()), ([("b", 2)], ("a", "never", None)), ([], ("b", "c")),
        ([("c", 4)], ()), ([("a", 5)], ("a",)), ([], ("c",)), ([("d", 7)], ()),
    ]
    for run, (rows, deleted) in enumerate(steps):
        tables.write_keyed(frame(spark, rows, schema), path, run, every=3, deleted=gone(*deleted))
        now = {k: n for k, n in expected[-1].items() if k not in deleted} | {k: n for k, n in rows if k is not None}
        expected.append(now)
    for run, now in enumerate(expected):
        assert {k: n for k, n in stored(spark, path, schema, run).items() if k is not None} == now
    assert [tables.scan_keyed(spark, path, schema, "a", n).count() for n in range(8)] == [0, 1, 0, 0, 0, 1, 1, 1]
    # The merged run holds no marks, and nothing but what counts.
    merged = commits.read(spark, path, 6).manifest["folders"]
    assert len(merged) == 1
    files = spark.read.parquet(f"{path}/{merged[0]}")
    assert files.count() == 2 and files.where(tables.DELETED).count() == 0
    tables.delete_keyed(gone("a", "d"), path, 7, schema)
    assert stored(spark, path, schema) == {}


def test_a_repeated_run_replaces_itself_and_an_old_one_is_refused(spark, tmp_path):
    path, schema = str(tmp_path), frame(spark, [("a", 1)]).schema
    for run, n in ((0, 1), (1, 2), (1, 3)):
        tables.write_keyed(frame(spark, [("a", n), (f"only{n}", n)]), path, run)
    assert stored(spark, path, schema) == {"a": 3, "only1": 1, "only3": 3}
    with pytest.raises(ValueError, match="too late"):
        tables.write_keyed(frame(spark, [("a", 9)]), path, 0)


def test_a_write_killed_half_way_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path, keyed = str(tmp_path / "list"), str(tmp_path / "keyed")
    good = lambda n: frame(spark, [(f"https://example.com/{n}", ".x", None, None, None)], tables.TARGET)
    assert tables.replace_targets(good(1), path, ["example.com"]) == 0
    tables.write_keyed(frame(spark, [("a", 1)]), keyed, 0)

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", killed)
        for write in (lambda: tables.replace_targets(good(2), path, ["example.com"]),
                      lambda: tables.write_keyed(frame(spark, [("a", 2), ("b", 2)]), keyed, 1)):
            with pytest.raises(KeyboardInterrupt):
                write()
    assert [r["url"][-1] for r in tables.read_targets(spark, path, ["example.com"], strict=True).collect()] == ["1"]
    assert stored(spark, keyed, frame(spark, [("a", 1)]).schema) == {"a": 1}
    # A list may be made from itself, and a version once read stays readable.
    pinned = tables.read_targets(spark, path, ["example.com"])
    assert tables.replace_targets(pinned.unionByName(good(3)), path, ["example.com"]) == 1
    assert pinned.count() == 1 and tables.read_targets(spark, path, ["example.com"]).count() == 2
    assert tables.read_targets(spark, path, ["example.com"], version=0).count() == 1
    with pytest.raises(ValueError):
        tables.replace_targets(frame(spark, [("http://example.com", ".x", None, None, None)], tables.TARGET), path, ["example.com"])
    assert tables.read_targets(spark, path, ["example.com"]).count() == 2


def test_two_writers_of_one_version(spark, tmp_path):
    commits.commit(spark, str(tmp_path), 4, {"folders": []})
    with pytest.raises(Exception, match="exist"):
        commits.commit(spark, str(tmp_path), 4, {"folders": ["x"]})
    assert commits.latest(spark, str(tmp_path)).manifest == {"folders": []}
    assert commits.latest(spark, str(tmp_path), 4) is None and commits.numbers(spark, f"{tmp_path}/none") == []


def test_forgetting_old_versions(spark, tmp_path):
    path, schema = str(tmp_path), frame(spark, [("a", 1)]).schema
    for run in range(7):
        tables.write_keyed(frame(spark, [("a", run), (f"k{run}", run)]), path, run, every=4)
    now = stored(spark, path, schema)
    assert commits.forget(spark, path, 2) == [0, 1, 2, 3, 4]
    assert commits.numbers(spark, path) == [5, 6]
    # The versions that stay still need the folder of the merged run 4, and no other of the old ones.
    assert [d for d in sorted(os.listdir(f"{path}/data")) if os.listdir(f"{path}/data/{d}")] == ["run_id=4", "run_id=5", "run_id=6"]
    assert stored(spark, path, schema) == now and len(now) == 8
    assert stored(spark, path, schema, 6) == {k: min(n, 5) for k, n in now.items() if k != "k6"}
    with pytest.raises(ValueError):
        commits.forget(spark, path, 0)


def test_a_lookup_reads_less_than_a_bucket(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("url_key"), F.col("id").alias("n"))
    tables.write_keyed(rows, str(tmp_path), 0, buckets=2)
    value = rows.where("n = 77").first()["url_key"]
    found = tables.scan_keyed(spark, str(tmp_path), rows.schema, value)
    assert [r["n"] for r in found.collect()] == [77]
    version = commits.latest(spark, str(tmp_path))
    scan = tables._stored(spark, str(tmp_path), version).where(
        (F.col("bucket") == tables.bucket_of(F.lit(value), 2)) & (F.col("url_key") == value))
    query = scan._jdf.queryExecution()
    query.toRdd().count()
    leaves = query.executedPlan().collectLeaves()
    read = leaves.head().metrics().apply("numOutputRows").value()
    assert 0 < read < n / 8


def test_many_tasks_write_a_bucket(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("url_key"), F.col("id").alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tables.write_keyed(rows, str(tmp_path), 0, buckets=2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    folder = commits.latest(spark, str(tmp_path)).manifest["folders"][0]
    files = [f for f in os.listdir(f"{tmp_path}/{folder}/bucket=0") if f.endswith(".parquet")]
    assert len(files) > 3
    assert tables.read_keyed(spark, str(tmp_path), rows.schema).count() == 4000


def test_history_of_the_given_tables_survives_a_change_of_settings(spark, tmp_path):
    from pagedrift.sources.derived import derived

    rows = derived(spark, SF_DIR, "history")
    tables.write_keyed(rows, str(tmp_path), 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert tables.read_keyed(spark, str(tmp_path), rows.schema).count() == rows.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
