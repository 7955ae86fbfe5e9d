"""Keyed state of the streams: what a batch writes, restarts, timers, counters that end."""

import datetime as dt

from pyspark.sql import functions as F

from pagedrift.operators.diff import classify_pages, material_changes
from pagedrift.operators.quota import window_quota
from pagedrift.schemas import SNAPSHOT
from pagedrift.streaming import keyed, quotas

DAY = 86_400_000


def promo(i, price="$100", title=None):
    return (str(i), title or f"Title number {i}", "Free breakfast", "Summer", price)


def at(day, second=0):
    return dt.datetime(2024, 1, day, 0, 0, second)


def run(spark, tmp_path, rows, frame=None, **options):
    """Drop the rows, let a fresh query take them; gives its progress with rows."""
    spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SNAPSHOT).parquet(f"{tmp_path}/in")
    query = keyed.stream_changes(source, **options).writeStream.format("parquet").option(
        "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    return [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]


def found(spark, tmp_path):
    return sorted(
        (r["url"], r["id"] or "", r["change_type"], r["pos"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_one_changed_record_writes_one_entry(spark, tmp_path):
    before = [promo(i) for i in range(1000)]
    first = run(spark, tmp_path, [("https://example.com/a", at(1), before)])
    assert first[0]["numRowsUpdated"] == 1001
    after = [*before]
    after[500] = promo(500, "$999")
    # A new process: the state comes from the checkpoint.
    second = run(spark, tmp_path, [("https://example.com/a", at(2), after)])
    assert second[0]["numRowsUpdated"] == 2 and second[0]["numRowsRemoved"] == 0
    assert found(spark, tmp_path) == [("https://example.com/a", "500", "changed", 500)]
    # Moved, gone, repeated and new records; equal to the diff of a batch.
    last = [promo("new"), *after[3:], promo(7, "$7"), promo(2)]
    run(spark, tmp_path, [("https://example.com/a", at(3), last)])
    sides = spark.createDataFrame(
        [("https://example.com/a", last, after)],
        f"url string, current {SNAPSHOT['promos'].dataType.simpleString()}, previous {SNAPSHOT['promos'].dataType.simpleString()}")
    batch = material_changes(classify_pages(sides, F.col("current"), F.col("previous"))).where("change_type <> 'same'")
    expected = sorted((r["url"], r["id"], r["change_type"], r["pos"]) for r in batch.collect())
    assert found(spark, tmp_path)[:] == sorted([("https://example.com/a", "500", "changed", 500), *expected]) and len(expected) >= 4


def test_repeated_ids_and_pages_that_stay(spark, tmp_path):
    a, b = "https://example.com/a", "https://example.com/b"
    run(spark, tmp_path, [(a, at(1), [promo(1), promo(2), promo(1, "$400")]), (b, at(1), [promo(1)])])
    same = run(spark, tmp_path, [(a, at(2), [promo(1), promo(2), promo(1, "$400")]), (b, at(1, 5), [promo(1)])])
    assert same[0]["numRowsUpdated"] == 2  # the two times
    run(spark, tmp_path, [(a, at(3), [promo(2)]), (b, dt.datetime(2023, 1, 1), [])])  # b: older than the stored one
    assert found(spark, tmp_path) == [(a, "1", "removed", 0), (a, "1", "removed", 2)]


def test_unseen_pages_are_reported_once_until_seen_again(spark, tmp_path):
    a, b = "https://example.com/a", "https://example.com/b"
    steps = [[(a, at(1)), (b, at(1))], [(b, at(9))], [(a, at(10)), (b, at(11))], [(b, at(25))]]
    for step in steps:
        run(spark, tmp_path, [(u, t, [promo(1)]) for u, t in step], unseen_ms=5 * DAY)
    # a: after day 1, again after day 10.  The pages of b come with the newest time, so it is never missing.
    assert found(spark, tmp_path) == [(a, "", "unseen", None)] * 2


def requests(spark, rows):
    return spark.createDataFrame(rows, "id long, user string, ts timestamp")


def grants(spark, tmp_path, rows, **options):
    requests(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long, user string, ts timestamp").parquet(f"{tmp_path}/in")
    query = quotas.stream_grants(source, "user", "ts", "id", 3, 3_600_000, **options).writeStream.format("parquet").option(
        "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_counters_end_with_their_window(spark, tmp_path):
    sizes, everything = [], []
    for n in range(8):  # an hour each
        start = dt.datetime(2024, 1, 1, n)
        rows = [(1000 * n + i, f"u{i % 4}", start + dt.timedelta(seconds=(i * 37) % 3000)) for i in range(24)]
        everything += rows
        sizes.append(grants(spark, tmp_path, rows))
    # Only the window that is still open has counters: the first size is the last one.
    assert len(set(sizes)) == 1
    granted = {r["seq"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = window_quota(requests(spark, everything), "user", "ts", "id", 3, 3_600_000).where("allowed")
    assert granted == {r["id"] for r in batch.collect()} and len(granted) == 8 * 4 * 3


def test_a_window_over_two_batches_and_late_requests(spark, tmp_path):
    hour = lambda h, s=0: dt.datetime(2024, 1, 1, h, 0, s)
    grants(spark, tmp_path, [(1, "u", hour(1, 5)), (2, "u", hour(1, 1))], delay="2 hours")
    grants(spark, tmp_path, [(5, "u", hour(1, 9)), (4, "u", hour(1, 7)), (3, "v", hour(2)), (3, "v", hour(2))], delay="2 hours")
    # Two hours behind the newest is in time, more gets no grant.
    grants(spark, tmp_path, [(9, "w", hour(9))], delay="2 hours")
    grants(spark, tmp_path, [(10, "u", hour(8)), (11, "u", hour(3)), (12, None, hour(9, 2))], delay="2 hours")
    rows = sorted((r["key"] or "", r["seq"], r["nth"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [("", 12, 1), ("u", 1, 2), ("u", 2, 1), ("u", 4, 3), ("u", 10, 1), ("v", 3, 1), ("v", 3, 2), ("w", 9, 1)]


class Calls:
    """State of one part in memory, with the number of calls that reach it."""

    def __init__(self):
        self.calls, self.passed, self.maps = 0, 0, {}

    def getMapState(self, name, key, value, ttl=None):
        held, outer = self.maps.setdefault(name, {}), self

        class Map:
            def getValue(self, key):
                outer.calls += 1
                return held.get(key)

            def updateValue(self, key, value):
                outer.calls += 1
                held[key] = value

            def removeKey(self, key):
                outer.calls += 1
                del held[key]

            def iterator(self):
                outer.calls += 1
                for item in list(held.items()):
                    outer.passed += 1
                    yield item

        return Map()

    def getValueState(self, name, value, ttl=None):
        return None


def snapshots(urls, second, n, price="$1"):
    import json

    import pandas as pd

    promos = [{"id": str(i), "title": "t", "perk": "p", "dates": "d", "price": price, "clean": price} for i in range(n)]
    return pd.DataFrame([(u, second, price + str(n), json.dumps(promos)) for u in urls], columns=["url", "ts", "hash", "promos"])


def track(state, *chunks):
    tracker = keyed.ChangeTracker()
    tracker.init(state)
    return [tuple(r) for frame in tracker.handleInputRows((0,), iter(chunks), None) for r in frame.itertuples(index=False)]


def test_a_page_of_few_records_costs_one_call():
    state, urls = Calls(), [f"u{i}" for i in range(500)]
    assert not track(state, snapshots(urls[:250], 1, 2), snapshots(urls[250:], 1, 2)) and state.calls <= 510
    state.calls = 0
    assert len(track(state, snapshots(urls, 2, 2, "$2"))) == 1000 and state.calls <= 510
    # A few pages do not read those of the whole part.
    state.calls = state.passed = 0
    assert not track(state, snapshots(["u3", None], 3, 2, "$2")) and state.calls == 4 and not state.passed
    assert not track(state, snapshots([f"new{i}" for i in range(10)], 3, 2)) and state.passed == 200


def test_pages_that_grow_and_shrink():
    state = Calls()
    sizes = [2, 40, 41, 41, 3, 0, 20]
    found = [track(state, snapshots(["a", "b"], n, size)) for n, size in enumerate(sizes)]
    kinds = [sorted({(r[0], r[3]) for r in rows}) for rows in found]
    assert [len(rows) // 2 for rows in found] == [0, 38, 1, 0, 38, 3, 20]
    assert kinds[1] == [("a", "added"), ("b", "added")] and kinds[4] == kinds[5] == [("a", "removed"), ("b", "removed")]
    assert len(state.maps["records"]) == 40 and len(state.maps["pages"]) == 2


def test_unseen_pages_of_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "PARTS", 1)
    for step in ([("a", 1), ("b", 1), ("c", 3)], [("d", 7)], [("a", 8), ("d", 9)], [("d", 28)]):
        run(spark, tmp_path, [(u, at(t), [promo(1)]) for u, t in step], unseen_ms=5 * DAY)
    assert found(spark, tmp_path) == [(u, "", "unseen", None) for u in "aabc"]
