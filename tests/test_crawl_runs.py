"""Runs from crawled pages: outcomes, report and totals of one micro-batch."""

import datetime as dt

from pagedrift.operators import state
from pagedrift.plans.run import crawl_snapshots, run_snapshots
from pagedrift.schemas import CRAWL, STATE, TARGET
from pagedrift.sources import tables
from pagedrift.streaming import runs

BASE = "https://a.example.com/"


def page(i, url, day, status=200, price="$100", kind="text/html"):
    html = f'<div class="promo"><h2>Deal {url}</h2><span class="price">{price}</span></div>'
    return (i, BASE + url, dt.datetime(2024, 1, day), status, "OK" if status == 200 else "Gone", kind, html)


def read(spark, out, name, run):
    return sorted((r.asDict() for r in spark.read.parquet(f"{out}/{name}/run_id={run}").collect()), key=lambda r: r.get("url") or "")


def test_failures_and_totals_go_with_the_run(spark, tmp_path):
    out = str(tmp_path)
    targets = spark.createDataFrame(
        [(BASE + u, s, n, None, e) for u, s, n, e in (
            ("a", ".promo", "A", True), ("b", ".promo", None, None), ("c", "a:hover", "C", True), ("d", ".promo", "D", False))], TARGET)
    crawls = [
        [page(1, "a", 1), page(2, "b", 1, 500), page(3, "c", 1), page(4, "d", 1), page(5, "unknown", 1)],
        [page(6, "a", 2, price="$300"), page(7, "b", 2), page(8, "a", 1, price="$900")],
        [page(9, "a", 3, 404), page(10, "b", 3, price="$999", kind="application/pdf")],
    ]
    totals = [(3, 1, 2, 0, 0), (2, 2, 0, 1, 1), (2, 0, 2, 0, 0)]
    for run, rows in enumerate(crawls):
        for _ in range(2 if run == 1 else 1):  # a repeated micro-batch leaves the same
            runs.crawl_batch(spark.createDataFrame(rows, CRAWL), targets, run, out, ["example.com"], mode="tree")
        found = read(spark, out, "stats", run)[0]
        assert tuple(found[k] for k in ("total", "successful", "failed", "with_changes", "notified")) == totals[run]
    assert [r["message"] for r in read(spark, out, "report", 0)] == [
        "No changes detected", "Failed to fetch content: HTTP 500: Gone", "Selector not supported: a:hover"]
    changed, first = read(spark, out, "report", 1)
    assert (changed["name"], changed["status"]) == ("A", "success") and changed["message"].startswith("Changes detected: ")
    assert (first["name"], first["message"]) == ("Unnamed Target", "No changes detected")
    assert read(spark, out, "stats", 1)[0]["summary"] == "2 targets processed, 2 successful, 1 with changes, 1 notification sent"
    # A failed page keeps its state.
    stored = {r["url"]: r["promos"][0]["price"] for r in tables.read_keyed(spark, f"{out}/state", STATE).collect()}
    assert stored == {BASE + "a": "$300", BASE + "b": "$100"}
    assert [r["error"] is None for r in read(spark, out, "outcomes", 2)] == [False, False]


def test_a_stream_takes_the_list_as_it_is(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    wanted = [(BASE + "a", ".promo", "A", None, True)]
    for run, rows in enumerate([[page(1, "a", 1), page(2, "b", 1)], [page(3, "a", 2), page(4, "b", 2)]]):
        spark.createDataFrame(rows, CRAWL).coalesce(1).write.mode("append").parquet(source)
        runs.start_crawl_runs(
            runs.read_crawls(spark, source), lambda: spark.createDataFrame(wanted, TARGET), out, ["example.com"], mode="tree"
        ).awaitTermination()
        assert [r["url"][-1] for r in read(spark, out, "outcomes", run)] == ["a", "b"][: len(wanted)]
        wanted.append((BASE + "b", "div.promo", "B", None, True))


def test_records_are_cut_out_of_a_page_once_for_all_outputs(spark):
    """Before, results, changes, state and history each searched the pages again (F28)."""
    targets = spark.createDataFrame([(BASE + u, ".promo", u, None, True) for u in "ab"], TARGET)
    crawls = [spark.createDataFrame(rows, CRAWL) for rows in (
        [page(1, "a", 1), page(2, "b", 1)], [page(3, "a", 2, price="$300"), page(4, "b", 2)])]
    (first, _), (later, _) = (crawl_snapshots(c, targets, ["example.com"], "tree") for c in crawls)
    run = run_snapshots(state.states_from_snapshots(later), state.states_from_snapshots(first))
    for rows in (run.results, run.changes, run.state, run.history):
        read = rows.inputFiles()
        assert read and all("/fresh-" in f for f in read)
    assert sorted((r["url"][-1], r["has_changes"]) for r in run.results.collect()) == [("a", True), ("b", False)]
    assert run.changes.count() == 2 and run.state.count() == 2 and run.history.count() == 1
