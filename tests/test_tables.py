import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagedrift.functions import policy, text
from pagedrift.operators import digest, history, quota, report, state, targets
from pagedrift.plans.jobs import keep_existing
from pagedrift.plans.run import crawl_snapshots, run_results, run_snapshots
from pagedrift.schemas import FIELDS, HISTORY, SNAPSHOT, STATE, TARGET
from pagedrift.sources import tables

DOMAINS = ("example.com",)
GOOD = ("https://www.example.com/deals", ".promo", "Deals", None, True)


def ts(hour, day=8):
    return dt.datetime(2025, 1, day, hour, tzinfo=dt.timezone.utc)


def target_rows(spark, rows):
    return spark.createDataFrame(rows, TARGET)


def test_url_policy(values):
    cases = {
        "https://example.com": True, "https://a.b.example.com/x?y#z": True,
        "https://EXAMPLE.com:8443/": True, "https://user@example.com/": True,
        "http://example.com": False, "ftp://example.com": False, "not-a-url": False,
        "https://example.com.evil.org": False, "https://notexample.com": False,
        "https://evil.org/@example.com": False, "https://evil.org\\@example.com": False,
        "https://localhost": False, "https://127.0.0.1": False, "https://10.0.0.1": False,
        "https://172.16.0.1": False, "https://172.31.9.9": False, "https://192.168.0.1": False,
        "https://169.254.169.254/latest": False, "https://metadata.google.internal": False,
        "https://db.internal": False, "https://printer.local": False,
        "https://10.example.com": False, "https://172.32.example.com": True,
        "": False, None: False,
    }
    got = values(lambda u: policy.url_allowed(u, (*DOMAINS, "internal", "local")),
                 [(u,) for u in cases], ["string"])
    assert dict(zip(cases, got)) == cases


def test_target_problems(spark):
    rows = [
        (GOOD, None),
        (("https://example.com", ".x", None, None, None), None),
        ((None, ".x", None, None, None), "url missing"),
        (("https://example.com", "  ", None, None, None), "selector missing"),
        (("not-a-url", ".x", None, None, None), "url not allowed"),
        (("https://example.com", ".x{", None, None, None), "selector not allowed"),
        (("https://example.com", "a" * 201, None, None, None), "selector not allowed"),
        (("https://example.com", "a:expression(1)", None, None, None), "selector not allowed"),
        (("https://example.com", ".x", "", None, None), "name length"),
        (("https://example.com", ".x", "n" * 101, None, None), "name length"),
        (("https://example.com", ".x", "<b>n", None, None), "name unsafe"),
        (("https://example.com", ".x", "n", "x" * 501, None), "notes length"),
        (("https://example.com", ".x", "n", "<ScRipt>", None), "notes unsafe"),
    ]
    frame = target_rows(spark, [r for r, _ in rows])
    got = targets.check_targets(frame, DOMAINS).collect()
    assert [r["problem"] for r in got] == [p for _, p in rows]


def test_target_files(spark, tmp_path):
    path = str(tmp_path / "targets")
    bad = ("http://example.com", ".x", None, None, None)
    with pytest.raises(ValueError):
        tables.replace_targets(target_rows(spark, [GOOD, bad]), path, DOMAINS)
    tables.replace_targets(target_rows(spark, [GOOD, GOOD]), path, DOMAINS)
    assert tables.read_targets(spark, path, DOMAINS, strict=True).count() == 2
    with open(f"{path}/part-extra.json", "w") as f:
        f.write('{"url": "https://example.com", "selec\n')
    assert tables.read_targets(spark, path, DOMAINS).count() == 2
    assert tables.read_targets(spark, path, DOMAINS, strict=True).count() == 0
    assert tables.read_rejected_targets(spark, path, DOMAINS).count() == 1


def test_enabled_two_thirds(spark):
    rows = [(f"https://example.com/{i}", ".x", None, None, i % 3 != 0) for i in range(50)]
    assert targets.enabled_targets(target_rows(spark, rows)).count() == 33


def test_upsert_and_remove(spark):
    schema = "url string, pos long, name string"
    old = spark.createDataFrame([("a", 0, "a1"), ("b", 1, "b1"), ("a", 2, "a2")], schema)
    new = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("c", 2, "c1")], schema)
    rows = targets.upsert_targets(old, new).orderBy("pos").collect()
    assert [(r["url"], r["name"]) for r in rows] == [("a", "y"), ("b", "b1"), ("a", "a2"), ("c", "c1")]
    urls = spark.createDataFrame([("a",), ("z",)], "url string")
    assert [r["url"] for r in targets.remove_targets(old, urls).collect()] == ["b"]
    report_rows = {r["url"]: (r["n_removed"], r["found"]) for r in targets.removal_report(old, urls).collect()}
    assert report_rows == {"a": (2, True), "z": (0, False)}


def promo(i, price="$100", **changes):
    base = {"id": i, "title": f"Deal {i} for two", "perk": "Free breakfast every day", "dates": "",
            "price": price}
    return tuple((base | changes)[f] for f in ("id", *FIELDS))


def state_row(key, hash_, seen=ts(10), promos=()):
    return (key, f"https://example.com/{key}", hash_, list(promos), seen)


def test_state(spark):
    old = spark.createDataFrame([state_row("a", "h1"), state_row("b", "h2"), state_row("c", " ")], STATE)
    new = spark.createDataFrame(
        [state_row("a", "h1", ts(11)), state_row("a", "h9", ts(12)), state_row("b", "h2", ts(11)),
         state_row("c", "h3", ts(11)), state_row("d", "h4", ts(11)), state_row("e", "", ts(11)),
         state_row("f", "h6", ts(11), [promo("")])], STATE)
    merged = state.state_upsert(old, new, ["last_seen"]).collect()
    assert {r["url_key"]: r["hash"] for r in merged} == {"a": "h9", "b": "h2", "c": "h3", "d": "h4"}
    gated = state.hash_gate(new, old).collect()
    assert sorted((r["url_key"], r["hash"]) for r in gated if r["url_key"] in "abcd") == [
        ("a", "h9"), ("c", "h3"), ("d", "h4")]
    found = {r["url_key"]: r["previous"] for r in state.with_previous_state(new, old).collect()}
    assert found["b"]["hash"] == "h2" and found["c"] is None and found["d"] is None
    assert state.state_delete(old, new.where("url_key = 'a'")).count() == 2


def history_rows(spark, hours, key="a"):
    return spark.createDataFrame([(key, ts(h), f"h{h}", []) for h in hours], HISTORY)


def test_history(spark):
    rows = history_rows(spark, [12, 10, 14, 11, 13])
    newest = history.latest_history(rows, 2).orderBy(F.desc("ts")).collect()
    assert [r["hash"] for r in newest] == ["h14", "h13"]
    kept = history.prune_history(rows, 3)
    assert sorted(r["hash"] for r in kept.collect()) == ["h12", "h13", "h14"]
    assert sorted(r["hash"] for r in history.pruned_rows(rows, 3).collect()) == ["h10", "h11"]
    assert history.prune_counts(rows, 3).first().asDict() == {"url_key": "a", "n_kept": 3, "n_deleted": 2}
    assert history.prune_history(kept, 3).count() == 3  # pruning twice changes nothing
    # The same url and time overwrites; then pruning keeps the newest three.
    new = spark.createDataFrame([("a", ts(14), "new", []), ("a", ts(15), "h15", [])], HISTORY)
    stored = history.store_and_prune(rows, new, 3, ("hash",))
    assert sorted(r["hash"] for r in stored.collect()) == ["h13", "h15", "new"]
    # An invalid snapshot takes one of the places.
    invalid = spark.createDataFrame([("a", ts(16), " ", [])], HISTORY)
    assert history.latest_history(rows.unionByName(invalid), 2).count() == 1
    keys = spark.createDataFrame([("a",), ("q",)], "url_key string")
    assert history.clear_history(rows, keys).count() == 0
    counts = {r["url_key"]: r["n_deleted"] for r in history.clear_counts(rows, keys).collect()}
    assert counts == {"a": 5, "q": 0}


def test_quota_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", dt.datetime(2025, 1, 1, 0, i % 12, i % 60)) for i in range(300)]
    frame = spark.createDataFrame(rows, "seq long, key string, ts timestamp_ntz")
    got = {r["seq"]: r["allowed"] for r in quota.window_quota(frame, "key", "ts", "seq", 2).collect()}
    seen, expected = {}, {}
    for seq, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        window = (key, at.minute // 5)
        expected[seq] = seen.get(window, 0) < 2
        seen[window] = seen.get(window, 0) + 1
    assert got == expected


def test_reports(spark):
    schema = "name string, url string, success boolean, error string, has_changes boolean, summary string, notified boolean"
    rows = [("A", "u1", True, None, True, "2 new promotions", True), (None, "u2", True, None, False, "", False),
            ("", "u3", False, "HTTP 500", None, None, None), ("D", "u4", False, None, None, None, None)]
    results = spark.createDataFrame(rows, schema)
    assert report.run_summary(results.limit(3)).first()["summary"] == (
        "3 targets processed, 2 successful, 1 failed, 1 with changes, 1 notification sent")
    assert report.run_summary(results.where("false")).first()["summary"] == (
        "No enabled targets found in configuration")
    got = {r["url"]: (r["name"], r["status"], r["message"]) for r in report.run_report(results).collect()}
    assert got == {
        "u1": ("A", "success", "Changes detected: 2 new promotions"),
        "u2": ("Unnamed Target", "success", "No changes detected"),
        "u3": ("Unnamed Target", "failed", "HTTP 500"),
        "u4": ("D", "failed", "Processing failed"),
    }


CHANGES = ("url string, id string, pos long, change_type string, "
           "previous struct<title:string,perk:string,dates:string,price:string>, "
           "current struct<title:string,perk:string,dates:string,price:string>")


def digest_blocks(spark, changes, **counts):
    n = {"n_added": 0, "n_changed": 0, "n_removed": 0} | counts
    sources = spark.createDataFrame(
        [("u", counts.get("name"), "2025-01-18T10:25:00", True, "a summary")],
        "url string, name string, detected_at string, has_changes boolean, summary string")
    sources = sources.withColumns({k: F.lit(v) for k, v in n.items() if k != "name"})
    as_of = F.lit("2025-01-18 10:30:00").cast("timestamp")
    rows = digest.change_digest(sources, spark.createDataFrame(changes, CHANGES), as_of)
    return [(r["block_type"], r["text"]) for r in rows.orderBy("block_no").collect()]


def fields(i, **changes):
    base = {"title": f"Deal {i}", "perk": f"Benefit {i}", "dates": "", "price": f"${1000 + i}"}
    return tuple((base | changes)[f] for f in FIELDS)


def test_digest_of_ten_new(spark):
    blocks = digest_blocks(spark, [("u", f"p{i}", i, "added", None, fields(i)) for i in range(10)], n_added=10)
    assert blocks == [
        ("header", "🎯 Watched page"),
        ("context", "<u|View Page> • 5 minutes ago"),
        ("section", "*Changes detected:* a summary"),
        ("divider", None),
        ("section", "*🆕 New Promotions (10):*"),
        *[("section", f"*Deal {i}*\nBenefit {i}\n💰 ${1000 + i}") for i in range(3)],
        ("context", "_... and 7 more new promotions_"),
    ]


def test_digest_mixes_sections_within_three_items(spark):
    changes = [("u", "a", 1, "added", None, fields(1)), ("u", "r", 1, "removed", fields(4), None),
               ("u", "c", 5, "changed", fields(2), fields(2, price="$7", perk="")),
               ("u", "r2", 2, "removed", fields(5), None)]
    blocks = digest_blocks(spark, changes, n_added=1, n_changed=1, n_removed=2, name="Mine")
    assert blocks[0] == ("header", "🎯 Mine")
    assert [t for _, t in blocks[4:]] == [
        "*🆕 New Promotions (1):*", "*Deal 1*\nBenefit 1\n💰 $1001",
        "*🔄 Updated Promotions (1):*", "*Deal 2*\n~Benefit 2~\n💰 $7\n💰 ~$1002~",
        "*❌ Removed Promotions (2):*", "*Deal 4*\nBenefit 4\n💰 $1004",
        "_... and 1 more removed promotions_",
    ]
    # With the three items used up, a class gets no heading at all.
    full = digest_blocks(spark, [("u", f"p{i}", i, "added", None, fields(i)) for i in range(3)]
                         + [("u", "r", 1, "removed", fields(4), None)], n_added=3, n_removed=1)
    assert not any("Removed" in (t or "") for _, t in full)


def test_summary_digest_without_deals_lists_key_elements(spark):
    schema = ("url string, title string, meta_description string, kind string, content_length long, "
              "n_promos long, key_elements array<string>, deals array<struct<title:string,"
              "description:string,price:string,savings:string,location:string,dates:string>>, "
              "fetched_at string, fetch_ms int")
    deal = ("T", "D" * 120, "$5", "Save $1", "Maui", None)
    rows = [("u", "A_b", None, "Web Page", 1536, 2, ["Price: $5"], [], "x", 7),
            ("v", "T", "M", "Web Page", 10, 0, ["k"], [deal] * 6, "x", 7)]
    as_of = F.lit("2025-01-18 10:30:00").cast("timestamp")
    out = digest.summary_digest(spark.createDataFrame(rows, schema), as_of).orderBy("url", "block_no").collect()
    u = [r["text"] for r in out if r["url"] == "u"]
    v = [r["text"] for r in out if r["url"] == "v"]
    assert u[2] == "*Page Summary:*\n*Title:* A\\_b\n*Type:* Web Page\n*Content:* 2KB\n*Promotions:* 2 found"
    assert u[3:5] == [None, "*Key Elements Found:*\n• Price: $5"]
    assert v[6] == "*T*\n💰 $5 • 💸 Save $1\n📍 Maui\n_" + "D" * 100 + "..._"
    assert v[10] == "_... and 2 more deals found on the page_" and len(v) == 12


def test_crawl_to_results(spark, tmp_path):
    """Runs over stored crawls: first sight, no change, a price change, a failed fetch, a selector
    that is not supported."""
    page = '<div class="promo">Maui hotel package for two from {} per night</div>'
    wanted = target_rows(spark, [GOOD, ("https://example.com/off", ".promo", None, None, False)])
    schema = ("fetch_id long, url string, ts timestamp, status int, status_text string, "
              "content_type string, html string")

    def crawl(*rows):
        path = str(tmp_path / f"crawl-{rows[0][0]}")
        frame = spark.createDataFrame(
            [(i, GOOD[0], ts(10 + i), status, "Oops", "text/html", page.format(price))
             for i, status, price in rows] + [(99, "https://example.com/off", ts(1), 200, "OK", "text/html", "x")],
            schema)
        frame.write.parquet(path)
        return tables.read_crawl(spark, path)

    stored = tables.empty_state(spark)
    summaries, sizes = [], []
    for rows in ([(1, 500, "$1"), (2, 200, "$100")], [(3, 200, "$100")], [(4, 200, "$900")], [(5, 500, "$1")]):
        snapshots, failed = crawl_snapshots(crawl(*rows), wanted, DOMAINS)
        run = run_snapshots(state.states_from_snapshots(snapshots), stored)
        results = run_results(run, failed).collect()
        assert len(results) == 1
        summaries.append(results[0]["summary"] or results[0]["error"])
        sizes.append(run.history.count())
        stored = spark.createDataFrame(
            state.state_upsert(stored, run.state, ["last_seen"]).collect(), STATE)
    assert summaries == [
        "Initial state captured", "No material changes detected",
        "1 new promotion and 1 promotion removed", "Failed to fetch content: HTTP 500: Oops",
    ]
    assert sizes == [0, 0, 1, 0]
    assert stored.count() == 1  # the failed fetch left the state alone
    odd = target_rows(spark, [(GOOD[0], "div > .promo", "Deals", None, True)])
    snapshots, failed = crawl_snapshots(crawl((6, 200, "$1")), odd, DOMAINS)
    assert snapshots.count() == 0
    assert failed.first()["error"] == "Selector not supported: div > .promo"


def test_old_snapshots_are_ignored_and_short_pages_can_be(spark):
    def states(at, *promos):
        rows = spark.createDataFrame([("https://example.com/a", at, list(promos))], SNAPSHOT)
        return state.states_from_snapshots(rows)

    stored = states(ts(10), promo("1"), promo("2"))
    assert run_snapshots(states(ts(9), promo("1")), stored).results.count() == 0
    assert run_snapshots(states(ts(11)), stored).results.first()["n_removed"] == 2
    assert run_snapshots(states(ts(11)), stored, min_records=1).results.first()["n_removed"] == 0


def test_small_helpers(spark):
    frame = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert keep_existing(frame, ["c", "zz", "a"]).columns == ["c", "a"]
    assert frame.select(text.promos_hash(F.lit(None).cast("array<struct<id:string>>"))).first()[0] == (
        "4f53cda18c2baa0c")  # hash of []


def test_ten_runs_read_a_flat_amount_and_prune(spark, tmp_path):
    """Small runs over many urls: state and history stay current, bounded and cheap to read."""
    from pagedrift.sources import commits
    from pagedrift.streaming import runs

    out, every, keep = str(tmp_path), 3, 2
    latest = {}
    for n in range(10):
        urls = [f"https://example.com/{u}" for u in ((n,) if n else range(12))] + ["https://example.com/hot"]
        rows = [(u, ts(n), [promo(str(n), price=f"${100 + 300 * n}")]) for u in urls]
        latest |= {u: n for u in urls}
        runs.run_batch(spark.createDataFrame(rows, SNAPSHOT), n, out, keep=keep, buckets=4, every=every)
        if n in (4, 9):  # a repeated micro-batch leaves the same
            runs.run_batch(spark.createDataFrame(rows, SNAPSHOT), n, out, keep=keep, buckets=4, every=every)
        assert len(commits.latest(spark, f"{out}/state").manifest["folders"]) <= every
    state_rows = tables.read_keyed(spark, f"{out}/state", STATE, 10, buckets=4, every=every).collect()
    assert {r["url"]: int(r["promos"][0]["id"]) for r in state_rows} == latest
    kept = tables.read_keyed(spark, f"{out}/history", HISTORY, 10, buckets=4, every=every).collect()
    by_url = {}
    for r in kept:
        by_url.setdefault(r["url_key"], []).append(r["ts"])
    assert max(map(len, by_url.values())) == keep and len(by_url) == 10
    one = spark.createDataFrame([(state_rows[0]["url_key"],)], "url_key string")
    plan = tables.read_keyed(spark, f"{out}/state", STATE, 10, one, buckets=4, every=every)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:200]
    results = spark.read.parquet(f"{out}/results").where("url like '%hot'").orderBy("run_id").collect()
    assert [r["first_run"] for r in results] == [True] + [False] * 9
    assert all(r["n_added"] == 1 and r["n_removed"] == 1 for r in results[1:])


def test_stored_history_is_read_by_bucket_and_key(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i % 9}", ts(1, 1 + i % 20), "h", []) for i in range(90)], HISTORY)
    tables.write_keyed(rows, str(tmp_path), 0, buckets=8)
    found = tables.scan_keyed(spark, str(tmp_path), HISTORY, "u3")
    assert found.count() == rows.where("url_key = 'u3'").count()
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(url_key,u3)" in plan and "(bucket#" in plan


def test_run_plan_has_few_joins(spark):
    frame = spark.createDataFrame([("k", "https://example.com/a", "h", [promo("1")], ts(1))], STATE)
    run = run_snapshots(frame, frame)
    plan = run.results._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join ") <= 3


def test_counters_are_read_by_key_and_dropped_when_old(spark, tmp_path):
    from pagedrift.streaming import quotas

    flags = []
    for n in range(7):
        rows = [(10 * n + i, "u", ts(n // 2)) for i in range(2)] + [(100 + n, f"v{n}", ts(n))]
        frame = spark.createDataFrame(rows, "id long, user string, ts timestamp")
        quotas.decide_batch(frame, n, str(tmp_path), "user", "ts", "id", 3, 3_600_000, keep_windows=2, buckets=4, every=3)
        done = spark.read.parquet(f"{tmp_path}/decisions/run_id={n}").where("user = 'u'").orderBy("id").collect()
        flags.append([r["allowed"] for r in done])
    assert flags == [[True, True], [True, False]] * 3 + [[True, True]]
    left = tables.read_keyed(spark, f"{tmp_path}/used", quotas.USED, 7, None, "counter", 4, 3)
    hour = lambda n: int(ts(n).timestamp()) // 3600
    assert min(r["window"] for r in left.collect()) == hour(3)  # the batch's own; older ones are gone
