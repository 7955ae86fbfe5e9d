"""Allow-lists of tenants, bucketed state, and texts of messages that are not cut."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from pagedrift.functions.policy import host_domains, url_allowed
from pagedrift.operators import digest, state
from pagedrift.operators.targets import tenant_urls
from pagedrift.plans.jobs import JOBS, _states
from pagedrift.sources import tables


def test_host_domains(values):
    assert values(host_domains, [("a.b.c",), ("c",), ("",), (None,)], ["string"]) == [["a.b.c", "b.c", "c"], ["c"], [""], None]


def test_tenants_see_their_own_domains(spark):
    cases = [
        ("t1", "https://example.com/x", True), ("t1", "https://a.b.example.com", True), ("t1", "https://notexample.com", False),
        ("t2", "https://example.com/x", False), ("t2", "https://shop.example.com/x", True), ("t2", "http://shop.example.com/x", False),
        ("t1", "https://user:pw@EXAMPLE.com:8443/", True), ("t3", "https://example.com", False), (None, "https://example.com", False),
        ("t4", "https://localhost/x", False), ("t4", "https://10.1.2.3/", False), ("t4", "https://db.internal/", False),
        ("t1", None, False), ("t1", "https://example.com/x", True), ("t5", "https://xn--bcher-kva.example.com", True),
    ]
    urls = spark.createDataFrame([(t, u, i) for i, (t, u, _) in enumerate(cases)], "tenant string, url string, n int")
    domains = spark.createDataFrame(
        [("t1", "example.com"), ("t1", "Example.COM"), ("t2", "shop.example.com"), (None, "example.com"), ("t4", "localhost"),
         ("t4", "10.1.2.3"), ("t4", "db.internal"), ("t5", "com"), ("t1", None)], "tenant string, domain string")
    out = tenant_urls(urls, domains).orderBy("n").collect()
    assert [r["allowed"] for r in out] == [a for _, _, a in cases]
    # With one list for all it is the fixed policy.
    one = domains.where("tenant = 't1'")
    fixed = urls.withColumn("tenant", F.lit("t1"))
    for r in tenant_urls(fixed, one).withColumn("fixed", url_allowed(F.col("url"), ["example.com"])).collect():
        assert r["allowed"] == r["fixed"]


def test_the_plan_does_not_grow_with_the_list(spark):
    urls = spark.createDataFrame([("t", "https://a.example.com")], "tenant string, url string")
    plans = []
    for n in (3, 30_000):
        domains = spark.range(n).select(F.lit("t").alias("tenant"), F.concat(F.lit("d"), "id", F.lit(".com")).alias("domain"))
        plan = tenant_urls(urls, domains)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        plans.append(len(plan))
    assert abs(plans[0] - plans[1]) < 200


@pytest.fixture
def no_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
            "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sides(plan):
    """For each child of the first join: how many exchanges and sorts lie below it."""
    todo = [plan]
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            texts = [c.toString() for c in children]
            return [(t.count("Exchange"), t.count("Sort ")) for t in texts]
        todo += children
    return []


def test_stored_state_is_neither_moved_nor_sorted(spark, no_broadcast):
    name = tables.store_bucketed(_states(spark, SF_DIR, "prev"), "state", "url_key", 16)
    current = _states(spark, SF_DIR, "curr").select("url_key", "url", "hash")
    for job, keys in ((state.with_previous_state, "previous"), (state.hash_gate, None)):
        joined = job(current, spark.read.table(name))
        (moved, _), (stored, sorted_) = sides(joined._jdf.queryExecution().executedPlan())
        assert (moved, stored, sorted_) == (1, 0, 0)
        assert joined.rdd.getNumPartitions() == 16
    plain = state.hash_gate(current, _states(spark, SF_DIR, "prev"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def test_long_texts_of_messages(spark):
    long = "x" * 5000
    record = F.struct(*[F.lit(v).alias(k) for k, v in (("id", "1"), ("title", long), ("perk", ""), ("dates", ""), ("price", ""))])
    frame = spark.range(1)
    assert len(frame.select(digest.record_text(record).alias("t")).first()["t"]) < 3010
    assert long in frame.select(digest.record_text(record, None).alias("t")).first()["t"]
    for limit, n in ((None, 5000), (4000, 4000)):
        rows = frame.select(
            F.lit("u").alias("url"), F.lit(long).alias("title"), F.lit("k").alias("kind"), F.lit(2048).alias("content_length"),
            F.lit(0).alias("n_promos"), F.lit(long).alias("meta_description"), F.array(F.lit(long)).alias("key_elements"),
            F.array().cast("array<struct<title:string,description:string,price:string,savings:string,location:string,dates:string>>").alias("deals"),
            F.lit("2024-01-30T00:00:00").alias("fetched_at"), F.lit(5).alias("fetch_ms"))
        texts = [r["text"] or "" for r in digest.summary_digest(rows, F.lit("2024-01-31").cast("timestamp"), text_limit=limit).collect()]
        assert sum(t.count("x") >= n for t in texts) == 3 and max(t.count("x") for t in texts) <= n + 2


def test_jobs_of_policy_tables_have_both_outcomes(spark):
    counts = {r["allowed"]: r["count"] for r in JOBS["tenant_policy"](spark, SF_DIR).groupBy("allowed").count().collect()}
    assert min(counts[True], counts[False]) > 50
