"""The registered jobs against their check SQL, and what their plans must not contain."""

import datetime as dt

import duckdb
import pytest
from conftest import SF_DIR

from oracle.sql import SQL
from pagedrift.plans.jobs import JOBS

TABLES = ("customer", "documents", "events", "nation", "orders", "pages", "part")
COMPARED = (
    "crawl_accept", "validate_targets", "state_upsert", "state_as_of", "history_append", "store_and_prune",
    "normalize_text", "filter_noise", "promos_from_text", "decode_entities", "validate_history", "latest_history", "similar_price", "similar_dates", "material_change", "page_promos",
    "generic_deals", "rule_deals", "page_summary", "summary_digest", "page_caps", "escape_markup",
    "price_mentions", "date_mentions", "location_mentions", "map_chunks", "detect_changes", "material_changes", "change_digest", "window_quota",
    "selector_tree", "selector_promos", "snapshot_run", "crawl_run", "history_scan", "stream_run", "stream_changes", "stream_unseen", "stream_quota", "stream_grants", "quota_closed",
    "quota_expiry", "rule_index", "crawl_stream", "crawl_stream_stats", "tenant_policy", "colocated_state",
)
# These write files or start streams while they are built.
BUILT_BY_RUNNING = {
    "scan_targets", "replace_targets", "state_as_of", "digest_sink", "change_digest", "history_scan", "stream_run", "stream_changes",
    "stream_unseen", "stream_grants", "quota_closed", "stream_quota", "quota_expiry", "crawl_stream", "crawl_stream_stats",
    "colocated_state",
}


def test_every_job_has_check_sql():
    assert set(JOBS) == set(SQL)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def plain(value):
    return value.isoformat() if isinstance(value, dt.datetime) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(table, key=str)


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, duck, name):
    frame = JOBS[name](spark, SF_DIR)
    got = rows(frame.columns, frame.collect())
    result = duck.execute(SQL[name])
    expected = rows([c[0] for c in result.description], result.fetchall())
    assert got == expected
    assert got[1]


def test_no_cross_joins_and_no_python_in_batch_plans(spark, capsys):
    for name in sorted(set(JOBS) - BUILT_BY_RUNNING):
        JOBS[name](spark, SF_DIR).explain("simple")
        plan = capsys.readouterr().out
        assert plan.startswith("== Physical Plan =="), name
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
        assert "Python" not in plan and "InPandas" not in plan, name


def test_every_rule_has_something_to_do(spark):
    """The checked inputs of the text and quota jobs reach every rule."""
    from pyspark.sql import functions as F

    from pagedrift import patterns as P
    from pagedrift.functions.text import normalize_text
    from pagedrift.sources.derived import derived

    texts = derived(spark, SF_DIR, "noted_texts")
    rules = [P.java_regex(p) for p in (*P.NORMALIZE_REMOVALS, *P.NOISE_REMOVALS, P.NOISE_EDGE_MARKS)]
    assert all(texts.agg(*[F.count_if(F.col("text").rlike(p)) for p in rules]).first())
    normal = texts.select(normalize_text(F.col("text")).alias("t"))
    found = [P.java_regex(p) for p in (P.BLOCK_PERK, P.BLOCK_DATES, P.BLOCK_PRICE)]
    for row in (normal.agg(*[F.count_if(c) for c in cs]).first()
                for cs in ([F.col("t").rlike(p) for p in found], [~F.col("t").rlike(p) for p in found])):
        assert all(row)
    pages = derived(spark, SF_DIR, "marked_pages")
    assert all(pages.agg(*[F.count_if(F.contains(F.col("html"), F.lit(e))) for e, _ in P.ENTITIES]).first())
    escaped = F.col("html")
    for char, entity in P.ESCAPES:
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    assert all(pages.agg(*[F.count_if(escaped.rlike(P.java_regex(p))) for p in P.UNSAFE_ESCAPED]).first())
    for name, flag in (("window_quota", "allowed"), ("validate_history", "valid"), ("similar_price", "similar")):
        counts = {r[flag]: r["count"] for r in JOBS[name](spark, SF_DIR).groupBy(flag).count().collect()}
        assert min(counts[True], counts[False]) > 10, name
