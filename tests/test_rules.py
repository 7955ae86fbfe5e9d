"""Rule codes found by the index, against a plain search and against the array form."""

import random

from pyspark.sql import functions as F

from pagedrift.operators import deals

RULES = "url_contains string, pattern string, title string, price string, savings string, location string, ord long"


def rules_of(frame):
    return {r["url"]: [(x["ord"], x["url_contains"]) for x in r["rules"]] for r in frame.collect()}


def plain(urls, rules):
    out = {}
    for url in urls:
        hit = min(((o, c) for c, o in rules if url is not None and c is not None and c in url), default=None)
        out[url] = sorted((o, c) for c, o in rules if c == hit[1]) if hit else []
    return out


def made(spark, urls, rules):
    pages = spark.createDataFrame([(u, "<p>x</p>") for u in urls], "url string, html string")
    return pages, spark.createDataFrame([(c, "p", f"t{o}", None, None, None, o) for c, o in rules], RULES)


def test_index_equals_a_plain_search(spark):
    pick = random.Random(6)
    text = lambda n: "".join(pick.choice("ab/é\U0001f600") for _ in range(n))
    urls = [text(pick.randrange(40)) for _ in range(150)] + [None, "", "a" * 3000, "x" * 50]
    rules = [(text(pick.randrange(1, 14)), i) for i in range(300)] + [("a", 500), ("a", 501), (None, 0), ("zz", 1), ("aaaaaaaaa", 400)]
    pages, table = made(spark, urls, rules)
    assert rules_of(deals.indexed_rules(pages, table)) == plain(urls, rules)
    # An empty code is in every url.
    assert rules_of(deals.indexed_rules(pages, made(spark, urls, [("", 3)])[1])) == plain(urls, [("", 3)])
    assert rules_of(deals.indexed_rules(pages, table.limit(0))) == dict.fromkeys(urls, [])


def test_two_hundred_thousand_rules(spark, monkeypatch):
    n = 200_000
    rules = spark.range(n).select(
        F.concat(F.lit("/offer/"), "id", F.lit("/")).alias("url_contains"), F.lit("p").alias("pattern"),
        F.concat(F.lit("t"), "id").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("price", "savings", "location")],
        (n - F.col("id")).alias("ord"),
    )
    urls = [f"https://example.com/offer/{i * 1777 % (2 * n)}/x" for i in range(200)] + ["https://example.com/offer/7/offer/9/"]
    pages, _ = made(spark, urls, [])
    found = deals.with_rules(pages, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    by_index = rules_of(found)
    assert by_index[urls[-1]] == [(n - 9, "/offer/9/")] and 80 < sum(r != [] for r in by_index.values()) < 200
    monkeypatch.setattr(deals, "ARRAY_RULES", n)
    assert rules_of(deals.with_rules(pages, rules)) == by_index


def test_the_switch_changes_nothing(spark, monkeypatch):
    urls = [f"https://example.com/{i}" for i in range(60)]
    pages, table = made(spark, urls, [(f"/{i}", 100 - i) for i in range(40)])
    small = rules_of(deals.with_rules(pages, table))
    monkeypatch.setattr(deals, "ARRAY_RULES", 39)
    assert rules_of(deals.with_rules(pages, table)) == small == plain(urls, [(f"/{i}", 100 - i) for i in range(40)])


def test_the_grams_of_a_url_are_taken_once_and_only_those_of_codes_move(spark):
    """Before, the lookup stood in the plan twice, and every gram of a url was moved (F25)."""
    urls = [f"https://example.com/offer/{i}" for i in range(60)]
    pages, table = made(spark, urls, [(f"offer/{i}", 100 - i) for i in range(40)])
    found = deals.indexed_rules(pages, table)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert rules_of(found) == plain(urls, [(f"offer/{i}", 100 - i) for i in range(40)])
    grams = spark.createDataFrame([(u, u[i : i + 8]) for u in urls for i in range(len(u) - 7)], "url string, gram string")
    held = spark.createDataFrame([("offer/12",)], "gram string")
    assert {r["gram"] for r in deals._may_hold(grams, held).collect()} == {"offer/12"}
