"""What is looked up once for a page, and searches that are cut short, give what the plain forms give."""

import random

import pytest
from pyspark.sql import functions as F

from pagedrift import patterns as P
from pagedrift.functions import text
from pagedrift.operators import deals, extract

PARTS = (
    "<p>", "</p>", '<div class="promo x">', "<DIV class='promo'>", '<div class="deal-card" id=top>', "</div>", "<title>A \n b</title>",
    "<", ">", "< ", " ", "  ", "\t", "\n", " ", "﻿", "　", ". ", "! ", "? ", ", ", ": ", "st. regis", "St.", "Four Seasons", "inn",
    "Grand Resort", "las vegas", "Maui", "Los Cabos", "$1,200.50", "$99", "$ 5", "$", "was $80", "25% off", "save up to $45", " save 20%",
    "from $59", "family vacation package", " Package", "Exclusive", "included extras", "$300 resort credit", "waived resort fee",
    "valid until 12/31/2025", "through Mar 4, 2025", "expires 2025-06-30", "book by Jan 3 2026", "dates: 1/2", "free breakfast", "bonus: tour",
    "&amp;", "&nbsp;", "&bull;", "&", "nbsp; ", "tant ", "or call ", "abc: ", "lovely rooms with ocean views", "of the", "\U0001f3e8", "é",
)


def pieces_of_text(seed, rows=1500):
    rng = random.Random(seed)
    return [rng.choice(("", " ")).join(rng.choice(PARTS) for _ in range(rng.choice((0, 2, 8, 25, 60)))) for _ in range(rows)] + [None]


@pytest.fixture(scope="module")
def texts(spark):
    frame = spark.createDataFrame([(t,) for t in pieces_of_text(3)], "t string")
    return frame.withColumn("c", F.regexp_replace("t", r"[\s\x{A0}\x{3000}\x{FEFF}]+", " ")).cache()


def same(frame, a, b, least):
    rows = frame.select(a.alias("a"), b.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert sum(len(r.a or "") for r in rows) > least


def test_blanks(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(P.java_regex(r"\A\s\z"))).collect()
    assert {r.c for r in found} == set(P.BLANK_CHARS)
    other = spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(P.java_regex(r"\A[^\S ]\z"))).collect()
    assert {r.c for r in other} == set(P.BLANK_CHARS) - {" "}


def test_tags_and_blanks_go_in_one_step(texts):
    def collapse(col):
        return F.regexp_replace(col, P.java_regex(r"\s{2,}|[^\S ]"), " ")

    same(texts, text.collapse_blanks(F.col("t")), collapse(F.col("t")), 10000)
    same(texts, text.html_to_text(F.col("t"), False), collapse(F.regexp_replace("t", P.TAG, " ")), 10000)
    assert texts.sparkSession.sql("select 1").select(F.length(text.html_to_text(F.lit("<b> " * 50000), False))).first()[0] == 1


def test_entities_and_artefacts(texts):
    plain = text.replace_entities(F.col("t"))
    for pattern, replacement in P.ARTIFACT_PREFIXES:
        plain = F.regexp_replace(plain, P.java_regex(pattern), replacement)
    same(texts, text.decode_entities(F.col("t")), text.trim_blanks(text.collapse_blanks(plain)), 10000)


def test_unsafe_parts_of_messages(texts):
    odd = texts.select(F.coalesce("t", F.lit("")).alias("t")).unionByName(texts.sparkSession.createDataFrame([(t,) for t in (
        "<SCRIPT a>x</script>", "a javaScript:b", "DATA:text/HTML,x", "say ONload = y", "on =", "<iframe s>y</iframe>z", "<object>", "<Embed s>",
        "<link r><meta n>", "javascript", "on load", "*a_b~`", "<scr<script>x</script>ipt>", "jajavascript:vascript:x", "onx\u00a0=1",
    )], "t string"))
    plain = F.col("t")
    for char, entity in P.ESCAPES:
        plain = F.replace(plain, F.lit(char), F.lit(entity))
    for pattern in P.UNSAFE_ESCAPED:
        plain = F.regexp_replace(plain, P.java_regex(pattern), "")
    same(odd, text.escape_markup(F.col("t")), F.regexp_replace(plain, "([*_~`])", r"\\$1"), 10000)


@pytest.mark.parametrize("pattern, ahead", [
    (P.DATE_MENTION, deals.DATE_STARTS), (P.NEAR_DATES, deals.NEAR_DATE_STARTS), (P.NEAR_SAVINGS, deals.SAVINGS_STARTS),
    (P.DEAL_PLACE, deals.PLACE_STARTS), *P.BLOCK_STARTS.items(),
])
def test_what_stands_ahead_loses_nothing(texts, pattern, ahead):
    same(texts, deals._find_all(F.col("t"), ahead + f"(?:{pattern})"), deals._find_all(F.col("t"), pattern), 50)


def test_prices_titles_and_packages(texts):
    whole = F.regexp_extract_all("c", F.lit(P.collapsed_regex(P.PRICE_MENTION)), F.lit(0))
    same(texts, deals._price_matches(F.col("c")), whole, 500)
    bare = F.regexp_extract("c", P.collapsed_regex(P.TITLE_BREAKS[0]), 1)
    ahead = P.TITLE_BREAKS[0].replace(r"\A", r"\A" + deals.TITLE_AHEAD[P.TITLE_BREAKS[0]], 1)
    same(texts, deals._find(F.col("c"), ahead, 1), bare, 50)
    sentences = F.split(F.col("c"), deals.SENTENCE)
    same(texts, F.transform(deals._package_deals(sentences), lambda d: d["description"]), F.filter(
        F.transform(
            F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(P.collapsed_regex(P.PACKAGE_DEAL)), F.lit(0)))),
            lambda m: text.trim_blanks(deals._find(m, P.PACKAGE_DEAL, 1)),
        ), lambda d: F.length(d).between(21, 149)), 5)


def test_words_that_are_patterns_are_found_as_before():
    assert deals._any("maui|oahu") == "(?i)(?=(?i:[mo][aa]))(?:maui|oahu)".replace("[aa]", "[a]")
    assert deals._any("ma?ui|oahu") == "(?i)(?:ma?ui|oahu)" and deals._any("x") == "(?i)(?:x)"


def test_the_text_of_a_page_is_taken_once_for_all_mentions(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(deals, "html_to_text", lambda *a, **k: taken.append(a) or text.html_to_text(*a, **k))
    rules = spark.createDataFrame([("a", "b", "c", None, None, None, 1)], ", ".join(
        f"{f} {'long' if f == 'ord' else 'string'}" for f in ("url_contains", "pattern", "title", "price", "savings", "location", "ord")))
    pages = spark.createDataFrame([("u", t) for t in pieces_of_text(4, 300)], "url string, html string")
    summary = deals.page_summary(pages, "site", "Site", rules)
    assert len(taken) == 2  # with scripts for the mentions, without for the deals
    html = F.col("html")
    same(summary.select("key_elements"), F.col("key_elements"), F.col("key_elements"), 50)
    apart = pages.select(F.concat(deals.price_mentions(html), deals.date_mentions(html), deals.place_mentions(html)).alias("k"))
    assert [r[0] for r in summary.select("key_elements").collect()] == [r.k for r in apart.collect()]


def test_a_constant_selector_is_read_once(texts):
    got = texts.select(extract.container_blocks(F.col("t"), ".promo, div.deal-card").alias("b"))
    assert "split(" not in str(got._jdf.queryExecution().analyzed())
    want = texts.select(extract.container_blocks(F.col("t"), F.concat(F.lit(".promo, "), F.lit("div.deal-card"))).alias("b"))
    assert got.collect() == want.collect() and got.where(F.size("b") > 0).count() > 50
    assert texts.select(extract.container_blocks(F.col("t"), "a:hover").alias("b")).where("b is not null").count() == 0
