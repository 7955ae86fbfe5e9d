import pytest
from pyspark.sql import functions as F

from pagedrift.operators import deals, extract

STRUCTURED = """
<div class="promotion">
  <h2 class="title">Hawaii Package</h2>
  <div class="perk">Free breakfast    1,234 views this week</div>
  <div class="dates">Valid through March 2024</div>
  <div class="price">From $899 per person   utm_source=email</div>
</div>
<div class="promotion">
  <h2 class="title">Alaska Cruise</h2>
  <p>All meals <b>included</b></p>
</div>
"""


def promos(spark, html, selector, mode="lazy"):
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    rows = extract.extract_promos(pages, selector, mode).orderBy("pos").collect()
    return [(r["title"], r["perk"], r["dates"], r["price"]) for r in rows]


def test_lazy_container_ends_at_first_closing_tag(spark):
    assert [p[0] for p in promos(spark, STRUCTURED, ".promotion")] == [
        "Hawaii Package", "Alaska Cruise",
    ]


def test_balanced_container_has_all_fields(spark):
    assert promos(spark, STRUCTURED, ".promotion", "balanced") == [
        ("Hawaii Package", "Free breakfast this week", "Valid through March 2024",
         "From $899 per person"),
        ("Alaska Cruise", "All meals included", "", ""),
    ]


def test_last_container_only(spark):
    assert [p[0] for p in promos(spark, STRUCTURED, ".promotion", "last")] == ["Alaska Cruise"]


def test_class_list_and_per_row_selector(spark):
    html = '<i class="a">First block text</i><i class="b-c">Second block text</i><i class="d">x</i>'
    assert [p[0] for p in promos(spark, html, ".a, .b-c")] == ["First block text", "Second block text"]
    pages = spark.createDataFrame(
        [("u", html, ".a"), ("v", html, ".d"), ("w", html, ".b-c")], "url string, html string, selector string"
    )
    rows = pages.select("url", extract.page_promos(F.col("html"), F.col("selector")).alias("p"))
    got = {r["url"]: [p["title"] for p in r["p"]] for r in rows.collect()}
    assert got == {"u": ["First block text"], "v": [], "w": ["Second block text"]}


def test_text_fallback(spark):
    html = """<div class="promotion">Hawaii Vacation Special
      Free breakfast and airport transfers included
      Valid through March 31, 2024
      Starting from $899 per person</div>"""
    title, perk, dates, price = promos(spark, html, ".promotion")[0]
    assert title.startswith("Hawaii Vacation Special Free breakfast")
    assert perk.startswith("Free breakfast")
    assert dates.startswith("Valid through March 31, 2024")
    assert price == "from $899"  # the leftmost match wins


@pytest.mark.parametrize("html", ["", "<div>No promotions here</div>", '<p class="promotion"> </p>'])
def test_no_records(spark, html):
    assert promos(spark, html, ".promotion") == []


def test_text_lines_become_title_and_perk(values):
    rows = values(extract.promo_from_text, [("Cruise week\nSun and sea",), ("too short",)], ["string"])
    assert (rows[0]["title"], rows[0]["perk"]) == ("Cruise week", "Sun and sea")
    assert rows[1] is None


def column(values, function, html):
    return values(function, [(html,)], ["string"])[0]


def test_page_head(values):
    html = "<title> A <b>b</b> </title><meta name='description' content=' Nice '>"
    assert column(values, deals.page_title, html) == "A b"
    assert column(values, deals.page_meta, html) == "Nice"
    assert column(values, deals.page_title, "<p>") == "No title found"
    assert column(values, deals.page_meta, "<p>") is None


def test_price_mentions(values):
    html = (
        "<p>Rooms starting at just $99. Suites $250 per night now. Or $7!</p>"
        "<p>Pay $1,250.50 today</p>"
    )
    assert column(values, deals.price_mentions, html) == [
        "starting at just $99", "$250 per night now", "Price: $1,250.50",
    ]


def test_place_mentions_share_one_cap(values):
    html = "".join(f"A long enough sentence number {i} on Maui beaches. " for i in range(4))
    html += "".join(f"Some more words in front of Hawaii trip {i}. " for i in range(3))
    assert len(column(values, deals.place_mentions, html)) == 7
    found = column(values, lambda c: deals.place_mentions(c, limit=5), html)
    assert len(found) == 5
    assert [("Hawaii" in f, "Maui" in f) for f in found] == [(True, False)] * 3 + [(False, True)] * 2


def test_deals(values):
    html = (
        "<p>Maui: Ocean View Resort and Spa with breakfast daily $1,299.00 per person. </p>"
        "<p>The great and sunny family getaway by the lake from $450.</p>"
        "<p>Members booking the mountain lodge tour save up to $75 today.</p>"
        "<p>Every guest gets all included extras such as parking and wifi for two guests.</p>"
    )
    found = column(values, deals.generic_deals, html)
    assert found[0]["location"] == "Maui" and found[0]["price"] == "$1,299.00"
    # A leading word of two to four letters and a colon counts as an artefact.
    assert found[0]["title"] == "Ocean View Resort and Spa with breakfast daily"
    assert any(d["price"] == "$450" and d["savings"] is None for d in found)
    assert any(d["savings"] == "Save up to $75" for d in found)
    assert found[-1]["title"].startswith("included extras")


def test_deal_limit_and_rules(spark, values):
    html = "".join(f"<p>Guests save now and again they save {i}% here.</p>" for i in range(30))
    assert len(column(values, deals.generic_deals, html)) == 30
    assert len(column(values, lambda c: deals.generic_deals(c, 8), html)) == 8
    rules = spark.createDataFrame(
        [("CODE", "(?i)gift card", "Gift", "$5", None, "Here", 1), ("x/CO", "gift", "Never", None, None, None, 2),
         ("CODE", "no such", "None", None, None, None, 3)],
        "url_contains string, pattern string, title string, price string, savings string, location string, ord bigint")
    pages = spark.createDataFrame([("x/CODE", "<p>A gift  card</p>"), ("x", html)], "url string, html string")

    def found(table):
        rows = deals.with_rules(pages, table)
        got = rows.select("url", deals.page_deals(F.col("html"), F.col("rules")).alias("d")).collect()
        return {r["url"]: r["d"] for r in got}

    got = found(rules)
    assert [(d["title"], d["description"]) for d in got["x/CODE"]] == [("Gift", "gift card")]
    assert len(got["x"]) == 30 and len(found(rules.limit(0))["x"]) == 30


def test_selectors(spark):
    html = (
        '<div id="deals" class="box promo"><h2>One</h2></div><section data-x="1"><h2>Two</h2></section>'
        '<DIV class="deal-card">Three</DIV><article ID=big>Four</article><divider>Five</divider>'
    )
    cases = {
        ".promo": ["<h2>One"], "div": ["<h2>One", "Three"], "#deals": ["<h2>One"], "div.promo": ["<h2>One"],
        "section": ["<h2>Two"], "[data-x]": ["<h2>Two"], "section[data-x]": ["<h2>Two"], "div[data-x]": [],
        ".promo, .deal-card": ["<h2>One", "Three"], "#big": ["Four"], "div#deals.box": ["<h2>One"], ".none": [],
        "div > h2": None, "body .promo": None, "a:hover": None, "[a=b]": None, "": None, ".a,": None, "*.promo": ["<h2>One"],
    }
    frame = spark.createDataFrame([(s, html) for s in cases], "s string, html string")
    rows = frame.select("s", extract.container_blocks(F.col("html"), F.col("s")).alias("b")).collect()
    assert {r["s"]: r["b"] for r in rows} == cases


def test_a_changed_word_list_is_noticed():
    with pytest.raises(ValueError):
        deals._search(F.lit("x"), "(?:a|b)", ["x"], starts={"(?:c|d)": "[cd]"})


def test_faster_searches_find_the_same(spark):
    """The search helpers against the bare patterns, on generated sentences."""
    import random

    from pagedrift import patterns as P

    rng = random.Random(7)
    words = ("the grand Hotel inn $5 $1,200.50 from save up to 10% resort credit fee waived package "
             "Maui cancun included extras deal vacation . ! today. $900.50 St. REGIS 2.15 st. regis four seasons a of with").split()
    texts = [(" ".join(rng.choices(words, k=rng.randrange(5, 160))),) for _ in range(600)]
    frame = spark.createDataFrame(texts, "t string")
    t = F.col("t")
    near, far, hotel = (deals._dollar_within(*a) for a in ((40,), (300,), (300, "!?")))
    cents = deals.SENTENCE_WITH_CENTS
    pairs = {
        "hotel": (P.HOTEL_DEAL, deals._search(
            t, P.HOTEL_DEAL, [deals.A_PRICE, "(?i)" + P.HOTEL_WORDS], cents, hotel, {"(?:" + P.HOTEL_WORDS: deals._starts(P.HOTEL_WORDS.split("|"))})),
        "place": (P.PLACE_DEAL, deals._search(
            t, P.PLACE_DEAL, [deals.A_PRICE, "(?i)" + P.HOTEL_PLACES], cents, hotel,
            {"(?:" + P.HOTEL_PLACES: deals._starts(P.HOTEL_PLACES.split("|"))})),
        "package": (P.PACKAGE_DEAL, deals._search(
            t, P.PACKAGE_DEAL, [r"(?i)from\s+\$"], deals.SENTENCE, far, deals.PACKAGE_STARTS)),
        "savings": (P.SAVINGS_DEAL, deals._search(t, P.SAVINGS_DEAL, [r"(?i)\ssave\s"])),
        "credit": (P.CREDIT_DEAL, deals._search(
            t, P.CREDIT_DEAL, [r"(?i)resort\s+(?:credit|fee)|included\s+extras"], starts=deals.CREDIT_STARTS)),
        "price": (P.PRICE_MENTION, deals._search(t, P.PRICE_MENTION, [deals.A_PRICE], cents, near)),
        "mention": (r"(?i)[^.!?]{20,80}maui[^.!?]{0,40}", deals._search(
            t, r"(?i)[^.!?]{20,80}maui[^.!?]{0,40}", ["(?i)maui"])),
    }
    row = frame.agg(
        *[F.sum(F.size(fast)).alias(f"n_{name}") for name, (_, fast) in pairs.items()],
        *[F.bool_and(fast == deals._find_all(t, bare)).alias(name) for name, (bare, fast) in pairs.items()],
    ).first()
    assert all(row[name] for name in pairs) and all(row[f"n_{name}"] > 0 for name in pairs)


def test_a_field_is_found_as_by_the_bare_pattern(spark):
    """The gate and the search within the match change nothing; every pattern is searched for in the block once."""
    from pagedrift import patterns as P
    from pagedrift.functions.text import strip_tags

    blocks = [
        '<h2>A</h2><p CLASS="x Perk-y">b</p><i class="perk">c</i>', '<p class="perks">no</p><b class="offer"></b>', 'class="perk"',
        '<p\nclass="a\nbenefit"\nid="q">two\nlines</p>', '<i class="x" title="class="><b class="deal-text offer">d</b></i>', "<p>e</p>",
        '<i class="perk">never closed', '<i class="superperk">f</i><p>g</p>', "", '<h1></h1><i class="title">t</i>', "<h1>open<i class=\"headline\">u</i>",
    ]
    rows = spark.createDataFrame(list(enumerate(blocks)), "n int, block string")
    block = F.col("block")
    for patterns in ([P.class_element(P.FIELD_CLASSES["perk"]), P.PERK_PARAGRAPH], [P.TITLE_HEADING, P.class_element(P.FIELD_CLASSES["title"])]):
        bare = F.lit("")
        for pattern in reversed(patterns):
            java = P.java_regex(pattern)
            bare = F.when(block.rlike(java), strip_tags(F.regexp_extract(block, java, 1))).otherwise(bare)
        got = rows.select(bare.alias("a"), extract._first_field(block, patterns).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got] and len({r["a"] for r in got}) > 2


def test_records_are_read_within_the_page(spark, capsys):
    """One row per record from the start; a block is no row of its own."""
    from pagedrift.plans.jobs import JOBS

    JOBS["build_promos"](spark, "/root/testdata/sf0.001").explain("simple")
    assert capsys.readouterr().out.count("Generate") == 1
