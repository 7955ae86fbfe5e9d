"""Elements by structural selectors, and pages watched through them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagedrift.operators.extract import container_blocks
from pagedrift.operators.selectors import element_blocks, element_spans, understood
from pagedrift.plans.run import crawl_snapshots
from pagedrift.schemas import CRAWL, TARGET

NESTED = (
    '<div class="deals x"><div class="promo">A<div>in</div>B</div><p class=promo>C<p>D</div>'
    '<div class="promo">E</div><br class=promo><!-- <div class="promo"> -->'
    '<ul><li class="promo">1<li class="promo">2</ul><a HREF="x/y.html" title="class=\'promo\'">q</a>'
)
CASES = [
    (NESTED, ".promo", ["A<div>in</div>B", "C", "E", "", "1", "2"]),
    (NESTED, "div.deals > .promo", ["A<div>in</div>B", "C"]),
    (NESTED, "div.deals>p", ["C", "D"]),
    (NESTED, ".deals div", ["A<div>in</div>B", "in"]),
    (NESTED, "div > div > div", ["in"]),
    (NESTED, "ul > li.promo", ["1", "2"]),
    (NESTED, "div li", []),
    (NESTED, "* > li", ["1", "2"]),
    (NESTED, "a , p", ["C", "D", "q"]),
    (NESTED, '[href$=".html"]', ["q"]),
    (NESTED, '[title="class=\'promo\'"]', ["q"]),
    (NESTED, "[title*=promo]", ["q"]),
    (NESTED, "[class^=de]", [NESTED[len('<div class="deals x">') : NESTED.index('</div><div class="promo">E')]]),
    (NESTED, "[class~=x] > .promo", ["A<div>in</div>B", "C"]),
    # A closing tag ends what is open within its element; a stray one means nothing.
    ("<b class=p>x<i class=p>y</b>z</i><i>w", ".p", ["x<i class=p>y", "y"]),
    ("</div><div class='p'>a</p></span>b</div>c", ".p", ["a</p></span>b"]),
    # Open at the end of the page; a mark in a value; characters beyond the first plane.
    ("<div data-x=\"a>b\" class='p'>\U0001f600é<img src=q>t", ".p", ["\U0001f600é<img src=q>t"]),
    ("<script>'<p class=p>'</script><style><p class=p></style><p class=p>1", ".p", ["1"]),
    ("<p class=p/>x</p><P CLASS='q p'/>", ".p", ["", ""]),
    ("<a href=x/y>1</a><a href=x>2</a>", "[href=x]", ["2"]),
    ("<div class=promotion>no</div><div class='my-promo'>no</div>", ".promo", []),
    ("<div id=a.b>1</div><div id=a>2</div>", "#a", ["2"]),
    ("<td>1<table><td>in</table><td>2", "td", ["1<table><td>in</table>", "in", "2"]),
    ("", ".p", []), ("no tags < at > all", ".p", []), (None, ".p", None),
    (NESTED, "> p", None), (NESTED, "a:hover", None), (NESTED, "", None), (NESTED, "p >", None), (NESTED, "a,,b", None),
    (NESTED, "a + b", None), (NESTED, "[a=\"]", None), (NESTED, None, None),
]


def test_elements(values):
    found = values(element_blocks, [c[:2] for c in CASES], ["string", "string"])
    assert [(c[:2], f) for c, f in zip(CASES, found)] == [(c[:2], c[2]) for c in CASES]


def test_spans_of_a_constant_selector(spark):
    row = spark.createDataFrame([("<a><b>x</b></a>",)], "h string").select(element_spans(F.col("h"), "a, b").alias("s")).first()
    assert [tuple(s) for s in row["s"]] == [(3, 11), (6, 7)]


def test_many_steps(spark):
    deep = "<div>" * 70 + "x" + "</div>" * 70
    frame = spark.createDataFrame([(deep, "div " * 60), (deep, "div " * 61)], "h string, s string")
    found = [r[0] for r in frame.select(F.size(element_blocks(F.col("h"), F.col("s")))).collect()]
    assert found == [11, -1] or found == [11, None]
    assert [r[0] for r in frame.select(understood(F.col("s"))).collect()] == [True, False]


def test_a_long_attribute_and_many_attributes(values):
    long = f"<div class='p' data-x='{'y' * 300000}' {' '.join(f'a{i}=1' for i in range(300))}>t</div>"
    assert values(element_blocks, [(long, "div.p")], ["string", "string"]) == [["t"]]


def test_tree_mode_cuts_containers_at_their_own_end(spark):
    frame = spark.createDataFrame([("<div class=promo><b>x</b><div>y</div>z</div>w",)], "h string")
    cut = {m: frame.select(container_blocks(F.col("h"), ".promo", m).alias("b")).first()["b"] for m in ("lazy", "tree")}
    assert cut["tree"] == ["<b>x</b><div>y</div>z"]
    assert cut["lazy"] != cut["tree"]


@pytest.mark.parametrize("mode", ["lazy", "tree"])
def test_pages_watched_by_a_path(spark, mode):
    html = "<div class=deals><div class=promo><h2>Spring</h2><p>Free breakfast</p></div></div><div class=promo><h2>Other</h2></div>"
    pages = [(i, f"https://a.example.com/{i}", dt.datetime(2024, 1, 1), 200, "OK", "text/html", html) for i in range(3)]
    crawl = spark.createDataFrame(pages, "fetch_id long, url string, ts timestamp, status int, status_text string, content_type string, html string")
    wanted = [(p[1], s, "t", None, True) for p, s in zip(pages, [".deals > .promo", ".promo", "a:hover"])]
    targets = spark.createDataFrame(wanted, "url string, selector string, name string, notes string, enabled boolean")
    assert set(targets.columns) == {f.name for f in TARGET} and set(crawl.columns) >= {f.name for f in CRAWL}
    snapshots, failed = crawl_snapshots(crawl, targets, ["example.com"], mode=mode)
    found = {r["url"][-1]: [p["title"] for p in r["promos"]] for r in snapshots.collect()}
    errors = {r["url"][-1]: r["error"] for r in failed.collect()}
    if mode == "tree":
        assert found == {"0": ["Spring"], "1": ["Spring", "Other"]} and errors == {"2": "Selector not supported: a:hover"}
    else:
        assert set(found) == {"1"} and set(errors) == {"0", "2"}
