"""Several selectors over one reading of a page's tags."""

from pyspark.sql import functions as F

from pagedrift.operators import extract, selectors


def test_selectors_share_the_tags_of_a_page(spark):
    pages = spark.createDataFrame(
        [(1, '<div class="a"><p>x<p>y<br class="a"></div><b>z'), (2, None), (3, ""), (4, "<ul><li>1<li class=a>2</ul>")],
        "page_id int, html string",
    )
    asked = ("div > p", ".a", "b", "li", "p:x")
    got = extract.explode_elements(pages, asked)
    assert str(got._jdf.queryExecution().analyzed()).count("split(html") == 1
    one = [extract.explode_containers(pages, s, "tree").withColumn("selector", F.lit(s)) for s in asked]
    want = [r for rows in one for r in rows.select("page_id", "selector", "pos", "block").collect()]
    assert sorted(got.collect()) == sorted(want) and len(want) == 8
    tags = pages.select(selectors.page_tags(F.col("html")).alias("t")).collect()
    assert [len(r.t) if r.t is not None else None for r in tags][1:] == [None, 0, 4]


def test_the_tags_are_walked_once_for_all_selectors(spark):
    pages = spark.createDataFrame([
        (1, '<div class="a"><p>x<p>y<br class="a"></div><b>z'), (2, "<ul><li>1<li class=a>2</ul>" * 3), (3, "<p><b><i>1</i></b><b>2"),
    ], "page_id int, html string")
    # 125 steps in all: more than one walk can hold.
    asked = (".a", "p > b, li", ".a", "b", *[" ".join(["*"] * n) for n in (40, 2, 45, 3)], "p b > i", "p:x", "ul > .a", ", ".join(["b"] * 27))
    got = extract.explode_elements(pages, asked)
    plan = str(got._jdf.queryExecution().analyzed())
    # The selectors are neither rows of their own nor read again for each page.
    assert "explode(" not in plan and plan.count("inline(") == 1 and plan.count("regexp_extract_all(") == 1
    one = [extract.explode_containers(pages, s, "tree").withColumn("selector", F.lit(s)) for s in asked]
    want = [r for rows in one for r in rows.select("page_id", "selector", "pos", "block").collect()]
    assert sorted(got.collect()) == sorted(want) and len(want) > 30
    assert extract.explode_elements(pages, ()).count() == 0
