from pyspark.sql import functions as F

from pagedrift.functions import similarity as S
from pagedrift.schemas import FIELDS


def flags(values, function, rows):
    return values(function, rows, ["string", "string"])


def test_text_similarity(values):
    rows = [("", ""), ("a", ""), ("kitten", "sitting"), ("same", "same")]
    assert flags(values, S.text_similarity, rows) == [1.0, 0.0, (7 - 3) / 7, 1.0]


def test_similar_text_threshold_is_strict(values):
    base = "abcdefghijklmnopqrst"  # 20 characters
    three = "xxx" + base[3:]  # 17/20 = 0.85, not above
    two = "xx" + base[2:]
    rows = [(base, three), (base, two), ("", ""), (None, None), ("a", None), ("", "a")]
    rows += [("HURRY! Deal  one", "deal one"), ("hurry", "act now")]
    assert flags(values, S.similar_text, rows) == [
        False, True, True, True, False, False, True, True,
    ]


def test_similar_price(values):
    rows = [
        ("$1,000", "$1,200"),
        ("$1,000.00", "$1,000.50"),
        ("$50", "$51"),
        ("$50", "$51.01"),
        ("$1,000", "$1,010"),
        ("$1,000", "$1,011"),
        ("$1,010", "$1,000"),
        ("$899-$1,599", "$899"),
        ("call us", "call us!"),
        ("", ""),
        ("$5", ""),
        ("$5 , now", "$5 ; now,"),
    ]
    assert flags(values, S.similar_price, rows) == [
        False, True, True, False, True, False, True, False, True, True, False, True,
    ]


def test_similar_dates(values):
    rows = [
        ("Valid through March 2025", "Valid through June 2025"),
        ("Valid through 03/15/2025", "Valid through 03/18/2025"),
        ("3/15/2025", "3/22/2025"),
        ("3/15/2025", "3/23/2025"),
        ("2025-12-30", "Jan 3, 2026"),
        ("1/1/2024 or 6/1/2025", "until 2025-06-05"),
        ("13/45/2025", "2026-02-14"),
        ("1/1/99", "1999-01-02"),
        ("Feb 30, 2025", "3/2/2025"),
        ("Mar 1, 2025", "in spring"),
        ("", ""),
        ("x", ""),
    ]
    assert flags(values, S.similar_dates, rows) == [
        False, True, True, False, True, True, True, True, True, False, True, False,
    ]


def records(spark, rows):
    names = [f"{side}_{f}" for side in "pc" for f in FIELDS]
    frame = spark.createDataFrame([(*p, *c) for p, c in rows], names)
    side = lambda s: F.struct(*[F.col(f"{s}_{f}").alias(f) for f in FIELDS])
    return frame.select(
        S.promo_equal(side("p"), side("c")).alias("equal"),
        S.material_change(side("p"), side("c")).alias("material"),
    ).collect()


def test_records(spark):
    base = (
        "Hawaii Vacation Package", "Free breakfast and airport transfer",
        "Valid through March 31, 2025", "$1,299 per person",
    )
    cosmetic = (base[0] + "   ", base[1] + " (updated 01/08/2025)", *base[2:])
    cased = (base[0].lower(), *base[1:])
    edited = (
        base[0], "Free breakfast, airport transfer, and spa credit", base[2], "$1,199 per person",
    )
    got = records(spark, [(base, base), (base, cosmetic), (base, cased), (base, edited)])
    assert [tuple(r) for r in got] == [
        (True, False), (True, False), (False, False), (False, True),
    ]


def test_material_promo(spark):
    rows = [
        (("Loading...", "Please wait", "", ""), False),
        (("Hi", "Ok", "", ""), False),
        (("404 Not Found", "Page not found", "", ""), False),
        (("JavaScript Required", "Please enable JavaScript in your browser", "", ""), False),
        (("Cookie Notice", "This site uses cookies for privacy", "", ""), False),
        (("", "   ", "", ""), False),
        (("Only a title", "", "", ""), False),
        (("Only a title", "", "", "$5"), True),
        (("Only a title", "", "Summer 2025", ""), True),
        (("Great Deal", "Includes hotel and flights with breakfast", "", ""), True),
        (("Роскошный тур по Волге", "", "летом 2025", ""), True),
        (("An updated bad cookies story", "", "", "$5"), True),
    ]
    frame = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], ["n", *FIELDS])
    got = frame.select(
        "n", S.material_promo(F.struct(*FIELDS)).alias("v")
    ).orderBy("n").collect()
    assert [r["v"] for r in got] == [expected for _, expected in rows]
