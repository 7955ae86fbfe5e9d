import random

import pytest

from pagedrift.operators import diff
from pagedrift.schemas import FIELDS

KEYS = ["url", "id"]
COLUMNS = "url string, id string, pos long, title string, perk string, dates string, price string"


def promo(i, url="u", pos=None, **changes):
    values = {
        "title": f"Deal number {i}", "perk": f"Breakfast for {i} guests included",
        "dates": "Summer 2025", "price": f"${1000 + 50 * i}",
    } | changes
    return (url, f"id{i}", i if pos is None else pos, *[values[f] for f in FIELDS])


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def changes(spark, current, previous):
    rows = diff.detect_changes(table(spark, current), table(spark, previous), KEYS).collect()
    return sorted((r["change_type"], r["url"], r["id"], r["pos"]) for r in rows)


def brute(current, previous):
    """The same rule over plain lists; fields differ only in ways cleaning does not hide."""
    last = {}
    for p in sorted(previous, key=lambda p: p[2]):
        last[p[:2]] = p
    now = {c[:2] for c in current}
    out = []
    for c in current:
        old = last.get(c[:2])
        if old is None:
            out.append(("added", *c[:3]))
        elif old[3:] != c[3:]:
            out.append(("changed", *c[:3]))
    out += [("removed", *p[:3]) for p in previous if p[:2] not in now]
    return sorted(out)


def test_hundred_records(spark):
    previous = [promo(i) for i in range(100)]
    current = [promo(i) for i in range(50)]
    current += [promo(i, price=f"${5000 + i}") for i in range(50, 75)]
    current += [promo(i) for i in range(200, 225)]
    found = changes(spark, current, previous)
    kinds = [kind for kind, *_ in found]
    assert {k: kinds.count(k) for k in set(kinds)} == {"added": 25, "changed": 25, "removed": 25}
    assert found == brute(current, previous)


def test_same_table_has_no_changes(spark):
    rows = [promo(i) for i in range(20)]
    assert changes(spark, rows, rows) == []
    assert changes(spark, [], []) == []


def test_swap_turns_added_into_removed(spark):
    a, b = [promo(i) for i in range(10)], [promo(i) for i in range(5, 15)]
    added = [c[1:] for c in changes(spark, a, b) if c[0] == "added"]
    removed = [c[1:] for c in changes(spark, b, a) if c[0] == "removed"]
    assert added == removed != []


def test_duplicates_keep_their_rows_and_last_previous_counts(spark):
    previous = [promo(1, pos=1), promo(1, pos=2, title="Another old deal"), promo(3, pos=3), promo(3, pos=4)]
    current = [promo(1, pos=1), promo(1, pos=2), promo(2, pos=3), promo(2, pos=4)]
    assert changes(spark, current, previous) == [
        ("added", "u", "id2", 3), ("added", "u", "id2", 4),
        ("changed", "u", "id1", 1), ("changed", "u", "id1", 2),
        ("removed", "u", "id3", 3), ("removed", "u", "id3", 4),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_key_against_brute_force(spark, seed):
    """A third of all rows shares one url and id; broadcast is off, so the joins shuffle."""
    rng = random.Random(seed)

    def rows(n, hot):
        out = [promo(0, "hot", pos=i, price=f"${rng.choice([10, 2000])}") for i in range(hot)]
        out += [
            promo(rng.randrange(n), f"u{rng.randrange(5)}", pos=i, price=f"${rng.choice([10, 2000])}")
            for i in range(2 * hot)
        ]
        return out

    current, previous = rows(60, 400), rows(60, 300)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                          "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1KB")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.1")
        assert changes(spark, current, previous) == brute(current, previous)
        union = diff.change_union(table(spark, current), table(spark, previous), KEYS).collect()
        assert sorted((r["change_type"], r["url"], r["id"], r["pos"]) for r in union) == brute(
            current, previous
        )
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def sentence(spark, added, removed, changed, none="No changes detected"):
    from pyspark.sql import functions as F

    n = [F.lit(x) for x in (added, removed, changed)]
    return spark.range(1).select(diff.change_sentence(*n, none).alias("s")).first()["s"]


def test_sentences(spark):
    assert sentence(spark, 0, 0, 0) == "No changes detected"
    assert sentence(spark, 2, 0, 0) == "2 new promotions"
    assert sentence(spark, 0, 1, 0) == "1 promotion removed"
    assert sentence(spark, 2, 1, 0) == "2 new promotions and 1 promotion removed"
    assert (
        sentence(spark, 1, 1, 3)
        == "1 new promotion, 1 promotion removed, and 3 promotions updated"
    )


def test_material_counts_keep_quiet_sources(spark):
    previous = [promo(1), promo(2), promo(1, "quiet")]
    current = [promo(1), promo(2, price="$9,999"), promo(1, "quiet"),
               promo(9, "quiet", title="Loading...", perk="Please wait", dates="", price="")]
    classified = diff.classify(table(spark, current), table(spark, previous), KEYS)
    got = {r["url"]: r for r in diff.count_changes(classified, ["url"], material=True).collect()}
    assert got["u"]["summary"] == "1 promotion updated"
    assert got["quiet"]["summary"] == "No material changes detected"
    raw = {r["url"]: r for r in diff.count_changes(classified, ["url"]).collect()}
    assert raw["quiet"]["summary"] == "1 new promotion" and raw["quiet"]["has_changes"]
