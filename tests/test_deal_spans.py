"""The part of a piece that the hotel search runs over holds every match, and little else."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from pagedrift import patterns as P
from pagedrift.functions.text import html_to_text
from pagedrift.operators import deals
from pagedrift.sources.derived import derived

ODD = (
    "x" * 200 + " A fine old Grand Hotel by the sea \U0001f3e8 only $1,200.50 per night and " + "y" * 90,
    "Hotel first $5 then " + "w " * 60 + "Tall Palace rooms of the town $7 and $ more", "Maui is warm and sunny for $9$",
    "A stay at the St. Regis of the bay from $300,", "In the " + "i" * 80 + "inn for $4", "In the " + "i" * 79 + "inn for $4",
)


@pytest.mark.parametrize("pattern, words, lead", [(P.HOTEL_DEAL, P.HOTEL_WORDS, 81), (P.PLACE_DEAL, P.HOTEL_PLACES, 0)])
def test_no_match_is_lost(spark, pattern, words, lead):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.regexp_replace("text", r"\s+", " ").alias("t"))
    offers = derived(spark, SF_DIR, "offer_pages").select(html_to_text(F.col("html")).alias("t"))
    texts = docs.unionByName(offers).unionByName(spark.createDataFrame([(t,) for t in ODD], "t string"))
    whole = F.filter(deals._priced(F.col("t")), lambda p: p.rlike(P.collapsed_regex("(?i)" + words)))
    cut = F.transform(whole, lambda p: deals._between(p, words, lead))

    def found(pieces):
        return F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(P.collapsed_regex(pattern)), F.lit(0))))

    rows = texts.select(found(whole).alias("a"), found(cut).alias("b"), whole.alias("w"), cut.alias("c")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(len(r.a) for r in rows) > 100
    assert sum(len(p) for r in rows for p in r.c) < 0.8 * sum(len(p) for r in rows for p in r.w)
