"""Similarity and materiality as native columns.

Raw equality is tested first everywhere: most fields of most records do not change between
two snapshots, so the regular expressions and the edit distance run on the few that do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P
from ..schemas import FIELDS
from .text import clean_text, let, trim_blanks


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def text_similarity(a: Column, b: Column) -> Column:
    """Share of the longer text that an edit script keeps: 1 for equal, 0 for nothing in common."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise((longest - F.levenshtein(a, b)) / longest)
    )


def _near(a: Column, b: Column) -> Column:
    """``text_similarity > 0.85`` with a bounded edit distance (-1 = beyond the bound)."""
    longest = F.greatest(F.length(a), F.length(b))
    bound = F.ceil(longest * (1 - P.TEXT_SIMILARITY)).cast("int")
    distance = F.call_function("levenshtein", a, b, bound)
    return let(
        distance, lambda d: (d >= 0) & ((longest - d) / longest > P.TEXT_SIMILARITY)
    )


def similar_text(a: Column, b: Column) -> Column:
    a, b = _text(a), _text(b)
    cleaned = F.transform(F.array(a, b), lambda t: F.lower(clean_text(t)))
    return (
        F.when(a == b, True)
        .when((a == "") | (b == ""), False)
        .otherwise(
            let(
                cleaned,
                lambda p: F.when(p[0] == p[1], True)
                .when((p[0] == "") | (p[1] == ""), False)
                .otherwise(_near(p[0], p[1])),
            )
        )
    )


def price_numbers(col: Column) -> Column:
    """Every amount in a price text; a lone comma gives null."""
    found = F.regexp_extract_all(col, F.lit(P.PRICE_NUMBER), F.lit(1))
    return F.transform(found, lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double"))


def similar_price(previous: Column, current: Column) -> Column:
    """Same amounts within 1 % of the previous one, at least 1; text when neither has any."""
    previous, current = _text(previous), _text(current)

    def close(pair: Column) -> Column:
        tolerance = F.greatest(
            F.lit(P.PRICE_TOLERANCE_MIN), pair["p"] * P.PRICE_TOLERANCE_RATIO
        )
        return ~F.coalesce(F.abs(pair["p"] - pair["c"]) > tolerance, F.lit(False))

    amounts = F.struct(price_numbers(previous).alias("p"), price_numbers(current).alias("c"))
    return (
        F.when(previous == current, True)
        .when((previous == "") | (current == ""), False)
        .otherwise(
            let(
                amounts,
                lambda n: F.when(
                    (F.size(n["p"]) == 0) & (F.size(n["c"]) == 0), similar_text(previous, current)
                )
                .when(F.size(n["p"]) != F.size(n["c"]), False)
                .otherwise(F.forall(F.arrays_zip(n["p"], n["c"]), close)),
            )
        )
    )


def _date(year: Column, month: Column, day: Column) -> Column:
    """Calendar date that rolls over: month 13 is next January, day 45 runs into next month."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.date_add(first, day - 1)


def _matches(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(P.java_regex(pattern)), F.lit(0))


def date_values(col: Column) -> Column:
    """Every date in a text: M/D/Y, ISO and ``Mon D, YYYY``."""

    def part(match: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(match, P.java_regex(pattern), group)

    def numeric(pattern: str, y: int, m: int, d: int):
        def build(match: Column) -> Column:
            year = part(match, pattern, y).cast("int")
            year = F.when(year < 100, year + 1900).otherwise(year)
            return _date(year, part(match, pattern, m).cast("int"), part(match, pattern, d).cast("int"))

        return build

    def named(match: Column) -> Column:
        year = part(match, P.DATE_MONTH_NAME, 3).cast("int")
        year = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
        month = F.array_position(
            F.array(*[F.lit(m) for m in P.MONTHS]), F.lower(part(match, P.DATE_MONTH_NAME, 1))
        ).cast("int")
        day = part(match, P.DATE_MONTH_NAME, 2).cast("int")
        return F.when(day.between(1, 31), _date(year, month, day))

    found = F.concat(
        F.transform(_matches(col, P.DATE_MDY), numeric(P.DATE_MDY, 3, 1, 2)),
        F.transform(_matches(col, P.DATE_ISO), numeric(P.DATE_ISO, 1, 2, 3)),
        F.transform(_matches(col, P.DATE_MONTH_NAME), named),
    )
    return F.filter(found, lambda d: d.isNotNull())


def similar_dates(a: Column, b: Column) -> Column:
    """Any pair of dates within a week; text unless both sides have dates."""
    a, b = _text(a), _text(b)
    days = F.struct(date_values(a).alias("a"), date_values(b).alias("b"))

    def any_close(d: Column) -> Column:
        return F.exists(
            d["a"],
            lambda x: F.exists(
                d["b"], lambda y: F.abs(F.datediff(x, y)) <= P.DATE_TOLERANCE_DAYS
            ),
        )

    # Equal texts are similar on every path, with dates (distance 0) or without.
    return (
        F.when(a == b, True)
        .when((a == "") | (b == ""), False)
        .otherwise(
            let(
                days,
                lambda d: F.when(
                    (F.size(d["a"]) > 0) & (F.size(d["b"]) > 0), any_close(d)
                ).otherwise(similar_text(a, b)),
            )
        )
    )


def promo_equal(previous: Column, current: Column) -> Column:
    """All four fields equal once cleaned; case counts."""
    fields = F.array(*[F.array(_text(previous[f]), _text(current[f])) for f in FIELDS])
    return F.forall(
        fields, lambda p: (p[0] == p[1]) | (clean_text(p[0]) == clean_text(p[1]))
    )


def material_change(previous: Column, current: Column) -> Column:
    texts = F.array(*[F.array(previous[f], current[f]) for f in ("title", "perk")])
    return ~(
        F.forall(texts, lambda p: similar_text(p[0], p[1]))
        & similar_price(previous["price"], current["price"])
        & similar_dates(previous["dates"], current["dates"])
    )


def material_promo(promo: Column) -> Column:
    """A record with content of its own: enough text, a price or dates, no notice phrases."""
    title, perk, dates, price = (_text(promo[f]) for f in FIELDS)
    has_title = F.length(trim_blanks(title)) > P.MIN_TITLE
    has_perk = F.length(trim_blanks(perk)) > P.MIN_PERK
    has_price = price.rlike(P.HAS_PRICE)
    has_dates = F.length(trim_blanks(dates)) > P.MIN_DATES
    everything = F.lower(F.concat_ws(" ", title, perk, dates, price))
    immaterial = F.lit(False)
    for pattern in P.IMMATERIAL_TEXT:
        immaterial = immaterial | everything.rlike(P.java_regex(pattern))
    return (has_title | has_perk) & (has_price | has_dates | has_perk) & ~immaterial
