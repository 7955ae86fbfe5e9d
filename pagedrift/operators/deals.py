"""Page summaries and deals found in free page text.

Every page is worked on inside its own row: matches live in short arrays, so the per-page caps
are slices and no job here shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions.text import (
    collapse_blanks,
    decode_entities,
    html_to_text,
    let,
    replace_entities,
    trim_blanks,
)
from ..sources import tables
from .extract import page_promos

DEAL_FIELDS = ("title", "description", "price", "savings", "location", "dates")


def _find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(P.java_regex(pattern)), F.lit(group))


# Where a text may be cut without cutting a match: at the end of sentences, but not inside
# cents or after the ``st.`` of a hotel name.
SENTENCE = r"[.!?]"
SENTENCE_WITH_CENTS = r"[.!?](?:(?<!\.)|(?<![sS][tT]\.)(?!\d\d))"


def _search(
    text: Column,
    pattern: str,
    needs: Sequence[str],
    split: str = SENTENCE,
    ahead: str = "",
    starts: dict[str, str] | None = None,
    group: int = 0,
) -> Column:
    """Every match in a text of collapsed blanks, found faster than by the bare pattern.

    The helpers only cut the search short; the matches are the same without them.  No match
    reaches over a ``split``, so only pieces that hold all of ``needs`` (parts of every match)
    are searched.  ``ahead`` is a look-ahead that holds at every match start, and ``starts``
    gives for a word group of the pattern how its words begin.
    """
    return _search_pieces(_pieces(text, needs[0], split), pattern, needs[1:], ahead, starts, group)


def _pieces(text: Column, need: str, split: str = SENTENCE) -> Column:
    """The pieces of a text in which ``need`` occurs.  Several searches can share them."""
    return F.filter(F.split(text, split), lambda piece: piece.rlike(P.collapsed_regex(need)))


def _search_pieces(
    pieces: Column,
    pattern: str,
    needs: Sequence[str],
    ahead: str = "",
    starts: dict[str, str] | None = None,
    group: int = 0,
) -> Column:
    """Like :func:`_search` over pieces of the text."""
    for words, begin in (starts or {}).items():
        if words not in pattern:
            raise ValueError(f"no {words!r} in the pattern")
        pattern = pattern.replace(words, f"(?={begin}){words}")
    full = F.lit(P.collapsed_regex(ahead + pattern))
    for need in needs:
        wanted = P.collapsed_regex(need)
        pieces = F.filter(pieces, lambda piece: piece.rlike(wanted))
    return F.flatten(
        F.transform(pieces, lambda piece: F.regexp_extract_all(piece, full, F.lit(group)))
    )


def _dollar_within(limit: int, stops: str = ".!?") -> str:
    """A dollar sign follows before any of ``stops``, at most ``limit`` characters ahead."""
    return r"(?=[^" + stops + r"$]{0," + str(limit) + r"}+\$)"


A_PRICE = r"\$[\d,]"


_starts = P.starts


def _any(words: str) -> str:
    """Any of ``words`` (an alternation), in either case; most positions are settled by two characters."""
    plain = all(re.match("[A-Za-z]{2}(?![?*{])", word) for word in words.split("|"))
    ahead = f"(?={_starts(words.split('|'))})" if plain else ""
    return f"(?i){ahead}(?:{words})"


PACKAGE_WORDS = "package|vacation|getaway|escape|deal"
PACKAGE_STARTS = {"(?:" + PACKAGE_WORDS + ")": _starts(PACKAGE_WORDS.split("|"))}
CREDIT_STARTS = {
    r"(?:\$\d+[^.!?]{20,200}resort": r"(?:\$\d|" + _starts(("waived", "included")) + ")"
}


def _find(text: Column, pattern: str, group: int = 0) -> Column:
    """First match in a text of collapsed blanks, '' for none."""
    return F.regexp_extract(text, P.collapsed_regex(pattern), group)


def _first(values: Column, limit: int | None) -> Column:
    """The first ``limit`` elements, or all."""
    return values if limit is None else F.slice(values, 1, limit)


def _some(col: Column) -> Column:
    # ``nullif`` would compute the value twice.
    return let(col, lambda c: F.when(c != "", c))


def _deal(**values: Column) -> Column:
    return F.struct(
        *[values.get(f, F.lit(None)).cast("string").alias(f) for f in DEAL_FIELDS]
    )


def _shorten(col: Column, limit: int) -> Column:
    return F.concat(
        trim_blanks(F.substring(col, 1, limit)),
        F.when(F.length(col) > limit, F.lit("...")).otherwise(""),
    )


# --- page head -------------------------------------------------------------------

def page_title(html: Column) -> Column:
    pattern = P.java_regex(P.PAGE_TITLE)

    def read(match: Column) -> Column:
        text = trim_blanks(F.regexp_replace(F.regexp_extract(match, pattern, 1), P.TAG, ""))
        return F.when(match != "", text).otherwise(P.NO_TITLE)

    # The page is searched once; the group is read from the match.
    return let(F.regexp_extract(html, pattern, 0), read)


def page_meta(html: Column) -> Column:
    pattern = P.java_regex(P.PAGE_META)
    return F.when(html.rlike(pattern), trim_blanks(F.regexp_extract(html, pattern, 1)))


def page_kind(html: Column, site: str, site_label: str) -> Column:
    return F.when(html.contains(site), site_label).otherwise("Web Page")


# --- mentions --------------------------------------------------------------------

DATE_STARTS = f"(?={_starts(('valid', 'expire', 'through', 'until', 'book', 'travel'))})"


def date_mentions(html: Column, limit: int | None = None) -> Column:
    """The dated phrases of the raw page; ``limit``: only the first ones."""
    return F.transform(
        _first(_find_all(html, DATE_STARTS + P.DATE_MENTION), limit),
        lambda m: F.concat(F.lit("Date: "), collapse_blanks(trim_blanks(m))),
    )


def price_mentions(html: Column, limit: int | None = None) -> Column:
    """Prices, each with the words that say what it is for; ``limit``: only the first ones."""
    return let(html_to_text(html, strip_scripts=False), lambda text: _price_mentions(text, limit))


def _price_matches(text: Column) -> Column:
    def cut(piece: Column) -> Column:
        """From the 40 characters before the first dollar sign, which is as far as a match reaches."""
        before = F.length(F.substring_index(piece, "$", 1))
        return F.substring(piece, F.greatest(before - 39, F.lit(1)), F.length(piece))

    return _search_pieces(F.transform(_priced(text), cut), P.PRICE_MENTION, (), _dollar_within(40))


def _price_mentions(text: Column, limit: int | None) -> Column:
    def words(col: Column) -> Column:
        return F.split(col, " ")

    def label(match: Column) -> Column:
        parts = F.struct(
            trim_blanks(_find(match, P.PRICE_MENTION, 1)).alias("before"),
            _find(match, P.PRICE_MENTION, 2).alias("price"),
            trim_blanks(_find(match, P.PRICE_MENTION, 3)).alias("after"),
        )

        def build(m: Column) -> Column:
            leads = F.lit(False)
            for word in P.PRICE_BEFORE_WORDS:
                leads = leads | m["before"].contains(word)
            follows = F.lit(False)
            for word in P.PRICE_AFTER_WORDS:
                follows = follows | m["after"].contains(word)
            before = words(m["before"])
            last_three = F.slice(
                before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3)
            )
            first_three = F.slice(words(m["after"]), 1, 3)
            context = (
                F.when(
                    (F.length(m["before"]) > 5) & leads,
                    F.concat_ws(" ", F.array_join(last_three, " "), m["price"]),
                )
                .when(
                    (F.length(m["after"]) > 5) & follows,
                    F.concat_ws(" ", m["price"], F.array_join(first_three, " ")),
                )
                .otherwise(F.concat(F.lit("Price: "), m["price"]))
            )
            return trim_blanks(collapse_blanks(context))

        return let(parts, build)

    kept = F.filter(F.transform(_price_matches(text), label), lambda c: F.length(c).between(11, 79))
    return _first(kept, limit)


def place_mentions(
    html: Column, places: Sequence[str] = P.PLACES, limit: int | None = None
) -> Column:
    """Sentences about known places, place by place; ``limit``: only the first ones."""
    return _place_mentions(html_to_text(html, strip_scripts=False), places, limit)


def _place_mentions(text: Column, places: Sequence[str], limit: int | None) -> Column:
    def all_places(pieces: Column) -> Column:
        found = F.concat(
            *[
                _search_pieces(pieces, r"(?i)[^.!?]{20,80}" + place + r"[^.!?]{0,40}", ["(?i)" + place])
                for place in places
            ]
        )
        clean = F.transform(found, lambda m: collapse_blanks(trim_blanks(m)))
        kept = F.filter(clean, lambda c: F.length(c).between(26, 99))
        return F.transform(
            _first(kept, limit), lambda c: F.concat(F.lit("Location: "), c)
        )

    # The page is split and searched once; the places share the few sentences that name any.
    return let(_pieces(text, _any("|".join(places))), all_places)


def key_elements(
    html: Column, max_prices: int | None = None, max_dates: int | None = None, max_places: int | None = None
) -> Column:
    """Price, date and place mentions of a page, whose text is taken once for them."""
    return let(html_to_text(html, strip_scripts=False), lambda text: F.concat(
        _price_mentions(text, max_prices), date_mentions(html, max_dates), _place_mentions(text, P.PLACES, max_places),
    ))


# --- deals -----------------------------------------------------------------------

# Looked at before a pattern is tried; each holds wherever the pattern matches.
PLACE_STARTS = f"(?={_starts(P.DEAL_PLACE.removeprefix('(?i)(').removesuffix(')').split('|'))})"
SAVINGS_STARTS = r"(?=[sSwW\d$])"
NEAR_DATE_STARTS = f"(?={_starts(('valid', 'through', 'until', 'expire'))})"
TITLE_AHEAD = {P.TITLE_BREAKS[0]: r"(?=(?is:.*?)(?i:\s+Package))"}


def _deal_place(description: Column) -> Column:
    known = trim_blanks(_find(description, PLACE_STARTS + P.DEAL_PLACE, 1))
    labelled = trim_blanks(_find(description, P.DEAL_PLACE_LABEL, 1))
    after = trim_blanks(_find(description, P.DEAL_PLACE_AFTER, 1))
    place = F.coalesce(_some(known), _some(labelled), _some(after))
    return let(
        place,
        lambda p: F.when(F.lower(p) == "hawaii island", "Hawaii Island")
        .when(F.lower(p) == "los cabos", "Los Cabos")
        .otherwise(p),
    )


def _deal_title(description: Column) -> Column:
    candidates = []
    for pattern in P.TITLE_BREAKS:
        # The look-ahead stands where the text begins.
        pattern = pattern.replace(r"\A", r"\A" + TITLE_AHEAD.get(pattern, ""), 1)
        text = trim_blanks(_find(description, pattern, 1))
        candidates.append(let(text, lambda t: F.when(F.length(t) >= 15, t)))
    title = F.coalesce(*candidates, description)

    def cut(t: Column) -> Column:
        # Whole words up to 60; a first word of 60 or more falls back to its first 50.
        head = _find(t, r"\A(" + P.LINE_REST + r"{1,60}) ", 1)
        return F.when(
            (head == "") | ((F.length(head) == 60) & ~head.contains(" ")), F.substring(t, 1, 50)
        ).otherwise(head)

    return let(
        title, lambda t: F.when((t == description) & (F.length(t) > 60), cut(t)).otherwise(t)
    )


def _priced(text: Column) -> Column:
    """The pieces of a text that hold a price; a price is not cut."""
    return _pieces(text, A_PRICE, SENTENCE_WITH_CENTS)


def _between(piece: Column, words: str, lead: int) -> Column:
    """What a match can cover: from ``lead`` characters before the first of ``words`` to the last price."""
    before = F.length(_find(piece, r"\A((?s:.*?))" + _any(words), 1))
    tail = F.substring_index(piece, "$", -1)
    end = F.length(piece) - F.length(tail) + F.length(_find(tail, r"\A[\d,]*(?:\.\d{2})?"))
    return let(F.greatest(before - lead, F.lit(0)), lambda start: F.substring(piece, start + 1, end - start))


def _hotel_like(text: Column, pieces: Column, pattern: str, words: str, lead: int) -> Column:
    """``lead``: most characters of a match before its first word of ``words``."""
    starts = {"(?:" + words: _starts(words.split("|"))}

    def read(match: Column) -> Column:
        found = F.struct(
            match.alias("match"), trim_blanks(_find(match, pattern, 1)).alias("raw"), F.instr(text, match).alias("at")
        )
        return let(found, lambda f: F.when(F.length(f["raw"]).between(16, 349), let(parts(f), deal)))

    def parts(f: Column) -> Column:
        # Both lengths are known: the window is cut out of the page text around the first
        # occurrence of the match.
        start = F.greatest(f["at"] - 100, F.lit(1))
        return F.struct(
            f["match"].alias("match"),
            f["raw"].alias("raw"),
            decode_entities(f["raw"]).alias("text"),
            F.substring(text, start, f["at"] + 200 - start).alias("near"),
        )

    def deal(d: Column) -> Column:
        return _deal(
            title=_deal_title(d["text"]),
            description=d["text"],
            # A match ends with its price.
            price=_find(d["match"], P.DEAL_PRICE_END),
            savings=_some(_find(d["near"], SAVINGS_STARTS + f"(?:{P.NEAR_SAVINGS})")),
            location=_deal_place(d["raw"]),
            dates=_some(trim_blanks(_find(d["near"], NEAR_DATE_STARTS + P.NEAR_DATES))),
        )

    pieces = F.filter(pieces, lambda piece: piece.rlike(P.collapsed_regex(_any(words))))
    pieces = F.transform(pieces, lambda piece: _between(piece, words, lead))
    # From the start of a match to its price: two runs of 80 and 40, a hotel word, a run of 100.
    # The hotel word may hold a full stop (``st. regis``).
    found = _search_pieces(pieces, pattern, (), _dollar_within(300, "!?"), starts)
    return F.filter(F.transform(found, read), lambda d: d.isNotNull())


def hotel_deals(text: Column) -> Column:
    return let(_priced(text), lambda pieces: _hotel_deals(text, pieces))


def _hotel_deals(text: Column, pieces: Column) -> Column:
    return F.concat(
        _hotel_like(text, pieces, P.HOTEL_DEAL, P.HOTEL_WORDS, 81),
        _hotel_like(text, pieces, P.PLACE_DEAL, P.HOTEL_PLACES, 0),
    )


PACKAGE_PRICE = r"[^.!?]{0,40}\s+from\s+\$[\d,]"
PACKAGE_NEEDS, SAVINGS_NEEDS = r"from\s+\$", r"\ssave\s"
CREDIT_NEEDS = r"resort\s+(?:credit|fee)|included\s+extras"
NEED_STARTS = {PACKAGE_NEEDS: ("from",), SAVINGS_NEEDS: (" save",), CREDIT_NEEDS: ("resort", "included")}


def _offering(text: Column, *needs: str) -> Column:
    """The sentences in which one of ``needs`` occurs."""
    starts = _starts([s for need in needs for s in NEED_STARTS[need]])
    return _pieces(text, f"(?i)(?={starts})(?:{'|'.join(needs)})")


def package_deals(text: Column) -> Column:
    return _package_deals(_offering(text, PACKAGE_NEEDS))


def _package_deals(sentences: Column) -> Column:
    def read(match: Column) -> Column:
        return let(
            trim_blanks(_find(match, P.PACKAGE_DEAL, 1)),
            lambda d: F.when(
                F.length(d).between(21, 149),
                _deal(title=_shorten(d, 60), description=d, price=_find(match, P.PACKAGE_DEAL, 2)),
            ),
        )

    return F.filter(
        F.transform(
            _search_pieces(
                sentences, P.PACKAGE_DEAL, ["(?i)" + PACKAGE_NEEDS, _any(PACKAGE_WORDS) + PACKAGE_PRICE],
                _dollar_within(300), PACKAGE_STARTS
            ),
            read,
        ),
        lambda d: d.isNotNull()
    )


def savings_deals(text: Column) -> Column:
    return _savings_deals(_offering(text, SAVINGS_NEEDS))


def _savings_deals(sentences: Column) -> Column:
    def read(match: Column) -> Column:
        savings = F.concat(
            F.lit("Save "), _find(match, P.SAVINGS_DEAL, 2), _find(match, P.SAVINGS_DEAL, 3)
        )
        return let(
            trim_blanks(_find(match, P.SAVINGS_DEAL, 1)),
            lambda d: F.when(
                F.length(d).between(16, 119),
                _deal(title=_shorten(d, 50), description=d, savings=savings),
            ),
        )

    found = _search_pieces(sentences, P.SAVINGS_DEAL, ["(?i)" + SAVINGS_NEEDS])
    return F.filter(F.transform(found, read), lambda d: d.isNotNull())


def credit_deals(text: Column) -> Column:
    """Resort credits, waived fees and included extras."""
    return _credit_deals(_offering(text, CREDIT_NEEDS))


def _credit_deals(sentences: Column) -> Column:

    def title_of(d: Column) -> Column:
        head = F.substring(d, 1, 60)

        def named(pattern: str) -> Column:
            return F.coalesce(_some(trim_blanks(_find(d, pattern, 1))), head)

        title = (
            F.when(d.contains("resort credit"), named(P.CREDIT_TITLE))
            .when(d.contains("waived") & d.contains("resort fee"), named(P.WAIVER_TITLE))
            .when(d.contains("included extras"), named(P.EXTRAS_TITLE))
            .otherwise(head)
        )
        return let(
            title,
            lambda t: F.when(
                F.length(t) > 60, F.concat(F.substring(t, 1, 60), F.lit("..."))
            ).otherwise(t),
        )

    def clean(d: Column) -> Column:
        return trim_blanks(collapse_blanks(replace_entities(d, ("&diams;", "&bull;"))))

    def read(match: Column) -> Column:
        raw = trim_blanks(match)
        return let(
            F.struct(F.length(raw).alias("n"), clean(raw).alias("text")),
            lambda d: F.when(
                d["n"].between(21, 299),
                _deal(
                    title=title_of(d["text"]),
                    description=d["text"],
                    price=_some(_find(d["text"], P.CREDIT_PRICE)),
                    savings=_some(_find(d["text"], P.CREDIT_SAVINGS)),
                ),
            ),
        )

    found = _search_pieces(sentences, P.CREDIT_DEAL, ["(?i)" + CREDIT_NEEDS], starts=CREDIT_STARTS, group=1)
    return F.filter(F.transform(found, read), lambda d: d.isNotNull())


def generic_deals(html: Column, limit: int | None = None) -> Column:
    """Hotel, package, savings and credit deals, in that order; ``limit``: only the first ones.

    The page is split twice (with prices whole, and by sentences), and the searches share the pieces
    that may hold something.
    """

    def found(text: Column) -> Column:
        shared = F.struct(
            _priced(text).alias("priced"),
            _offering(text, PACKAGE_NEEDS, SAVINGS_NEEDS, CREDIT_NEEDS).alias("sentences"),
        )
        return let(shared, lambda s: F.concat(
            _hotel_deals(text, s["priced"]),
            *[deals(s["sentences"]) for deals in (_package_deals, _savings_deals, _credit_deals)],
        ))

    return _first(let(html_to_text(html), found), limit)


#: Up to so many rules travel with every page as an array; more are found by an index.
ARRAY_RULES = 1_000
RULE_FIELDS = ("ord", "url_contains", "pattern", "title", "price", "savings", "location")
#: Longest grams of rule codes; shorter codes are found by grams of half that, and so on.
LONGEST_GRAM = 8


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with ``rules``: those of the first rule code that occurs in the page's url, in order, or none.

    ``rules``: url_contains, pattern (of texts of collapsed blanks), title, price, savings,
    location, ord.  A small table is read once, as one array for all tasks, so the plan does not grow
    with it and pages stay where they are; for a larger one see :func:`indexed_rules`.
    """
    few = rules.limit(ARRAY_RULES + 1)
    every = few.agg(F.sort_array(F.collect_list(F.struct(*RULE_FIELDS))).alias("rules")).scalar()
    if few.count() > ARRAY_RULES:
        return indexed_rules(pages, rules)

    def of_page(all_rules: Column) -> Column:
        code = F.get(
            F.filter(all_rules, lambda r: F.contains(F.col("url"), r["url_contains"]))["url_contains"], 0
        )
        return let(code, lambda c: F.filter(all_rules, lambda r: r["url_contains"] == c))

    return pages.withColumn("rules", every).withColumn("rules", of_page(F.col("rules")))


def _grams(text: Column, size: int) -> Column:
    """All different runs of ``size`` characters."""
    if not size:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _gram_size(length: Column) -> Column:
    """The largest gram that a code of this length has: a power of two, none for the empty code."""
    size = F.lit(0)
    for n in (1, 2, 4, 8):
        size = F.when((length >= n) & F.lit(n <= LONGEST_GRAM), n).otherwise(size)
    return size


def code_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url url_contains``: for each url the first rule code that occurs in it, of any number of codes.

    An inverted index: each code is filed under the one of its grams that fewest codes have, a url is
    looked up by its grams, and what meets is compared as a whole.  Most grams of a url are those of all urls
    and file no code: a bitmap of fixed size leaves them out before anything moves.
    """
    codes = rules.where(F.col("url_contains").isNotNull()).groupBy("url_contains").agg(
        F.min("ord").alias("ord")
    ).withColumn("size", _gram_size(F.length("url_contains")))
    sizes = (0, *(n for n in (1, 2, 4, 8) if n <= LONGEST_GRAM))
    filed = codes.select("*", F.explode(F.coalesce(*[
        F.when(F.col("size") == n, _grams(F.col("url_contains"), n)) for n in sizes
    ])).alias("gram"))
    held = filed.groupBy("gram").agg(F.count("*").alias("held"))
    # Read three times below, so written once.
    rarest = tables.written(filed.join(held, "gram").groupBy("url_contains").agg(
        F.min("ord").alias("ord"), F.min(F.struct("held", "gram"))["gram"].alias("gram")
    ), "rule-codes")
    # The grams of sizes that no code has find nothing and need no lookup.
    used = [r["size"] for r in rarest.select(F.length("gram").alias("size")).distinct().collect()]  # five at most
    looked = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", F.explode(F.concat(
        F.array().cast("array<string>"), *[_grams(F.col("url"), n) for n in sorted(used)]
    )).alias("gram"))
    return _may_hold(looked, rarest).join(rarest, "gram").where(F.contains("url", "url_contains")).groupBy("url").agg(
        F.min(F.struct("ord", "url_contains"))["url_contains"].alias("url_contains")
    )


#: Words of the bitmap of grams, as a power of two: at most 2^20 rows of two longs travel to every task.
BITMAP_WORDS = 20


def _may_hold(looked: DataFrame, rarest: DataFrame) -> DataFrame:
    """The rows whose ``gram`` may be one of ``rarest``, and no more than a few others.

    A gram sets a bit by its hash.  The bitmap has at most so many rows whatever the number of codes; with more
    codes it lets more pass, and the join by gram decides.
    """
    def place(gram: Column) -> list[Column]:
        h = F.xxhash64(gram)
        return [F.shiftrightunsigned(h, 64 - BITMAP_WORDS).alias("__word"), (h.bitwiseAND(F.lit(63))).cast("int").alias("__bit")]

    bits = rarest.select(*place(F.col("gram"))).groupBy("__word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__bit"))).alias("__bits")
    )
    placed = looked.select("*", *place(F.col("gram"))).join(F.broadcast(bits), "__word")
    return placed.where(F.getbit("__bits", "__bit") == 1).select(*looked.columns)


def indexed_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Like :func:`with_rules` for any number of rules: two joins by key, and one to the pages."""
    # Used once: what was found is not looked up again to list fewer rules.
    found = code_matches(pages, rules)
    listed = rules.where(F.col("url_contains").isNotNull()).groupBy("url_contains").agg(
        F.sort_array(F.collect_list(F.struct(*RULE_FIELDS))).alias("rules")
    )
    of_url = found.join(listed, "url_contains").select("url", "rules")
    return pages.join(of_url, "url", "left").select(
        *pages.columns, F.coalesce("rules", F.array().cast(listed.schema["rules"].dataType)).alias("rules")
    )


def site_deals(html: Column, rules: Column) -> Column:
    """Deals of an array of site rules, in rule order, each with constant title and place."""
    text = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(html, P.SCRIPT_BLOCK, ""), P.STYLE_BLOCK, ""), P.TAG, " "
    )
    text = collapse_blanks(replace_entities(text, ("&diams;", "&bull;", "&nbsp;")))

    def apply(page: Column) -> Column:
        def one(rule: Column) -> Column:
            match = F.call_function("regexp_extract", page, rule["pattern"], F.lit(0))
            return let(match, lambda m: F.when(m != "", _deal(
                title=rule["title"],
                description=collapse_blanks(trim_blanks(m)),
                price=rule["price"],
                savings=rule["savings"],
                location=rule["location"],
            )))

        return F.filter(F.transform(rules, one), lambda d: d.isNotNull())

    return let(text, apply)


def page_deals(html: Column, rules: Column, limit: int | None = None) -> Column:
    """Deals by the page's site rules (see :func:`with_rules`), the generic ones where it has none."""
    return F.when(F.coalesce(F.size(rules), F.lit(0)) > 0, site_deals(html, rules)).otherwise(
        generic_deals(html, limit)
    )


# --- jobs ------------------------------------------------------------------------

def explode_texts(pages: DataFrame, key: str, values: Column, name: str) -> DataFrame:
    """One row per element of a per-page text array."""
    return pages.select(key, F.posexplode_outer(values).alias("pos", name)).where(
        F.col("pos").isNotNull()
    )


def explode_deals(pages: DataFrame, key: str, deals: Column) -> DataFrame:
    """One row per deal of a per-page deal array."""
    rows = explode_texts(pages, key, deals, "deal")
    return rows.select(key, "pos", *[F.col(f"deal.{f}").alias(f) for f in DEAL_FIELDS])


def page_summary(
    pages: DataFrame,
    site: str,
    site_label: str,
    rules: DataFrame,
    classes: Sequence[str] = P.SUMMARY_CLASSES,
    max_prices: int | None = None,
    max_dates: int | None = None,
    max_places: int | None = None,
    max_deals: int | None = None,
) -> DataFrame:
    """One row per page: head, size, record count, key elements and deals.

    The ``max_`` parameters keep only the first mentions or generic deals of a page.
    """
    html = F.col("html")
    selector = ", ".join("." + c for c in classes)
    keys = key_elements(html, max_prices, max_dates, max_places)
    return with_rules(pages, rules).select(
        "url",
        page_title(html).alias("title"),
        page_meta(html).alias("meta_description"),
        page_kind(html, site, site_label).alias("kind"),
        F.length(html).cast("bigint").alias("content_length"),
        F.size(page_promos(html, selector)).cast("bigint").alias("n_promos"),
        keys.alias("key_elements"),
        page_deals(html, F.col("rules"), max_deals).alias("deals"),
    )
