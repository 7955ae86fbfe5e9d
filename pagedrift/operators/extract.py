"""Pages to records: containers, fields, text fallback, content ids.

One page stays one row until the records are exploded, so extraction never shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions.text import (
    collapse_blanks,
    let,
    normalize_text,
    promo_id,
    strip_tags,
    trim_blanks,
)
from ..schemas import FIELDS
from .selectors import blocks_of_all, element_blocks, page_tags, understood


# One element: a tag name, and classes, ids and attribute names it must have.
QUALIFIER = r"[.#][A-Za-z0-9_-]+|\[[A-Za-z0-9_:-]+\]"
ELEMENT = r"(?:[A-Za-z][A-Za-z0-9-]*|\*)?(?:" + QUALIFIER + ")*"


def container_pattern(selector: Column) -> Column:
    """Expression for the opening tags that a selector names, or null for a selector of a kind
    that is not supported.

    Supported: ``tag``, ``.class``, ``#id``, ``[attribute]``, any of them joined for one element
    (``div.promo[data-x]``), and comma lists.
    """
    parts = F.transform(F.split(selector, ","), trim_blanks)
    known = F.forall(parts, lambda p: (p != "") & p.rlike("^(?:" + ELEMENT + ")$"))

    def ahead(q: Column) -> Column:
        name = F.regexp_replace(q, r"[.#\[\]]", "")
        return (
            F.when(q.startswith("."), F.concat(
                F.lit(r'(?=[^>]*class="[^"]*' + P.WORD_EDGE), name, F.lit(P.WORD_EDGE + r'[^"]*")')))
            .when(q.startswith("#"), F.concat(
                F.lit(r"""(?=[^>]*\sid=["']?"""), name, F.lit(r"""["'\s>])""")))
            .otherwise(F.concat(F.lit(r"(?=[^>]*\s"), name, F.lit(r"[\s=/>])")))
        )

    def element(p: Column) -> Column:
        tag = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9-]*", 0)
        needs = F.transform(F.regexp_extract_all(p, F.lit(QUALIFIER), F.lit(0)), ahead)
        name = F.when(tag == "", "[A-Za-z][A-Za-z0-9-]*").otherwise(tag)
        return F.concat(name, F.lit(r"(?=[\s/>])"), F.array_join(needs, ""))

    # Most tags have no class: where every part asks for one, that is looked at once for all of them.
    classy = F.when(F.forall(parts, lambda p: F.contains(p, F.lit("."))), r'(?=[^>]*class=")').otherwise("")
    pattern = F.concat(
        F.lit("(?is)<"), classy, F.lit("(?:"), F.array_join(F.transform(parts, element), "|"), F.lit(")[^>]*>")
    )
    return F.when(known, pattern)


@lru_cache(maxsize=None)
def _constant_pattern(selector: str) -> str | None:
    """The pattern of one selector, read once instead of for every page."""
    row = SparkSession.active().range(0, 1, 1, 1).select(container_pattern(F.lit(selector)))
    return row.first()[0]


def selector_supported(selector: Column, mode: str = "lazy") -> Column:
    return understood(selector) if mode == "tree" else container_pattern(selector).isNotNull()


def container_blocks(html: Column, selector: Column | str, mode: str = "lazy") -> Column:
    """Content of every container element, in page order; null for an unsupported selector.

    ``lazy`` ends a container at its first closing tag, ``balanced`` at the next container (or
    the end of the page), ``last`` keeps only the last lazy container.  ``tree`` ends each at its own
    closing tag and takes all selectors of :mod:`.selectors`.
    """
    if mode == "tree":
        return element_blocks(html, selector)
    constant = isinstance(selector, str)
    opening = F.lit(_constant_pattern(selector)).cast("string") if constant else container_pattern(selector)
    if mode == "balanced":
        pieces = F.split(html, opening)
        return F.slice(pieces, F.lit(2), F.size(pieces))
    pattern = F.concat(opening, F.lit(r"(.*?)</[^>]*>"))
    blocks = F.regexp_extract_all(html, pattern, F.lit(1))
    if mode == "last":
        return F.when(F.size(blocks) > 0, F.slice(blocks, -1, 1)).otherwise(blocks)
    if mode != "lazy":
        raise ValueError(f"unknown container mode: {mode}")
    return blocks


def _first_field(block: Column, patterns: list[str]) -> Column:
    """Tag-free text of the first pattern that matches (even when its text is empty)."""
    if not patterns:
        return F.lit("")
    java, others = P.java_regex(patterns[0]), _first_field(block, patterns[1:])
    # The block is searched once; the group is read from the match, which begins and ends with a tag.
    found = let(F.regexp_extract(block, java, 0), lambda match: F.when(
        match != "", strip_tags(F.regexp_extract(match, java, 1))
    ).otherwise(others))
    gate = P.class_gate(patterns[0])
    return found if gate is None else F.when(block.rlike(gate), found).otherwise(others)


def block_text(block: Column) -> Column:
    return trim_blanks(collapse_blanks(F.regexp_replace(block, P.TAG, " ")))


def promo_fields(block: Column) -> Column:
    """Raw title, perk, dates and price of a container block, '' where missing."""
    classes = {f: P.class_element(P.FIELD_CLASSES[f]) for f in FIELDS}
    return F.struct(
        _first_field(block, [P.TITLE_HEADING, classes["title"]]).alias("title"),
        _first_field(block, [classes["perk"], P.PERK_PARAGRAPH]).alias("perk"),
        _first_field(block, [classes["dates"]]).alias("dates"),
        _first_field(block, [classes["price"]]).alias("price"),
    )


def promo_record(title: Column, perk: Column, dates: Column, price: Column) -> Column:
    values = dict(zip(FIELDS, (title, perk, dates, price)))
    return F.struct(promo_id(title, perk, dates, price).alias("id"),
                    *[v.alias(k) for k, v in values.items()])


def build_promo(fields: Column) -> Column:
    """Normalised record with its content id; null without a title and a perk."""
    normal = F.struct(*[normalize_text(fields[f]).alias(f) for f in FIELDS])
    return F.when(
        (fields["title"] != "") | (fields["perk"] != ""),
        let(normal, lambda n: promo_record(*[n[f] for f in FIELDS])),
    )


def promo_from_text(text: Column) -> Column:
    """Record guessed from plain text; null when the text is too short.

    Normalising removes blank lines, so a text is always one block.
    """
    def found_in(block: Column, pattern: str) -> Column:
        return F.regexp_extract(block, P.java_regex(P.BLOCK_STARTS[pattern] + "(?:" + pattern + ")"), 0)

    def read(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), trim_blanks), lambda l: l != "")
        found = F.struct(
            F.element_at(lines, 1).alias("title"),
            F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))).alias("rest"),
            found_in(block, P.BLOCK_PERK).alias("perk"),
            found_in(block, P.BLOCK_DATES).alias("dates"),
            found_in(block, P.BLOCK_PRICE).alias("price"),
        )

        def record(f: Column) -> Column:
            nothing = (f["perk"] == "") & (f["dates"] == "") & (f["price"] == "")
            perk = F.when(nothing, F.array_join(f["rest"], " ")).otherwise(f["perk"])
            return promo_record(f["title"], perk, f["dates"], f["price"])

        return F.when(F.length(trim_blanks(block)) > P.BLOCK_MIN, let(found, record))

    return let(normalize_text(text), read)


def block_promo(block: Column) -> Column:
    """Record of one container block: fields first, the text of the block otherwise."""

    def choose(f: Column) -> Column:
        nothing = F.lit(True)
        for field in FIELDS:
            nothing = nothing & (f[field] == "")
        titled = F.struct(
            F.when(f["title"] == "", block_text(block)).otherwise(f["title"]).alias("title"),
            *[f[field].alias(field) for field in FIELDS[1:]],
        )
        return F.when(nothing, promo_from_text(block_text(block))).otherwise(build_promo(titled))

    return F.when(trim_blanks(block) != "", let(promo_fields(block), choose))


def page_promos(html: Column, selector: Column | str, mode: str = "lazy") -> Column:
    """All records of a page as an array, in page order; null for an unsupported selector."""
    found = F.transform(container_blocks(html, selector, mode), block_promo)
    return F.filter(found, lambda p: p.isNotNull())


def explode_containers(pages: DataFrame, selector: Column | str, mode: str = "lazy") -> DataFrame:
    """One row per container: the page's columns, ``pos`` and ``block``."""
    keep = [c for c in pages.columns if c != "html"]
    return pages.select(
        *keep, F.posexplode_outer(container_blocks(F.col("html"), selector, mode)).alias("pos", "block")
    ).where(F.col("pos").isNotNull())


def explode_elements(pages: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """One row per selector and element (mode ``tree``): the page's columns, ``selector``, ``pos`` and ``block``.

    The tags of a page are read and walked once for all selectors.
    """
    keep = [c for c in pages.columns if c != "html"]
    read = pages.withColumn("__tags", page_tags(F.col("html")))
    return read.select(*keep, F.inline(blocks_of_all(F.col("html"), F.col("__tags"), selectors)))


def extract_promos(pages: DataFrame, selector: Column | str, mode: str = "lazy") -> DataFrame:
    """One row per record: the page's columns, ``pos`` of its container and the record fields."""
    keep = [c for c in pages.columns if c != "html"]
    # The records are read within the page; a block never becomes a row.
    records = F.transform(container_blocks(F.col("html"), selector, mode), lambda block, pos: F.struct(
        pos.alias("pos"), block_promo(block).alias("promo")
    ))
    held = F.filter(records, lambda r: r["promo"].isNotNull())
    found = pages.select(*keep, F.explode_outer(held).alias("__found")).where(F.col("__found").isNotNull())
    return found.select(*keep, "__found.pos", "__found.promo.*")
