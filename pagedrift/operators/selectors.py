"""Elements of a page by structural selectors: the tree of its tags, walked once inside the row.

A selector is a comma list of paths; a path is a chain of steps joined by a blank (descendant) or
``>`` (child); a step is a tag or ``*`` with any of ``.class``, ``#id``, ``[a]``, ``[a=v]``,
``[a~=v]``, ``[a^=v]``, ``[a$=v]``, ``[a*=v]``.

The tags of a page are split off with the lengths of the texts between them, and each opening tag
gets a bit for each step it fits on its own.  One pass keeps the open elements with the bits of
the steps whose whole path leads to them, and of all above them; so a new element needs only the
bits of the one it opens in.  Work follows the tags of a page, times its depth; no shuffle, no Python.

What is not well formed: comments, declarations, scripts and styles hold no tags.  Void and self-closed elements
are empty.  A closing tag ends the innermost open element of its name and all that are open within
it; without one it means nothing.  ``li p td th tr dt dd option`` also end where the next of the
same name opens directly inside them.  What is open at the end of the page ends there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, trim_blanks

# --- fixed values: elements that hold nothing, and elements that end at the next of their name ---
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
)
NEXT_ENDS = ("li", "p", "td", "th", "tr", "dt", "dd", "option")

NAME = "[A-Za-z][A-Za-z0-9:-]*"
# Possessive: the parts can be told apart, so nothing is ever tried again.
ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">]+)*+"""
#: A tag; a comment, declaration, script or style counts as one token.  All begin alike, so most characters are looked at once.
TOKEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|![^>]*>|script(?:[\s/]" + ATTRIBUTES + r")?>.*?(?:</script\s*>|\z)"
    r"|style(?:[\s/]" + ATTRIBUTES + r")?>.*?(?:</style\s*>|\z)|/" + NAME + r"\s*>|" + NAME + r"(?:[\s/]" + ATTRIBUTES + ")?>)"
)
VALUE = r"""(?:"[^"]*"|'[^']*'|[A-Za-z0-9_-]+)"""
QUALIFIER = r"[.#][A-Za-z0-9_-]+|\[\s*[A-Za-z0-9_:-]+\s*(?:[~^$*]?=\s*" + VALUE + r"\s*)?\]"
STEP = r"(?:(?:[A-Za-z][A-Za-z0-9-]*|\*)(?:" + QUALIFIER + ")*|(?:" + QUALIFIER + ")+)"
#: A step with what joins it to the one before: a blank, ``>``, ``,`` or nothing.
JOINED = r"(\s*[>,]\s*|\s+|^)(" + STEP + ")"
MOST_STEPS = 60
#: Stands for a mark of an attribute value while a pattern is put together.
MARK = "\x01"


def _steps(selector: Column) -> Column:
    """``join`` and ``step`` of each step; null for a selector that is not understood."""
    plain = trim_blanks(selector)
    joins = F.regexp_extract_all(plain, F.lit(JOINED), F.lit(1))
    steps = F.regexp_extract_all(plain, F.lit(JOINED), F.lit(2))
    found = F.zip_with(joins, steps, lambda j, s: F.struct(
        # The first step and one after a comma begin a path.
        F.when(F.contains(j, F.lit(">")), ">").when(F.contains(j, F.lit(",")) | (j == ""), ",").otherwise(" ").alias("join"),
        s.alias("step"),
    ))
    known = (F.try_element_at(joins, F.lit(1)) == "") & (F.regexp_replace(plain, JOINED, "") == "") & (F.size(steps) <= MOST_STEPS)
    return F.when(known, found)


def understood(selector: Column) -> Column:
    return F.coalesce(_steps(selector).isNotNull(), F.lit(False))


def _quoted(text: Column) -> Column:
    """The text as a pattern that stands for itself."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def _tag_pattern(step: Column) -> Column:
    """Pattern for the opening tags that fit one step."""
    tag = F.regexp_extract(step, "^[A-Za-z0-9-]*", 0)
    # Attributes are looked for outside of the values of other ones.
    before = r"""(?=(?:"[^"]*"|'[^']*'|[^"'>\s]++|\s)*?\s"""

    def holds(inner: Column) -> Column:
        """An attribute value, in any quotes, that matches ``inner``."""
        def marks(of: str) -> Column:
            return F.replace(inner, F.lit(MARK), F.lit(of))

        return F.concat(
            F.lit(r'\s*=\s*(?:"'), marks(r'[^"]'), F.lit("\"|'"), marks("[^']"), F.lit("'|"),
            marks(r"""[^"'\s>]"""), F.lit(r"(?=\s|/?>)))"),
        )

    def word(value: Column) -> Column:
        return F.concat(F.lit(rf"(?:{MARK}*\s)?"), value, F.lit(rf"(?:\s{MARK}*)?"))

    def ahead(q: Column) -> Column:
        name = F.regexp_extract(q, r"^\[\s*([A-Za-z0-9_:-]+)", 1)
        sign = F.regexp_extract(q, r"^\[\s*[A-Za-z0-9_:-]+\s*([~^$*]?=)", 1)
        raw = F.regexp_extract(q, r"=\s*(" + VALUE + r")\s*\]$", 1)
        value = _quoted(F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))
        inner = (
            F.when(sign == "~=", word(value)).when(sign == "^=", F.concat(value, F.lit(f"{MARK}*")))
            .when(sign == "$=", F.concat(F.lit(f"{MARK}*"), value))
            .when(sign == "*=", F.concat(F.lit(f"{MARK}*"), value, F.lit(f"{MARK}*"))).otherwise(value)
        )
        own = F.substring(q, F.lit(2), F.length(q))
        return F.concat(F.lit(before), (
            F.when(F.startswith(q, F.lit(".")), F.concat(F.lit("class"), holds(word(own))))
            .when(F.startswith(q, F.lit("#")), F.concat(F.lit("id"), holds(own)))
            .when(sign == "", F.concat(name, F.lit(r"[\s=/>])")))
            .otherwise(F.concat(name, holds(inner)))
        ))

    needs = F.transform(F.regexp_extract_all(step, F.lit("(" + QUALIFIER + ")"), F.lit(1)), ahead)
    return F.concat(
        F.lit("(?is)^<"), F.when(tag == "", NAME).otherwise(tag), F.lit(r"(?=[\s/>])"), F.array_join(needs, "")
    )


def _none() -> Column:
    return F.lit(0).cast("long")


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number)


def _bits(steps: Column, holds) -> Column:
    """The steps for which ``holds`` says so, as bits."""
    numbered = F.transform(steps, lambda s, i: F.when(holds(s, i), _bit(i)).otherwise(_none()))
    return F.aggregate(numbered, _none(), lambda a, b: a.bitwiseOR(b))


def _plan(selector: Column) -> Column:
    """What the walk needs to know of a selector."""
    return let(_steps(selector), lambda steps: F.when(steps.isNotNull(), F.struct(
        F.transform(steps, lambda s: _tag_pattern(s["step"])).alias("patterns"),
        _bits(steps, lambda s, i: s["join"] == ",").alias("first"),
        _bits(steps, lambda s, i: s["join"] == ">").alias("child"),
        _bits(steps, lambda s, i: s["join"] == " ").alias("below"),
        # A path ends before the next one begins.
        _bits(steps, lambda s, i: (i == F.size(steps) - 1) | (F.get(steps, i + 1)["join"] == ",")).alias("last"),
    )))


def page_tags(html: Column) -> Column:
    """Each tag of a page: its text, length of the text before it and its own, its kind and name.

    They are the same for all selectors, so a page that is asked for several needs them once.
    """
    found = F.struct(
        F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)).alias("tags"),
        F.transform(F.split(html, TOKEN), F.length).alias("gaps"),
    )

    def read(tag: Column, gap: Column) -> Column:
        def named(name: Column) -> Column:
            kind = (
                F.when(name == "", "none").when(F.startswith(tag, F.lit("</")), "close")
                .when(name.isin("script", "style", *VOID) | F.endswith(tag, F.lit("/>")), "void").otherwise("open")
            )
            return F.struct(
                tag.alias("tag"), kind.alias("kind"), name.alias("name"), F.length(tag).alias("size"), gap.alias("gap"),
            )

        return let(F.lower(F.regexp_extract(tag, "^</?(" + NAME + ")", 1)), named)

    return let(found, lambda f: F.transform(f["tags"], lambda tag, i: read(tag, F.get(f["gaps"], i))))


def _fitting(tags: Column, patterns: Column) -> Column:
    """For each tag the steps that it fits, as bits."""
    # One pattern after the other over all tags.  This function keeps the pattern it has seen last compiled.
    by_step = F.transform(patterns, lambda p, step: F.transform(
        tags, lambda t: F.when(F.call_function("regexp_extract", t["tag"], p, F.lit(0)) != "", _bit(step)).otherwise(_none())
    ))
    return F.aggregate(
        by_step, F.transform(tags, lambda t: _none()), lambda all_, one: F.zip_with(all_, one, lambda a, b: a.bitwiseOR(b))
    )


OPEN = "array<struct<name:string,path:bigint,above:bigint,from:int,hits:bigint>>"
SPANS = "array<struct<from:int,until:int,hits:bigint>>"


def _walk(html: Column, tags: Column, fitting: Column, plan: Column | dict[str, Column]) -> Column:
    """Where each selected element is, by ``from``, with the bits of the last steps that select it.

    ``plan``: first, child, below and last; ``fitting``: for each tag the steps that it fits.
    """
    start = F.struct(
        F.array().cast(OPEN).alias("open"), F.array().cast(SPANS).alias("spans"), F.lit(0).alias("at")
    )

    def ended(gone: Column, until: Column) -> Column:
        return F.transform(F.filter(gone, lambda e: e["hits"] != 0), lambda e: F.struct(
            e["from"].alias("from"), until.alias("until"), e["hits"].alias("hits")
        ))

    def popped(now: Column, many: Column, at: Column, until: Column) -> Column:
        """Without the ``many`` innermost elements, which end at ``until``."""
        left = F.size(now["open"]) - many
        return F.struct(
            F.slice(now["open"], F.lit(1), left).alias("open"),
            F.concat(now["spans"], ended(F.slice(now["open"], left + 1, many), until)).alias("spans"),
            at.alias("at"),
        )

    def opened(now: Column, t: Column, own: Column, at: Column) -> Column:
        top = F.try_element_at(now["open"], F.lit(-1))
        path, above = F.coalesce(top["path"], F.lit(0)), F.coalesce(top["above"], F.lit(0))
        reach = plan["first"].bitwiseOR(F.shiftleft(path, 1).bitwiseAND(plan["child"])).bitwiseOR(
            F.shiftleft(above, 1).bitwiseAND(plan["below"]))
        mine = own.bitwiseAND(reach)

        def put(m: Column) -> Column:
            hits = m.bitwiseAND(plan["last"])
            return F.struct(
                F.when(t["kind"] == "void", now["open"]).otherwise(F.concat(now["open"], F.array(F.struct(
                    t["name"].alias("name"), m.alias("path"), above.bitwiseOR(m).alias("above"),
                    at.alias("from"), hits.alias("hits"),
                )))).alias("open"),
                F.when((t["kind"] == "void") & (hits != 0), F.concat(now["spans"], F.array(F.struct(
                    at.alias("from"), at.alias("until"), hits.alias("hits"))))).otherwise(now["spans"]).alias("spans"),
                at.alias("at"),
            )

        return let(mine, put)

    def step(now: Column, pair: Column) -> Column:
        t, own = pair["tag"], pair["own"]
        begin = now["at"] + t["gap"]
        at = begin + t["size"]
        # How far the innermost element of the name is from the innermost of all, from 1; 0: none is open.
        back = F.array_position(F.reverse(F.transform(now["open"], lambda e: e["name"])), t["name"]).cast("int")
        same = t["name"].isin(*NEXT_ENDS) & (F.try_element_at(now["open"], F.lit(-1))["name"] == t["name"])
        return (
            F.when(t["kind"] == "none", F.struct(now["open"].alias("open"), now["spans"].alias("spans"), at.alias("at")))
            .when(t["kind"] == "close", let(back, lambda many: popped(now, many, at, begin)))
            .when((t["kind"] == "open") & same, let(popped(now, F.lit(1), at, begin), lambda n: opened(n, t, own, at)))
            .otherwise(opened(now, t, own, at))
        )

    def close(now: Column) -> Column:
        # No two elements begin at the same place.
        return F.array_sort(F.concat(now["spans"], ended(now["open"], F.length(html))))

    pairs = F.zip_with(tags, fitting, lambda t, own: F.struct(t.alias("tag"), own.alias("own")))
    return F.aggregate(pairs, start, step, close)


def element_spans(html: Column, selector: Column | str) -> Column:
    """Where the content of each selected element is: ``from`` and ``until`` in characters, by ``from``.

    Null for a selector that is not understood.
    """
    selector = F.lit(selector) if isinstance(selector, str) else selector

    def known(plan: Column) -> Column:
        found = let(page_tags(html), lambda tags: _walk(html, tags, _fitting(tags, plan["patterns"]), plan))
        spans = F.transform(found, lambda s: F.struct(s["from"].alias("from"), s["until"].alias("until")))
        return F.when(plan.isNotNull() & html.isNotNull(), spans)

    return let(_plan(selector), known)


def _block(html: Column, span: Column) -> Column:
    return F.substring(html, span["from"] + 1, span["until"] - span["from"])


def element_blocks(html: Column, selector: Column | str) -> Column:
    """Content of each selected element, in page order; an element in another one is in both."""
    return F.transform(element_spans(html, selector), lambda s: _block(html, s))


@dataclass
class _Together:
    """Several selectors as one comma list: its steps, and for each selector the bits of its last steps."""

    fits: dict[str, int] = field(default_factory=dict)  # by pattern: the steps it stands for
    masks: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("first", "child", "below", "last"), 0))
    selectors: list[tuple[str, int]] = field(default_factory=list)
    size: int = 0

    def add(self, selector: str, plan: Row) -> None:
        for n, pattern in enumerate(plan["patterns"], self.size):
            self.fits[pattern] = self.fits.get(pattern, 0) | 1 << n
        for mask in self.masks:
            self.masks[mask] |= plan[mask] << self.size
        self.selectors.append((selector, plan["last"] << self.size))
        self.size += len(plan["patterns"])


def _together(selectors: Sequence[str]) -> list[_Together]:
    """The selectors that are understood, read once, in groups of up to ``MOST_STEPS`` steps."""
    groups: list[_Together] = []
    if not selectors:
        return groups
    read = SparkSession.active().range(0, 1, 1, 1).select(*[_plan(F.lit(s)).alias(f"p{n}") for n, s in enumerate(selectors)])
    for selector, plan in zip(selectors, read.first()):
        if plan is None:
            continue
        if not groups or groups[-1].size + len(plan["patterns"]) > MOST_STEPS:
            groups.append(_Together())
        groups[-1].add(selector, plan)
    return groups


FOUND = "array<struct<selector:string,pos:int,block:string>>"


def blocks_of_all(html: Column, tags: Column, selectors: Sequence[str]) -> Column:
    """``selector pos block`` of each element that one of ``selectors`` names: :func:`element_blocks` of all of them.

    The selectors are read once, and the tags of a page (``tags``, see :func:`page_tags`) are walked once for all.
    """
    def long(number: int) -> Column:
        return F.lit(number).cast("long")

    def of_group(group: _Together) -> Column:
        def fits(tag: Column) -> Column:
            own = _none()
            for pattern, steps in group.fits.items():
                own = own.bitwiseOR(F.when(tag["tag"].rlike(pattern), long(steps)).otherwise(_none()))
            return F.when(tag["kind"].isin("open", "void"), own).otherwise(_none())

        def of_one(found: Column, selector: str, last: int) -> Column:
            own = F.filter(found, lambda s: s["hits"].bitwiseAND(long(last)) != 0)
            return F.transform(own, lambda s, n: F.struct(
                F.lit(selector).alias("selector"), n.alias("pos"), s["block"].alias("block")
            ))

        def split(found: Column) -> Column:
            return F.concat(*[of_one(found, selector, last) for selector, last in group.selectors])

        spans = _walk(html, tags, F.transform(tags, fits), {k: long(v) for k, v in group.masks.items()})
        return let(F.transform(spans, lambda s: F.struct(s["hits"].alias("hits"), _block(html, s).alias("block"))), split)

    groups = _together(selectors)
    return F.concat(F.array().cast(FOUND), *[of_group(g).cast(FOUND) for g in groups])
