"""Text columns: normalising, noise removal, hashing, markup clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, usable anywhere in an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remove(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, P.java_regex(pattern), "")


def trim_blanks(col: Column) -> Column:
    """Trim every Unicode blank; the built-in default only trims the space."""
    return F.btrim(col, F.lit(P.BLANK_CHARS))


# Runs of blanks to one space.  A single space stays as it is, so it need not match.
COLLAPSE = (r"[^\S ]\s*| \s+", " ")
# The same where tags count as blanks.  Possessive, so long runs are no deep recursion.
COLLAPSE_MARKUP = r"(?:<[^>]*>|[^\S ])(?:<[^>]*>|\s)*+| (?:<[^>]*>|\s)++"


def collapse_blanks(col: Column) -> Column:
    return F.regexp_replace(col, P.java_regex(COLLAPSE[0]), COLLAPSE[1])


NORMALIZE = (*[(p, "") for p in P.NORMALIZE_REMOVALS], *P.NORMALIZE_COLLAPSE)
FILTER_NOISE = (*[(p, "") for p in P.NOISE_REMOVALS], COLLAPSE, (P.NOISE_EDGE_MARKS, ""))
# What a text must hold, in lower case, for a step to find anything; () for steps without a gate.
NORMALIZE_GATES = (
    ("/",), ("-",), (":",), (), ("ref:",), ("utm_",), ("track",), ("id:", "id="), ("view", "click", "visit"), (":",), ("(",),
    ("  ", "\t"), ("\n",),
)
# What a text must hold for the one step without a gate.
NORMALIZE_UNGATED = "[A-Z0-9]{8}"
NOISE_GATES = (
    ("limited time", "act now", "hurry", "expires soon", "while supplies last"),
    ("call now", "book today", "reserve now", "don't wait"), ("*",), ("terms",), ("conditions",), ("restrictions",),
    ("booked", "viewed", "saved"), ("trending", "popular", "bestseller", "top rated"), (), ("!",),
)


def replace_in_order(
    col: Column, steps: tuple[tuple[str, str], ...], gates: tuple[tuple[str, ...], ...] | None = None,
    ungated: str | None = None,
) -> Column:
    """Apply (pattern, replacement) steps one after the other; null counts as ''.

    A step whose gate the text does not pass is left out, which changes nothing but the time.
    ``ungated``: found wherever a step without a gate finds something; a text without it that passes no
    gate stays as it is, which one look settles for all steps.
    The steps are one SQL expression, so a long chain is one to send and to analyse.
    """
    if gates is not None and len(gates) != len(steps):
        raise ValueError("a gate for each step is needed")
    body = "coalesce(t, '')"
    for n, (pattern, replacement) in enumerate(steps):
        gate = gates[n] if gates else ()
        if not gate:
            body = f'regexp_replace({body}, r"{P.java_regex(pattern)}", "{replacement}")'
            continue
        plain = all(not c.isalpha() for g in gate for c in g)
        tests = " or ".join(f"contains({'s' if plain else 'lower(s)'}, {_literal(g)})" for g in gate)
        step = f'regexp_replace(s, r"{P.java_regex(pattern)}", "{replacement}")'
        body = f"transform(array({body}), s -> if({tests}, {step}, s))[0]"
    if ungated is not None:
        body = f"if({_may_find(gates, ungated)}, {body}, coalesce(t, ''))"
    return F.element_at(F.call_function("transform", F.array(col), F.expr(f"t -> {body}")), 1)


def _may_find(gates: tuple[tuple[str, ...], ...], ungated: str) -> str:
    """Whether any step may find something in a text ``t``; null or false if none does."""
    words = sorted({g for gate in gates for g in gate})
    # Where a word holds another one, the other one says enough.
    words = [w for w in words if not any(v != w and v in w for v in words)]
    letters = [w for w in words if any(c.isalpha() for c in w)]
    plain = [f"contains(t, {_literal(w)})" for w in words if w not in letters]
    lower = " or ".join(f"contains(l, {_literal(w)})" for w in letters)
    return " or ".join([*plain, f"transform(array(lower(t)), l -> {lower})[0]", f't rlike r"{ungated}"'])


def _literal(text: str) -> str:
    return '"' + text.replace("\t", "\\t").replace("\n", "\\n") + '"'


def normalize_text(col: Column) -> Column:
    """Drop dates, times, tracking codes, counters and update notes; tidy blanks."""
    return trim_blanks(replace_in_order(col, NORMALIZE, NORMALIZE_GATES, NORMALIZE_UNGATED))


def filter_noise(col: Column) -> Column:
    """Drop urgency, call-to-action, disclaimer and social-proof phrases."""
    return trim_blanks(replace_in_order(col, FILTER_NOISE, NOISE_GATES))


def clean_text(col: Column) -> Column:
    """The comparable form of a field: normalised, then without noise."""
    return filter_noise(normalize_text(col))


def content_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 16)


def state_key(url: Column) -> Column:
    return F.concat(F.lit("state:"), content_hash(url))


def history_key(url: Column, iso_ts: Column) -> Column:
    return F.concat(F.lit("hist:"), content_hash(url), F.lit(":"), iso_ts)


def promo_id(title: Column, perk: Column, dates: Column, price: Column) -> Column:
    """Content id of a record: equal text gives an equal id."""
    return content_hash(F.concat_ws("|", *[normalize_text(c) for c in (title, perk, dates, price)]))


def promos_hash(promos: Column) -> Column:
    """Order-sensitive hash of one page's record array."""
    return content_hash(F.coalesce(F.to_json(promos), F.lit("[]")))


def html_to_text(html: Column, strip_scripts: bool = True) -> Column:
    out = html
    if strip_scripts:
        out = remove(remove(out, P.SCRIPT_BLOCK), P.STYLE_BLOCK)
    return F.regexp_replace(out, P.java_regex(COLLAPSE_MARKUP), " ")


def strip_tags(col: Column) -> Column:
    return trim_blanks(F.regexp_replace(col, P.TAG, ""))


def replace_entities(col: Column, names: tuple[str, ...] | None = None) -> Column:
    out = col
    for entity, char in P.ENTITIES:
        if names is None or entity in names:
            out = F.replace(out, F.lit(entity), F.lit(char))
    return out


ANY_ARTIFACT = "|".join(pattern for pattern, _ in P.ARTIFACT_PREFIXES)


def decode_entities(col: Column) -> Column:
    """Entities to characters, then the known leading artefacts of cut-off text."""

    def without_artifacts(text: Column) -> Column:
        out = text
        for pattern, replacement in P.ARTIFACT_PREFIXES:
            out = F.regexp_replace(out, P.java_regex(pattern), replacement)
        # Where none is found none comes up after another one.
        return F.when(text.rlike(P.java_regex(ANY_ARTIFACT)), out).otherwise(text)

    # Every entity has this mark.
    plain = let(col, lambda c: F.when(c.contains("&"), replace_entities(c)).otherwise(c))
    return trim_blanks(collapse_blanks(let(plain, without_artifacts)))


# What a text must hold, in lower case, for a step to find anything; the last one needs a mark for an assignment.
UNSAFE_GATES = (*[("&lt;",)] * 6, ("javascript:",), ("data:text/html",), ())


def escape_markup(col: Column, limit: int | None = None) -> Column:
    """Text that is safe inside a chat message: HTML and markdown escaped.

    ``limit``: cut to so many characters (default: not at all).
    """
    out = F.coalesce(col, F.lit(""))
    for char, entity in P.ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    out = replace_in_order(out, tuple((pattern, "") for pattern in P.UNSAFE_ESCAPED), UNSAFE_GATES, "=")
    # Every mark gets a backslash in front.
    out = F.regexp_replace(out, "([" + "".join(P.MARKDOWN_MARKS) + "])", r"\\$1")
    return out if limit is None else F.substring(out, 1, limit)


def truncate_text(col: Column, limit: int = 10000) -> Column:
    return F.when(
        F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("... [truncated]"))
    ).otherwise(col)


def relative_age(iso_ts: Column, as_of: Column) -> Column:
    """``5 minutes ago`` for recent times, a short date otherwise, unknown text unchanged."""
    ts = F.try_to_timestamp(iso_ts)
    minutes = F.floor((F.unix_millis(as_of) - F.unix_millis(ts)) / 60000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(
            n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago")
        )

    return (
        F.when(ts.isNull(), iso_ts)
        .when(minutes < 1, "just now")
        .when(minutes < 60, ago(minutes, "minute"))
        .when(hours < 24, ago(hours, "hour"))
        .when(days < 7, ago(days, "day"))
        .otherwise(F.date_format(ts, "MMM d, h:mm a"))
    )
