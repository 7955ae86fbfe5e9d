"""Building blocks of the check SQL (DuckDB dialect)."""

from __future__ import annotations

from pagedrift import patterns as P

FIELDS = ("title", "perk", "dates", "price")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return lit(P.re2_regex(pattern))


def sub(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, {rx(pattern)}, {lit(replacement)}, 'g')"


def one(expr: str, pattern: str, group: int = 0) -> str:
    return f"coalesce(regexp_extract({expr}, {rx(pattern)}, {group}), '')"


def every(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {rx(pattern)}, {group})"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {rx(pattern)})"


def trim(expr: str) -> str:
    return sub(expr, r"\A\s+|\s+\z")


def collapse(expr: str) -> str:
    return sub(expr, r"\s+", " ")


def normalize(expr: str) -> str:
    out = f"coalesce({expr}, '')"
    for p in P.NORMALIZE_REMOVALS:
        out = sub(out, p)
    for p, r in P.NORMALIZE_COLLAPSE:
        out = sub(out, p, r)
    return trim(out)


def noise(expr: str) -> str:
    out = f"coalesce({expr}, '')"
    for p in P.NOISE_REMOVALS:
        out = sub(out, p)
    return trim(sub(collapse(out), P.NOISE_EDGE_MARKS))


def clean(expr: str) -> str:
    return noise(normalize(expr))


def hash16(expr: str) -> str:
    return f"substr(sha256({expr}), 1, 16)"


def promo_id(title: str, perk: str, dates: str, price: str) -> str:
    return hash16(" || '|' || ".join(normalize(e) for e in (title, perk, dates, price)))


def to_text(html: str, scripts: bool = True) -> str:
    out = html
    if scripts:
        out = sub(sub(out, P.SCRIPT_BLOCK), P.STYLE_BLOCK)
    return collapse(sub(out, P.TAG, " "))


def entities(expr: str, names=None) -> str:
    out = expr
    for entity, char in P.ENTITIES:
        if names is None or entity in names:
            out = f"replace({out}, {lit(entity)}, {lit(char)})"
    return out


def decode(expr: str) -> str:
    out = entities(expr)
    for p, r in P.ARTIFACT_PREFIXES:
        out = sub(out, p, r)
    return trim(collapse(out))


def escape(expr: str, cut: bool = True) -> str:
    out = f"coalesce({expr}, '')"
    for char, entity in P.ESCAPES:
        out = f"replace({out}, {lit(char)}, {lit(entity)})"
    for p in P.UNSAFE_ESCAPED:
        out = sub(out, p)
    for mark in P.MARKDOWN_MARKS:
        out = f"replace({out}, {lit(mark)}, {lit(chr(92) + mark)})"
    return f"substr({out}, 1, {P.MESSAGE_TEXT_LIMIT})" if cut else out


def age(iso: str, as_of: str) -> str:
    """Relative age of an ISO text that may be unreadable."""
    ts = f"try_cast({iso} as timestamp)"
    minutes = f"floor((epoch_ms(timestamp '{as_of}') - epoch_ms({ts})) / 60000)"

    def ago(n: str, unit: str) -> str:
        return f"cast(cast({n} as bigint) as varchar) || ' {unit}' || case when {n} = 1 then '' else 's' end || ' ago'"

    hours, days = f"floor({minutes} / 60)", f"floor(floor({minutes} / 60) / 24)"
    return (
        f"case when {ts} is null then {iso} when {minutes} < 1 then 'just now' "
        f"when {minutes} < 60 then {ago(minutes, 'minute')} when {hours} < 24 then {ago(hours, 'hour')} "
        f"when {days} < 7 then {ago(days, 'day')} else strftime({ts}, '%b %-d, %-I:%M %p') end"
    )


def like_text(a: str, b: str, ca: str, cb: str) -> str:
    """Similar texts, given the raw columns and their cleaned lower-case columns."""
    far = f"cast(greatest(length({ca}), length({cb})) as double)"
    return (
        f"case when {a} = '' and {b} = '' then true when {a} = '' or {b} = '' then false "
        f"when {ca} = {cb} then true when {ca} = '' or {cb} = '' then false "
        f"else ({far} - levenshtein({ca}, {cb})) / {far} > {P.TEXT_SIMILARITY} end"
    )


def amounts(expr: str) -> str:
    return (
        f"list_transform({every(expr, P.PRICE_NUMBER, 1)}, "
        "lambda m: try_cast(replace(m, ',', '') as double))"
    )


def like_price(a: str, b: str, text_rule: str) -> str:
    pa, pb = amounts(a), amounts(b)
    near = (
        f"list_bool_and(list_transform(list_zip({pa}, {pb}), lambda z: coalesce("
        f"abs(z[1] - z[2]) <= greatest(1.0, z[1] * 0.01), true)))"
    )
    return (
        f"case when {a} = '' and {b} = '' then true when {a} = '' or {b} = '' then false "
        f"when len({pa}) = 0 and len({pb}) = 0 then {text_rule} "
        f"when len({pa}) <> len({pb}) then false else {near} end"
    )


def days(expr: str) -> str:
    def build(y: str, m: str, d: str) -> str:
        return (
            f"cast(make_date({y}, 1, 1) + to_months(cast({m} as integer) - 1) "
            f"+ to_days(cast({d} as integer) - 1) as date)"
        )

    def num(pattern: str, group: int) -> str:
        return f"cast(regexp_extract(m, {rx(pattern)}, {group}) as bigint)"

    def century(y: str) -> str:
        return f"(case when {y} < 100 then {y} + 1900 else {y} end)"

    mdy = f"list_transform({every(expr, P.DATE_MDY)}, lambda m: {build(century(num(P.DATE_MDY, 3)), num(P.DATE_MDY, 1), num(P.DATE_MDY, 2))})"
    iso = f"list_transform({every(expr, P.DATE_ISO)}, lambda m: {build(century(num(P.DATE_ISO, 1)), num(P.DATE_ISO, 2), num(P.DATE_ISO, 3))})"
    months = "[" + ", ".join(lit(x) for x in P.MONTHS) + "]"
    month = f"list_position({months}, lower(regexp_extract(m, {rx(P.DATE_MONTH_NAME)}, 1)))"
    y = num(P.DATE_MONTH_NAME, 3)
    year = f"(case when {y} < 50 then {y} + 2000 when {y} < 100 then {y} + 1900 else {y} end)"
    day = num(P.DATE_MONTH_NAME, 2)
    named = (
        f"list_transform({every(expr, P.DATE_MONTH_NAME)}, lambda m: case when {day} between 1 and 31 "
        f"then {build(year, month, day)} end)"
    )
    return f"list_filter(list_concat({mdy}, {iso}, {named}), lambda d: d is not null)"


def like_dates(a: str, b: str, text_rule: str) -> str:
    da, db = days(a), days(b)
    near = (
        f"len(list_filter({da}, lambda x: len(list_filter({db}, "
        f"lambda y: abs(date_diff('day', x, y)) <= 7)) > 0)) > 0"
    )
    return (
        f"case when {a} = '' and {b} = '' then true when {a} = '' or {b} = '' then false "
        f"when len({da}) > 0 and len({db}) > 0 then {near} else {text_rule} end"
    )


def material_promo(prefix: str) -> str:
    c = {f: f"coalesce({prefix}{f}, '')" for f in FIELDS}
    title = f"length({trim(c['title'])}) > 3"
    perk = f"length({trim(c['perk'])}) > 10"
    price = has(c["price"], P.HAS_PRICE)
    dates = f"length({trim(c['dates'])}) > 5"
    joined = "lower(" + " || ' ' || ".join(c[f] for f in FIELDS) + ")"
    noisy = " or ".join(has(joined, p) for p in P.IMMATERIAL_TEXT)
    return f"(({title}) or ({perk})) and ({price} or {dates} or {perk}) and not ({noisy})"


def with_clean(source: str, sides: tuple[str, str] = ("a_", "b_")) -> str:
    """``source`` with a cleaned column ``c_...`` and a lower-case one ``l_...`` per field."""
    cols = ", ".join(f"{clean(s + f)} as c_{s}{f}" for s in sides for f in FIELDS)
    low = ", ".join(f"lower(c_{s}{f}) as l_{s}{f}" for s in sides for f in FIELDS)
    return f"(select *, {low} from (select *, {cols} from {source}))"


def equal_records(a: str, b: str) -> str:
    return "(" + " and ".join(f"c_{a}{f} = c_{b}{f}" for f in FIELDS) + ")"


def text_rule(f: str, a: str = "a_", b: str = "b_") -> str:
    return like_text(a + f, b + f, f"l_{a}{f}", f"l_{b}{f}")


def material_edit(a: str = "a_", b: str = "b_") -> str:
    price = like_price(a + "price", b + "price", text_rule("price", a, b))
    dates = like_dates(a + "dates", b + "dates", text_rule("dates", a, b))
    return f"not (({text_rule('title', a, b)}) and ({text_rule('perk', a, b)}) and ({price}) and ({dates}))"


def host(url: str) -> str:
    return f"lower({one(url, P.HTTPS_HOST, 1)})"


def public(url: str) -> str:
    h = host(url)
    bad = (
        f"{h} in ('localhost', '169.254.169.254', 'metadata.google.internal') "
        f"or starts_with({h}, '127.') or starts_with({h}, '10.') or starts_with({h}, '192.168.') "
        + "".join(f"or starts_with({h}, '172.{n}.') " for n in range(16, 32))
        + f"or contains({h}, '169.254.') or ends_with({h}, '.internal') or ends_with({h}, '.local')"
    )
    return f"({h} <> '' and not ({bad}))"


def allowed(url: str, domains) -> str:
    h = host(url)
    ok = " or ".join(f"{h} = {lit(d)} or ends_with({h}, {lit('.' + d)})" for d in domains)
    return f"({public(url)} and ({ok}))"


def selector_ok(s: str) -> str:
    return (
        f"({has(s, P.SELECTOR_SAFE)} and length({s}) <= 200 and not {has(s, P.SELECTOR_UNSAFE)})"
    )


def plural(n: str, one_text: str, many_text: str) -> str:
    return f"cast({n} as varchar) || case when {n} = 1 then {lit(one_text)} else {lit(many_text)} end"


def change_sentence(none: str) -> str:
    """From columns n_added, n_removed, n_changed."""
    parts = (
        "list_filter(["
        f"case when n_added > 0 then {plural('n_added', ' new promotion', ' new promotions')} end, "
        f"case when n_removed > 0 then {plural('n_removed', ' promotion removed', ' promotions removed')} end, "
        f"case when n_changed > 0 then {plural('n_changed', ' promotion updated', ' promotions updated')} end"
        "], lambda x: x is not null)"
    )
    return (
        f"case len({parts}) when 0 then {lit(none)} when 1 then {parts}[1] "
        f"when 2 then {parts}[1] || ' and ' || {parts}[2] "
        f"else {parts}[1] || ', ' || {parts}[2] || ', and ' || {parts}[3] end"
    )
