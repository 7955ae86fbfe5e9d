"""Check SQL of every registered job (DuckDB dialect), by job name."""

from __future__ import annotations

from pagedrift import patterns as P
from pagedrift.sources.derived import AS_OF, DOMAINS
from pagedrift.sources.derived import duckdb_sql as D

from . import parts as S
from .parts import FIELDS, lit

SQL: dict[str, str] = {}
PREV, CURR = D("promos_prev"), D("promos_curr")
TARGETS, CRAWL, RESULTS, HISTORY = D("targets"), D("crawl"), D("results"), D("history")
OFFERS = D("offer_pages")
CLASSES = ("promo", "deal-card")

# --- targets, crawl, policy --------------------------------------------------------
PROBLEM = f"""case
 when coalesce({S.trim('url')}, '') = '' then 'url missing'
 when coalesce({S.trim('selector')}, '') = '' then 'selector missing'
 when not {S.allowed('url', DOMAINS)} then 'url not allowed'
 when not {S.selector_ok('selector')} then 'selector not allowed'
 when name is not null and (length(name) = 0 or length(name) > 100) then 'name length'
 when {S.has('name', P.NAME_UNSAFE)} then 'name unsafe'
 when length(notes) > 500 then 'notes length'
 when {S.has('notes', P.NOTES_UNSAFE)} then 'notes unsafe' end"""
CHECKED = f"(select *, {PROBLEM} as problem from {TARGETS} t)"
SQL["scan_targets"] = f"select url, selector, name, notes, enabled from {CHECKED} where problem is null"
SQL["replace_targets"] = SQL["scan_targets"]
SQL["validate_targets"] = f"select pos, url, problem, problem is null as valid from {CHECKED}"
SQL["enabled_targets"] = f"select * from {TARGETS} t where enabled is distinct from false"
SQL["url_policy"] = f"""select url, {S.host('url')} as host, {S.allowed('url', DOMAINS)} as allowed
from (select url from pages union all select url from {TARGETS} t)"""
SQL["tenant_policy"] = f"""select tenant, pos, url, coalesce({S.public('url')} and exists(
 select 1 from {D('tenant_domains')} d where d.tenant = u.tenant
  and ({S.host('url')} = lower(domain) or ends_with({S.host('url')}, '.' || lower(domain)))), false) as allowed
from {D('tenant_urls')} u"""
SQL["selector_policy"] = f"select pos, selector, {S.selector_ok('selector')} as allowed from {TARGETS} t"
FETCH = f"""case when not {S.allowed('url', DOMAINS)}
   then 'URL not allowed: Only HTTPS URLs from approved domains are permitted'
 when status < 200 or status > 299 then 'HTTP ' || cast(status as varchar) || ': ' || status_text
 when not contains(coalesce(content_type, ''), 'text/html')
   then 'Unexpected content type: ' || coalesce(content_type, '') end"""
SQL["crawl_accept"] = f"""select fetch_id, url, e is null as accepted, 'Failed to fetch content: ' || e as error
from (select *, {FETCH} as e from {CRAWL} c)"""
SQL["scan_pages"] = "select page_id, url, html from pages"
SQL["targets_to_pages"] = f"""select c.url, c.fetch_id, t.selector, t.name
from {CRAWL} c join {TARGETS} t on t.url = c.url where t.enabled is distinct from false"""
SQL["upsert_targets"] = f"""with old as (select * from {TARGETS} t),
incoming as (
  select pos, url, selector, name, 'renewed' as notes, enabled from old where enabled is distinct from false
  union all
  select fetch_id + 1000000000, url, '.offer', null, 'from crawl', true from {CRAWL} c),
last as (select *, row_number() over (partition by url order by pos desc) as r from incoming),
firsts as (select url, min(pos) as p from old group by url),
placed as (select l.url, coalesce(f.p, (select max(pos) from old) + 1 + l.pos) as pos, l.selector,
    l.name, l.notes, l.enabled from last l left join firsts f on f.url = l.url where l.r = 1)
select url, pos, selector, name, notes, enabled from old o
where not exists (select 1 from placed p where p.url = o.url and p.pos = o.pos)
union all select url, pos, selector, name, notes, enabled from placed"""
DROPPED = f"(select distinct url from {CRAWL} c where status = 500)"
SQL["remove_targets"] = f"select * from {TARGETS} t where url not in (select url from {DROPPED})"
SQL["removal_report"] = f"""select d.url, count(t.url) as n_removed, count(t.url) > 0 as found
from {DROPPED} d left join {TARGETS} t on t.url = d.url group by d.url"""

# --- states ------------------------------------------------------------------------
def states(side: str) -> str:
    return f"""(select {S.hash16('url')} as url_key, url, {S.hash16("cast(to_json(promos) as varchar)")} as hash,
 promos, ts as last_seen from {D('snapshots_' + side)} s)"""


def promos_valid(col: str) -> str:
    return (f"coalesce(list_bool_and(list_transform({col}, lambda p: coalesce({S.trim('p.id')} <> '', false) "
            "and p.title is not null and p.perk is not null and p.dates is not null "
            "and p.price is not null)), true)")


STATE_OK = f"(hash <> '' and last_seen is not null and {promos_valid('promos')})"
STATE_VIEW = """select url_key, url, hash, cast(to_json(promos) as varchar) as promos,
 strftime(last_seen, '%Y-%m-%d %H:%M') as last_seen"""
SQL["state_lookup"] = f"""select c.url_key, c.url, c.hash, p.hash as previous_hash,
 cast(to_json(p.promos) as varchar) as previous_promos,
 strftime(p.last_seen, '%Y-%m-%d %H:%M') as previous_seen
from {states('curr')} c left join (select * from {states('prev')} where {STATE_OK}) p
on p.url_key = c.url_key"""
SQL["colocated_state"] = SQL["state_lookup"]
SQL["state_upsert"] = f"""with new as (select * replace (cast(cast(last_seen as date) + 1 as timestamp) as last_seen)
  from {states('curr')} where {STATE_OK})
{STATE_VIEW} from {states('prev')} s where url_key not in (select url_key from new)
union all {STATE_VIEW} from new"""
SQL["state_delete"] = f"""{STATE_VIEW} from {states('prev')} s
where url_key not in (select url_key from {states('curr')} c)"""


def ending(rows: str, *digits: int) -> str:
    """The states whose url ends with a digit that leaves one of these over 5."""
    return f"(select * from {rows} e where (ascii(right(url, 1)) - 48) % 5 in ({', '.join(map(str, digits))}))"


def upserted(old: str, new: str, gone: str) -> str:
    """``old`` without the keys of ``gone``, with ``new`` put in."""
    return f"""(select * from {old} o where url_key not in (select url_key from {new} n) and url_key not in (select url_key from {gone} g)
 union all select * from {new} n)"""


OLD, NEW = states("prev"), states("curr")
NOTHING = f"(select * from {NEW} where false)"
RUNS = [f"(select * from {OLD})"]
for new, gone in (
    (ending(NEW, 1), ending(OLD, 2)),
    (NOTHING, f"(select * from {ending(OLD, 3)} union all select * from {ending(NEW, 1)})"),
    (ending(NEW, 2), NOTHING),
    (ending(NEW, 3), ending(OLD, 3, 4)),
):
    RUNS.append(upserted(f"state_{len(RUNS)}", new, gone))
SQL["state_as_of"] = "with " + ", ".join(f"state_{i + 1} as {r}" for i, r in enumerate(RUNS)) + " " + " union all ".join(
    f"{STATE_VIEW.replace('select ', f'select {i + 1} as before_run, ', 1)} from state_{i + 1}" for i in range(len(RUNS)))
SQL["validate_promos"] = f"""select url, pos, p.id as id, coalesce({S.trim('p.id')} <> '', false) as valid
from (select url, unnest(promos) as p, generate_subscripts(promos, 1) - 1 as pos from {D('snapshots_prev')} s)"""
SQL["validate_states"] = f"select url_key, url, {STATE_OK} as valid from {states('prev')} s"
SQL["with_previous_state"] = f"""select c.url, p.url_key is null as first_run,
 case when p.url_key is null then 'Initial state captured' end as summary,
 coalesce(len(p.promos), 0) as n_previous, len(c.promos) as n_current
from {states('curr')} c left join (select * from {states('prev')} where {STATE_OK}) p
on p.url_key = c.url_key"""
SQL["hash_gated_update"] = f"""select c.url_key, c.url, c.hash
from {states('curr')} c left join (select * from {states('prev')} where {STATE_OK}) p
on p.url_key = c.url_key where p.hash is null or p.hash <> c.hash"""

# --- history -----------------------------------------------------------------------
HIST = f"(select url_key, ts, seq, hash from {HISTORY} h)"
SQL["history_scan"] = f"select * from {HIST} where url_key = 'user-8'"
SQL["history_append"] = f"""select url_key, ts, seq,
 case when hash = ' ' then hash else {S.hash16('hash')} end as hash
from (select *, row_number() over (partition by url_key, ts, hash = ' ' order by seq desc) r from {HIST}) h
where hash = ' ' or r = 1"""
SQL["validate_history"] = f"select seq, url_key, trim(hash) <> '' and seq % 7 <> 0 as valid from {HIST}"
RANKED = f"(select *, row_number() over (partition by url_key order by ts desc, seq desc) as rn from {HIST})"
SQL["latest_history"] = f"select url_key, ts, seq, hash, rn from {RANKED} where rn <= 5 and hash <> ' ' and seq % 7 <> 0"
SQL["prune_history"] = f"select url_key, ts, seq, hash from {RANKED} where rn <= 5"
SQL["pruned_rows"] = f"select url_key, ts, seq, hash from {RANKED} where rn > 5"
SQL["prune_counts"] = f"""select url_key, count(*) filter (rn <= 5) as n_kept,
 count(*) filter (rn > 5) as n_deleted from {RANKED} group by url_key"""
SQL["store_and_prune"] = f"""with new as (
  select url_key, ts + interval 40 day as ts, seq, hash from {HIST} where hash <> ' ')
select url_key, ts, seq, hash from (
  select *, row_number() over (partition by url_key order by ts desc, seq desc) as rn from (
    select * from {HIST} o where not exists (select 1 from new n where n.url_key = o.url_key and n.ts = o.ts)
    union all
    select url_key, ts, seq, hash from (
      select *, row_number() over (partition by url_key, ts order by seq desc) r from new) where r = 1))
where rn <= 5"""
CLEARED = f"(select url_key from {HIST} where hash = ' ' group by url_key having count(*) > 14)"
SQL["clear_history"] = f"select * from {HIST} where url_key not in (select url_key from {CLEARED})"
SQL["clear_counts"] = f"""select url_key, count(*) as n_deleted from {HIST}
where url_key in (select url_key from {CLEARED}) group by url_key"""

# --- text --------------------------------------------------------------------------
SQL["truncate_text"] = """select doc_id, case when length(text) > 10000
 then substr(text, 1, 10000) || '... [truncated]' else text end as text from documents"""
SQL["keep_columns"] = "select doc_id, lang, source from documents"
SQL["normalize_text"] = f"select doc_id, {S.normalize('text')} as normalized from (select doc_id, text from documents union all select doc_id, text from {D('noted_texts')} n)"
SQL["filter_noise"] = f"select doc_id, {S.noise('text')} as filtered from (select doc_id, text from documents union all select doc_id, text from {D('noted_texts')} n)"
SQL["content_hash"] = f"select doc_id, {S.hash16('text')} as hash from documents"
SQL["state_keys"] = f"select page_id, 'state:' || {S.hash16('url')} as state_key from pages"
SQL["history_keys"] = f"""select fetch_id,
 'hist:' || {S.hash16('url')} || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') as history_key from {CRAWL} c"""
SQL["promo_ids"] = f"select id, pos, {S.promo_id(*FIELDS)} as content_id from {CURR} c"
SQL["html_to_text"] = f"""select page_id, {S.to_text('html')} as text,
 {S.to_text('html', False)} as text_with_scripts from pages"""
SQL["decode_entities"] = f"""select page_id, {S.decode('t')} as text
from (select page_id, {S.to_text('html')} as t from (select page_id, html from pages union all select page_id, html from {D('marked_pages')} m))"""
SQL["escape_markup"] = f"select page_id, {S.escape('html', cut=False)} as escaped from (select page_id, html from pages union all select page_id, html from {D('marked_pages')} m)"
SQL["relative_age"] = f"""select event_id, iso, {S.age('iso', AS_OF)} as age from (
 select event_id, case when event_type = 'error' then 'at ' || props
   else strftime(ts, '%Y-%m-%dT%H:%M:%S') end as iso from events)"""

# --- similarity --------------------------------------------------------------------
PAIRS = S.with_clean(D("promo_pairs") + " p")


def similarity(a: str, b: str) -> str:
    longest = f"cast(greatest(length({a}), length({b})) as double)"
    return (f"round(case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 "
            f"else ({longest} - levenshtein({a}, {b})) / {longest} end, 9)")


SQL["text_similarity"] = f"""select id, pos, {similarity('a_title', 'b_title')} as sim_title,
 {similarity('a_perk', 'b_perk')} as sim_perk from {D('promo_pairs')} p"""
SQL["similar_text"] = "select id, pos, " + ", ".join(
    f"{S.text_rule(f)} as similar_{f}" for f in FIELDS) + f" from {PAIRS}"
ORDERS = f"""(select *, {", ".join(f"lower({S.clean(s + f)}) as l_{s}{f}" for s in ("a_", "b_") for f in ("dates", "price"))}
 from {D('order_pairs')} o)"""
SQL["similar_price"] = f"select id, {S.like_price('a_price', 'b_price', S.text_rule('price'))} as similar from {ORDERS}"
SQL["similar_dates"] = f"select id, {S.like_dates('a_dates', 'b_dates', S.text_rule('dates'))} as similar from {ORDERS}"
SQL["promo_equal"] = f"select id, pos, {S.equal_records('a_', 'b_')} as equal from {PAIRS}"
SQL["material_change"] = f"select id, pos, {S.material_edit()} as material from {PAIRS}"
SQL["material_promos"] = f"select url, id, pos, {S.material_promo('')} as material from {CURR} c"

# --- diff --------------------------------------------------------------------------
PREV_LAST = f"(select * from (select *, row_number() over (partition by url, id order by pos desc) r from {PREV} p) where r = 1)"
SQL["added_promos"] = f"""select * from {CURR} c
where not exists (select 1 from {PREV} p where p.url = c.url and p.id = c.id)"""
SQL["removed_promos"] = f"""select * from {PREV} p
where not exists (select 1 from {CURR} c where p.url = c.url and p.id = c.id)"""
MATCHED = S.with_clean(
    "(select c.url, c.id, c.pos, "
    + ", ".join(f"p.{f} as previous_{f}, c.{f} as current_{f}" for f in FIELDS)
    + f" from {CURR} c join {PREV_LAST} p on p.url = c.url and p.id = c.id)",
    ("previous_", "current_"),
)
SIDES = ", ".join(f"previous_{f}, current_{f}" for f in FIELDS)
SQL["changed_promos"] = f"""select url, id, pos, {SIDES} from {MATCHED}
where not {S.equal_records('previous_', 'current_')}"""
ALL_ROWS = f"""(select url, id, pos, case when {S.equal_records('previous_', 'current_')} then 'same'
   else 'changed' end as change_type, {SIDES}, {S.material_edit('previous_', 'current_')} as material from {MATCHED}
union all select url, id, pos, 'added', {", ".join(f"null, {f}" for f in FIELDS)}, {S.material_promo('')}
   from ({SQL['added_promos']})
union all select url, id, pos, 'removed', {", ".join(f"{f}, null" for f in FIELDS)}, {S.material_promo('')}
   from ({SQL['removed_promos']}))"""
SQL["detect_changes"] = f"select url, id, pos, change_type, {SIDES} from {ALL_ROWS} where change_type <> 'same'"
SQL["change_union"] = SQL["detect_changes"]


def counts(extra: str = "") -> str:
    return ("(select url, " + ", ".join(
        f"count(*) filter (change_type = '{k}' {extra}) as n_{k}" for k in ("added", "changed", "removed")
    ) + f" from {ALL_ROWS} group by url)")


ANY = "n_added + n_changed + n_removed > 0 as has_changes"
SQL["change_counts"] = f"select *, {ANY} from {counts()}"
SQL["change_summary"] = f"select url, {S.change_sentence('No changes detected')} as summary from {counts()}"
MATERIAL = f"""select *, {ANY}, {S.change_sentence('No material changes detected')} as summary
from {counts('and material')}"""
SQL["material_changes"] = MATERIAL
TOP3 = f"""(select *, row_number() over (partition by url order by section, pos, id) as item_no from (
 select *, case change_type when 'added' then 0 when 'changed' then 1 else 2 end as section
 from {ALL_ROWS} where change_type <> 'same' and material))"""
SQL["digest_top3"] = f"select url, item_no, change_type, id, pos from {TOP3} where item_no <= 3"

# --- run reports -------------------------------------------------------------------
STATS = f"""select count(*) as total, count(*) filter (success) as successful,
 count(*) filter (not success) as failed, count(*) filter (success and has_changes) as with_changes,
 count(*) filter (notified) as notified from {RESULTS} r"""
SQL["run_stats"] = STATS
SQL["run_summary"] = f"""select {S.plural('total', ' target processed', ' targets processed')}
 || case when successful > 0 then ', ' || cast(successful as varchar) || ' successful' else '' end
 || case when failed > 0 then ', ' || cast(failed as varchar) || ' failed' else '' end
 || case when with_changes > 0 then ', ' || cast(with_changes as varchar) || ' with changes' else '' end
 || case when notified > 0 then ', ' || {S.plural('notified', ' notification sent', ' notifications sent')} else '' end
 as summary from ({STATS})"""
SQL["run_report"] = f"""select case when coalesce(name, '') = '' then 'Unnamed Target' else name end as name, url,
 case when success then 'success' else 'failed' end as status,
 case when success and has_changes then 'Changes detected: ' || summary when success then 'No changes detected'
   when coalesce(error, '') = '' then 'Processing failed' else error end as message from {RESULTS} r"""
SQL["duration_stats"] = """select event_type, count(value) as n, round(avg(value), 6) as avg,
 min(value) as min, max(value) as max from events group by event_type"""

# --- extraction --------------------------------------------------------------------
def open_tag(classes) -> str:
    return r'(?is)<[A-Za-z][^>]*class="[^"]*\b(?:' + "|".join(classes) + r')\b[^"]*"[^>]*>'


def lazy_blocks(source: str, classes) -> str:
    found = S.every("html", open_tag(classes) + r"(.*?)</[^>]*>", 1)
    return f"""(select page_id, url, unnest(l) as block, generate_subscripts(l, 1) - 1 as pos
 from (select page_id, url, {found} as l from {source}))"""


def balanced_blocks(source: str, classes) -> str:
    pieces = f"string_split_regex(html, {S.rx(open_tag(classes))})"
    return f"""(select page_id, url, block, pos - 1 as pos from (select page_id, url, unnest(l) as block,
 generate_subscripts(l, 1) - 1 as pos from (select page_id, url, {pieces} as l from {source})) where pos > 0)"""


def field(block: str, patterns) -> str:
    out = "''"
    for p in reversed(patterns):
        text = S.trim(S.sub(S.one(block, p, 1), P.TAG))
        out = f"case when {S.has(block, p)} then {text} else {out} end"
    return out


FIELD_PATTERNS = {
    "title": [P.TITLE_HEADING, P.class_element(P.FIELD_CLASSES["title"])],
    "perk": [P.class_element(P.FIELD_CLASSES["perk"]), P.PERK_PARAGRAPH],
    "dates": [P.class_element(P.FIELD_CLASSES["dates"])],
    "price": [P.class_element(P.FIELD_CLASSES["price"])],
}


def fields(blocks: str) -> str:
    cols = ", ".join(f"{field('block', FIELD_PATTERNS[f])} as {f}" for f in FIELDS)
    return f"(select *, {cols} from {blocks} b)"


def from_text(source: str, text: str) -> str:
    """Adds t_title, t_perk, t_dates, t_price (null when the text is too short)."""
    return f"""(select *, case when ok then lines[1] end as t_title,
  case when ok then case when k = '' and d = '' and p = '' then array_to_string(lines[2:], ' ') else k end end as t_perk,
  case when ok then d end as t_dates, case when ok then p end as t_price
 from (select *, length({S.trim('norm')}) > 10 as ok,
   list_filter(list_transform(string_split(norm, chr(10)), lambda l: {S.trim('l')}), lambda l: l <> '') as lines,
   {S.one('norm', P.BLOCK_PERK)} as k, {S.one('norm', P.BLOCK_DATES)} as d, {S.one('norm', P.BLOCK_PRICE)} as p
  from (select *, {S.normalize(text)} as norm from {source})))"""


def promos(blocks: str) -> str:
    """Records (page_id, url, pos, id and the four fields) of container blocks."""
    plain = S.trim(S.collapse(S.sub("block", P.TAG, " ")))
    base = f"(select *, {plain} as plain from {fields(blocks)} where {S.trim('block')} <> '')"
    norm = ", ".join(
        f"case when none then t_{f} else {S.normalize('titled' if f == 'title' else f)} end as n_{f}"
        for f in FIELDS)
    return f"""(select page_id, url, pos, {S.promo_id(*['n_' + f for f in FIELDS])} as id,
  {", ".join(f"n_{f} as {f}" for f in FIELDS)}
 from (select page_id, url, pos, none, titled, {norm}, raw_perk
  from (select *, title = '' and perk = '' and dates = '' and price = '' as none, perk as raw_perk,
     case when title = '' then plain else title end as titled from {from_text(base, 'plain')}))
 where case when none then n_title is not null else titled <> '' or raw_perk <> '' end)"""


TEXTS = f"(select doc_id, text from documents union all select doc_id, text from {D('noted_texts')} n)"
SQL["container_explode"] = f"select page_id, pos, block from {lazy_blocks('pages', ['ad'])}"

# Elements by selectors with steps: the tags of a page are walked one by one, all pages at a time.  A step is
# what joins it to the one before (',', ' ' or '>') and what its tag must fulfil.
VOID = ("script", "style", "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
NEXT_ENDS = ("li", "p", "td", "th", "tr", "dt", "dd", "option")
ATTRIBUTES = """(?:"[^"]*"|'[^']*'|[^'">])*"""
TAGS = lit(
    r"(?is)<!--.*?(?:-->|\z)|<![^>]*>|<script(?:[\s/]" + ATTRIBUTES + r")?>.*?(?:</script\s*>|\z)|<style(?:[\s/]"
    + ATTRIBUTES + r")?>.*?(?:</style\s*>|\z)|</[a-z][a-z0-9:-]*\s*>|<[a-z][a-z0-9:-]*(?:[\s/]" + ATTRIBUTES + ")?>")
ATTRIBUTE = lit(r"""[\s/]([A-Za-z0-9_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def has_class(name: str) -> str:
    return f"list_contains(string_split_regex(coalesce(given['class'], ''), '\\s+'), '{name}')"


PROMO, DEALS, ANY_DIV = has_class("promo"), has_class("deals"), "name = 'div'"
PAGE_STEPS = {
    "nav > ul > li a": [(",", "name = 'nav'"), (">", "name = 'ul'"), (">", "name = 'li'"), (" ", "name = 'a'")],
    "article > p": [(",", "name = 'article'"), (">", "name = 'p'")],
    "b p": [(",", "name = 'b'"), (" ", "name = 'p'")],
    ".ad": [(",", has_class("ad"))],
    'a[href^="/the"]': [(",", "name = 'a' and lower(given['href']) like '/the%'")],
}
NESTED_STEPS = {
    ".promo": [(",", PROMO)],
    "div.deals > .promo": [(",", f"{ANY_DIV} and {DEALS}"), (">", PROMO)],
    ".deals .promo": [(",", DEALS), (" ", PROMO)],
    "ul > li.promo, section .promo": [(",", "name = 'ul'"), (">", f"name = 'li' and {PROMO}"), (",", "name = 'section'"), (" ", PROMO)],
    '[data-kind="plain"]': [(",", "given['data-kind'] = 'plain'")],
    'a[href$=".html"]': [(",", "name = 'a' and given['href'] like '%.html'")],
    "div div div": [(",", ANY_DIV), (" ", ANY_DIV), (" ", ANY_DIV)],
    "b": [(",", "name = 'b'")],
    "#top > .wrap > *": [(",", "given['id'] = 'top'"), (">", has_class("wrap")), (">", "true")],
    ".promo .perk": [(",", PROMO), (" ", has_class("perk"))],
    "[class~=late], [alt*='promo']": [(",", has_class("late")), (",", "given['alt'] like '%promo%'")],
    "div.deals": [(",", f"{ANY_DIV} and {DEALS}")],
}


def elements(pages: str, steps: dict[str, list[tuple[str, str]]]) -> str:
    """page_id, selector, pos and block of the elements of (page_id, html)."""
    plans, own = [], []
    for selector, path in steps.items():
        bits = [sum(1 << i for i, (join, _) in enumerate(path) if join == sign) for sign in (",", ">", " ")]
        last = sum(1 << i for i in range(len(path)) if i + 1 == len(path) or path[i + 1][0] == ",")
        plans.append(f"({lit(selector)}, {', '.join(map(str, [*bits, last]))})")
        fits = " + ".join(f"case when {test} then {1 << i} else 0 end" for i, (_, test) in enumerate(path))
        own.append(f"when {lit(selector)} then {fits}")
    void, ends = (", ".join(map(lit, names)) for names in (VOID, NEXT_ENDS))
    return f"""(with recursive
 pages_ as (select page_id, html from {pages} p),
 plans(selector, first, child, below, last) as (values {", ".join(plans)}),
 split as (select page_id, unnest(regexp_extract_all(html, {TAGS})) as tag, unnest(list_slice(gaps, 1, -2)) as gap,
   generate_subscripts(list_slice(gaps, 1, -2), 1) as i from (select *, string_split_regex(html, {TAGS}) as gaps from pages_)),
 placed as (select *, sum(length(gap) + length(tag)) over (partition by page_id order by i) as hi,
   lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) as name, regexp_extract_all(tag, {ATTRIBUTE}, 1) as names,
   regexp_extract_all(tag, {ATTRIBUTE}, 2) as vals from split),
 read as (select page_id, i, hi, hi - length(tag) as lo, name,
   case when name = '' then 'none' when tag like '</%' then 'close' when name in ({void}) or tag like '%/>' then 'void' else 'open' end as kind,
   map_from_entries(list_distinct(list_transform(names, lambda n, j: struct_pack(k := lower(n), v :=
     regexp_replace(coalesce(vals[j], ''), '^["'']|["'']$', '', 'g'))))) as given from placed),
 tokens as (select r.*, p.*, case p.selector {" ".join(own)} end as own from read r cross join plans p),
 walk as (
  select page_id, selector, 0::bigint as i, []::struct(name varchar, path bigint, above bigint, f bigint, hit boolean)[] as open,
   []::struct(f bigint, u bigint)[] as spans from pages_ cross join plans
  union all
  select page_id, selector, i, case when kind = 'open' then list_append(kept, struct_pack(name := name, path := m,
      above := coalesce(kept[-1].above, 0) | m, f := hi, hit := m & last <> 0)) else kept end,
   list_concat(list_transform(list_filter(open[len(kept) + 1:], lambda e: e.hit), lambda e: struct_pack(f := e.f, u := lo)),
     case when kind = 'void' and m & last <> 0 then [struct_pack(f := hi, u := hi)] else [] end)
  from (select *, own & (first | ((coalesce(kept[-1].path, 0) << 1) & child) | ((coalesce(kept[-1].above, 0) << 1) & below)) as m
   from (select t.*, w.open, case
      when t.kind = 'close' and list_contains(list_transform(w.open, lambda e: e.name), t.name) then
        w.open[:len(w.open) - list_position(list_reverse(list_transform(w.open, lambda e: e.name)), t.name)]
      when t.kind = 'open' and t.name in ({ends}) and w.open[-1].name = t.name then w.open[:len(w.open) - 1]
      else w.open end as kept
     from walk w join tokens t on t.page_id = w.page_id and t.selector = w.selector and t.i = w.i + 1))),
 found as (
  select page_id, selector, unnest(spans, recursive := true) from walk where len(spans) > 0
  union all
  select w.page_id, w.selector, e.f, length(p.html) from
   (select page_id, selector, unnest(max_by(open, i)) as e from walk group by page_id, selector) w join pages_ p using (page_id)
  where e.hit)
 select page_id, selector, row_number() over (partition by page_id, selector order by f, u) - 1 as pos,
  substr(html, f + 1, u - f) as block from found join pages_ using (page_id))"""


SQL["selector_tree"] = f"""select * from {elements('pages', PAGE_STEPS)} a
union all select * from {elements(D('nested_pages'), NESTED_STEPS)} b"""
BOXED = f"""(select e.page_id, n.url, e.pos, e.block from {elements(D('nested_pages'), {k: NESTED_STEPS[k] for k in ['div.deals > .promo']})} e
 join {D('nested_pages')} n using (page_id))"""
SQL["selector_promos"] = f"select url, pos, id, title, perk, dates, price from {promos(BOXED)}"
SQL["promo_fields"] = f"select page_id, pos, title, perk, dates, price from {fields(balanced_blocks(OFFERS, CLASSES))}"
SQL["build_promos"] = f"select page_id, pos, id, title, perk, dates, price from {promos(balanced_blocks(OFFERS, CLASSES))}"
SQL["promos_from_text"] = f"""select doc_id, {S.promo_id('t_title', 't_perk', 't_dates', 't_price')} as id,
 t_title as title, t_perk as perk, t_dates as dates, t_price as price
from {from_text(TEXTS, 'text')} where ok"""
LAZY_OFFERS = promos(lazy_blocks(OFFERS, CLASSES))
SQL["page_promos"] = f"""select url, pos, id, title, perk, dates, price from {promos(lazy_blocks('pages', ['ad']))}
union all select url, pos, id, title, perk, dates, price from {LAZY_OFFERS}"""
LAST_BLOCK = f"""(select * from (select *, max(pos) over (partition by page_id) as top
 from {lazy_blocks(OFFERS, CLASSES)}) where pos = top)"""
SQL["streaming_selector_extract"] = f"select page_id, id, title, perk, dates, price from {promos(LAST_BLOCK)}"
SQL["page_content_hash"] = f"""select o.page_id, {S.hash16("coalesce(j, '[]')")} as hash
from {OFFERS} o left join (select page_id, '[' || string_agg(cast(to_json(struct_pack(id := id, title := title,
  perk := perk, dates := dates, price := price)) as varchar), ',' order by pos) || ']' as j
 from {LAZY_OFFERS} group by page_id) p on p.page_id = o.page_id"""
COUNTED = (*P.SUMMARY_CLASSES, "ad")
BOTH = f"(select page_id, url, html from pages union all select page_id, url, html from {OFFERS} o)"
SQL["promos_per_page"] = f"""select b.url, coalesce(n, 0) as n_promos from {BOTH} b
left join (select url, count(*) as n from {promos(lazy_blocks(BOTH, COUNTED))} group by url) p on p.url = b.url"""

# --- page head and mentions ----------------------------------------------------------
def title_of(html: str) -> str:
    text = S.trim(S.sub(S.one(html, P.PAGE_TITLE, 1), P.TAG))
    return f"case when {S.has(html, P.PAGE_TITLE)} then {text} else 'No title found' end"


def meta_of(html: str) -> str:
    return f"case when {S.has(html, P.PAGE_META)} then {S.trim(S.one(html, P.PAGE_META, 1))} end"


SQL["page_titles"] = f"select page_id, {title_of('html')} as title from pages"
SQL["page_meta"] = f"select page_id, {meta_of('html')} as meta_description from {OFFERS} o"
SQL["page_kind"] = """select page_id, case when contains(html, '.example.com') then 'Example Page'
 else 'Web Page' end as kind, length(html) as content_length from pages"""


def dates_of(source: str, key: str, cap: int = 10**9) -> str:
    return f"""(select {key}, pos, 'Date: ' || {S.collapse(S.trim('m'))} as mention from (
 select {key}, unnest(l) as m, generate_subscripts(l, 1) - 1 as pos from (
  select {key}, {S.every('html', P.DATE_MENTION)} as l from {source})) where pos < {cap})"""


def numbered(inner: str, key: str, order: str, cap: int = 10**9) -> str:
    return f"""(select * exclude (r), r - 1 as pos from (
 select *, row_number() over (partition by {key} order by {order}) as r from ({inner})) where r <= {cap})"""


def prices_of(source: str, key: str, cap: int = 10**9) -> str:
    words = "string_split({}, ' ')"
    b, a = words.format("b"), words.format("a")
    leads = " or ".join(f"contains(b, '{w}')" for w in P.PRICE_BEFORE_WORDS)
    follows = " or ".join(f"contains(a, '{w}')" for w in P.PRICE_AFTER_WORDS)
    context = f"""case when length(b) > 5 and ({leads}) then array_to_string({b}[-3:], ' ') || ' ' || p
   when length(a) > 5 and ({follows}) then p || ' ' || array_to_string({a}[1:3], ' ') else 'Price: ' || p end"""
    inner = f"""select {key}, i, mention from (select {key}, i, {S.trim(S.collapse(context))} as mention from (
  select {key}, i, {S.trim('x')} as b, p, {S.trim('y')} as a from (
   select {key}, unnest(l1) as x, unnest(l2) as p, unnest(l3) as y, generate_subscripts(l1, 1) as i from (
    select {key}, {S.every('t', P.PRICE_MENTION, 1)} as l1, {S.every('t', P.PRICE_MENTION, 2)} as l2,
      {S.every('t', P.PRICE_MENTION, 3)} as l3
    from (select {key}, {S.to_text('html', False)} as t from {source}))))) where length(mention) between 11 and 79"""
    return f"(select {key}, pos, mention from {numbered(inner, key, 'i', cap)})"


def places_of(source: str, key: str, cap: int = 10**9) -> str:
    each = " union all ".join(
        f"select {key}, {n} as pl, unnest(l) as m, generate_subscripts(l, 1) as i from (select {key}, "
        + S.every("t", r"(?i)([^.!?]{20,80}" + place + r"[^.!?]{0,40})", 1) + " as l from texts)"
        for n, place in enumerate(P.PLACES))
    inner = f"""with texts as (select {key}, {S.to_text('html', False)} as t from {source})
select {key}, pl, i, 'Location: ' || d as mention from (select {key}, pl, i, {S.collapse(S.trim('m'))} as d
 from ({each})) where length(d) between 26 and 99"""
    return f"(select {key}, pos, mention from {numbered(inner, key, 'pl, i', cap)})"


SQL["date_mentions"] = f"select * from {dates_of(OFFERS, 'page_id')}"
SQL["price_mentions"] = f"select * from {prices_of(OFFERS, 'page_id')}"
SQL["location_mentions"] = f"select * from {places_of(OFFERS, 'page_id')}"

# --- deals ---------------------------------------------------------------------------
DEAL_COLS = "title, description, price, savings, location, dates"


def texts_of(source: str, key: str) -> str:
    return f"(select {key}, {S.to_text('html')} as t from {source})"


def hotel_rows(source: str, key: str) -> str:
    each = " union all ".join(
        f"select {key}, t, {n} as kind, unnest(l0) as m, unnest(l1) as g1, unnest(l2) as price, "
        f"generate_subscripts(l0, 1) as i from (select {key}, t, {S.every('t', p, 0)} as l0, "
        f"{S.every('t', p, 1)} as l1, {S.every('t', p, 2)} as l2 from {texts_of(source, key)})"
        for n, p in enumerate((P.HOTEL_DEAL, P.PLACE_DEAL)))
    breaks = "".join(
        f" when length({S.trim(S.one('c', p, 1))}) >= 15 then {S.trim(S.one('c', p, 1))}" for p in P.TITLE_BREAKS)
    head = S.one("b", r"\A(" + P.LINE_REST + r"{1,60}) ", 1)
    cut = f"""case when {head} = '' or (length({head}) = 60 and not contains({head}, ' ')) then substr(b, 1, 50) else {head} end"""
    place = f"""coalesce(nullif({S.trim(S.one('d', P.DEAL_PLACE, 1))}, ''),
   nullif({S.trim(S.one('d', P.DEAL_PLACE_LABEL, 1))}, ''), nullif({S.trim(S.one('d', P.DEAL_PLACE_AFTER, 1))}, ''))"""
    return f"""(select {key}, kind, i, case when b = c and length(b) > 60 then {cut} else b end as title, c as description,
  price, nullif({S.one('near', P.NEAR_SAVINGS)}, '') as savings,
  case lower(pl) when 'hawaii island' then 'Hawaii Island' when 'los cabos' then 'Los Cabos' else pl end as location,
  nullif({S.trim(S.one('near', P.NEAR_DATES))}, '') as dates
 from (select *, case {breaks} else c end as b, {place} as pl from (
  select *, {S.decode('d')} as c, substr(t, greatest(strpos(t, m) - 100, 1),
    strpos(t, m) + 200 - greatest(strpos(t, m) - 100, 1)) as near
  from (select *, {S.trim('g1')} as d from ({each}))) where length(d) between 16 and 349))"""


def short(col: str, n: int) -> str:
    return f"{S.trim(f'substr({col}, 1, {n})')} || case when length({col}) > {n} then '...' else '' end"


def package_rows(source: str, key: str) -> str:
    return f"""(select {key}, 2 as kind, i, {short('d', 60)} as title, d as description, price, null as savings,
 null as location, null as dates from (select {key}, {S.trim('g1')} as d, price, i from (
  select {key}, unnest(l1) as g1, unnest(l2) as price, generate_subscripts(l1, 1) as i from (
   select {key}, {S.every('t', P.PACKAGE_DEAL, 1)} as l1, {S.every('t', P.PACKAGE_DEAL, 2)} as l2
   from {texts_of(source, key)}))) where length(d) between 21 and 149)"""


def savings_rows(source: str, key: str) -> str:
    return f"""(select {key}, 3 as kind, i, {short('d', 50)} as title, d as description, null as price,
 'Save ' || coalesce(g2, '') || g3 as savings, null as location, null as dates
 from (select {key}, {S.trim('g1')} as d, g2, g3, i from (
  select {key}, unnest(l1) as g1, unnest(l2) as g2, unnest(l3) as g3, generate_subscripts(l1, 1) as i from (
   select {key}, {S.every('t', P.SAVINGS_DEAL, 1)} as l1, {S.every('t', P.SAVINGS_DEAL, 2)} as l2,
    {S.every('t', P.SAVINGS_DEAL, 3)} as l3
   from {texts_of(source, key)}))) where length(d) between 16 and 119)"""


def credit_rows(source: str, key: str) -> str:
    def named(p: str) -> str:
        return f"case when {S.has('c', p)} then {S.trim(S.one('c', p, 1))} else substr(c, 1, 60) end"

    title = f"""case when contains(c, 'resort credit') then {named(P.CREDIT_TITLE)}
   when contains(c, 'waived') and contains(c, 'resort fee') then {named(P.WAIVER_TITLE)}
   when contains(c, 'included extras') then {named(P.EXTRAS_TITLE)} else substr(c, 1, 60) end"""
    tidy = S.trim(S.collapse("replace(replace(d, '&diams;', '♦'), '&bull;', '•')"))
    return f"""(select {key}, 4 as kind, i, case when length(n) > 60 then substr(n, 1, 60) || '...' else n end as title,
 c as description, nullif({S.one('c', P.CREDIT_PRICE)}, '') as price,
 nullif({S.one('c', P.CREDIT_SAVINGS)}, '') as savings, null as location, null as dates
 from (select *, {title} as n from (select {key}, i, {tidy} as c from (
  select {key}, i, {S.trim('g1')} as d from (
   select {key}, unnest(l1) as g1, generate_subscripts(l1, 1) as i from (
    select {key}, {S.every('t', P.CREDIT_DEAL, 1)} as l1 from {texts_of(source, key)})))
  where length(d) between 21 and 299)))"""


def deal_list(*rows: str, key: str = "page_id", cap: int = 10**9) -> str:
    inner = " union all ".join(f"select {key}, kind, i, {DEAL_COLS} from {r}" for r in rows)
    return f"(select {key}, pos, {DEAL_COLS} from {numbered(inner, key, 'kind, i', cap)})"


def generic(source: str, key: str, cap: int = 10**9) -> str:
    return deal_list(hotel_rows(source, key), package_rows(source, key), savings_rows(source, key),
                     credit_rows(source, key), key=key, cap=cap)


SQL["hotel_deals"] = f"select * from {deal_list(hotel_rows(OFFERS, 'page_id'))}"
SQL["package_deals"] = f"select * from {deal_list(package_rows(OFFERS, 'page_id'))}"
SQL["savings_deals"] = f"select * from {deal_list(savings_rows(OFFERS, 'page_id'))}"
SQL["credit_deals"] = f"select * from {deal_list(credit_rows(OFFERS, 'page_id'))}"
SQL["generic_deals"] = f"select * from {generic(OFFERS, 'page_id')}"


def const(v) -> str:
    return "null" if v is None else lit(v) if isinstance(v, str) else str(v)


RULE_COLS = ("url_contains", "pattern", "title", "price", "savings", "location", "ord")
FIXED_RULES = "(select * from (values " + ", ".join(
    "(" + ", ".join(const(v) for v in (r["url_contains"], P.re2_regex(r["pattern"]), r["title"], r["price"],
                                       r["savings"], r["location"], n - len(P.SITE_RULES))) + ")"
    for n, r in enumerate(P.SITE_RULES)) + f") v({', '.join(RULE_COLS)}))"
TABLE_RULES = f"(select * from {FIXED_RULES} f union all by name select * from {D('site_rules')} s)"


def all_deals(source: str, key: str, rules: str = FIXED_RULES, cap: int = 10**9) -> str:
    """Deals by the rules of a page's first rule code, the generic ones without any."""
    page = S.sub(S.sub(S.sub("html", P.SCRIPT_BLOCK), P.STYLE_BLOCK), P.TAG, " ")
    page = S.collapse(f"replace(replace(replace({page}, '&diams;', '♦'), '&bull;', '•'), '&nbsp;', ' ')")
    coded = f"""(select p.{key}, p.url, min(r.ord) as top from {source} p join {rules} r
  on contains(p.url, r.url_contains) group by all)"""
    ruled = f"""(select {key}, 5 as kind, ord as i, title, {S.collapse(S.trim('m'))} as description, price, savings,
  location, null as dates from (select c.{key}, r.*, regexp_extract(p.t, r.pattern) as m
   from {coded} c join {rules} f on f.ord = c.top join {rules} r on r.url_contains = f.url_contains
   join (select {key}, {page} as t from {source}) p on p.{key} = c.{key}) where m <> '')"""
    other = f"(select * from {source} where {key} not in (select {key} from {coded}))"
    return f"""(select {key}, pos, {DEAL_COLS} from {generic(other, key, cap)}
 union all select {key}, pos, {DEAL_COLS} from {deal_list(ruled, key=key)})"""


SQL["rule_deals"] = f"select * from {all_deals(OFFERS, 'page_id', TABLE_RULES)}"


SQL["rule_index"] = f"""with urls as (select distinct url from (select url from pages union all select url from {OFFERS} o)),
 r as (select * from {D('part_rules')} p),
 first as (select url, arg_min(url_contains, (ord, url_contains)) as code from urls join r on contains(url, url_contains) group by url)
select url, code, count(*) as n_rules, string_agg(title, ' | ' order by ord, title) as titles
from first join r on url_contains = code group by url, code"""


def listed_by(rows: str, key: str, name: str, value: str) -> str:
    return f"""(select {key}, list({value} order by pos) as {name} from {rows} group by {key})"""


def summary(prices: int = 10**9, dates: int = 10**9, places: int = 10**9, deals: int = 10**9) -> str:
    return f"""(with both_pages as (select url, html, page_id from {BOTH}),
 pr as {listed_by(prices_of('both_pages', 'url', prices), 'url', 'l', 'mention')},
 da as {listed_by(dates_of('both_pages', 'url', dates), 'url', 'l', 'mention')},
 pl as {listed_by(places_of('both_pages', 'url', places), 'url', 'l', 'mention')},
 de as (select url, list(struct_pack(title := title, description := description, price := price,
    savings := savings, location := location, dates := dates) order by pos) as l
   from {all_deals('(select url, html, url as u from both_pages)', 'url', cap=deals)} group by url),
 np as (select url, count(*) as n from {promos(lazy_blocks('both_pages', P.SUMMARY_CLASSES))} group by url)
 select b.url, {title_of('html')} as title, {meta_of('html')} as meta_description,
  case when contains(html, 'travel.example.com') then 'Travel Page' else 'Web Page' end as kind,
  length(html) as content_length, coalesce(np.n, 0) as n_promos,
  list_concat(list_concat(coalesce(pr.l, []), coalesce(da.l, [])), coalesce(pl.l, [])) as key_elements,
  coalesce(de.l, []) as deals
 from both_pages b left join pr on pr.url = b.url left join da on da.url = b.url left join pl on pl.url = b.url
 left join de on de.url = b.url left join np on np.url = b.url)"""


SQL["page_summary"] = f"""select url, title, meta_description, kind, content_length, n_promos,
 array_to_string(key_elements, ' | ') as key_elements,
 array_to_string(list_transform(deals, lambda d: d.title), ' | ') as deals from {summary()}"""


SQL["page_caps"] = f"""select page_id, 'price' as kind, pos, mention as text from {prices_of(OFFERS, 'page_id', 5)}
union all select page_id, 'date', pos, mention from {dates_of(OFFERS, 'page_id', 2)}
union all select page_id, 'place', pos, mention from {places_of(OFFERS, 'page_id', 5)}
union all select page_id, 'deal', pos, title from {generic(OFFERS, 'page_id', 8)}"""

# --- digests -------------------------------------------------------------------------
def record_lines(prefix: str) -> str:
    def line(f: str, mark: str, wrap: str = "") -> str:
        col = prefix + f
        return (f"case when coalesce({col}, '') <> '' then {lit(mark + wrap)} || {S.escape(col)} "
                f"|| {lit(wrap)} end")

    return ("concat_ws(chr(10), " + ", ".join(
        [line("title", "", "*"), line("perk", ""), line("price", "💰 "), line("dates", "📅 ")]) + ")")


def change_lines() -> str:
    out = []
    for f, mark, wrap in (("title", "", "*"), ("perk", "", ""), ("price", "💰 ", ""), ("dates", "📅 ", "")):
        new, old = f"current_{f}", f"previous_{f}"
        out.append(f"case when {new} <> '' then {lit(mark + wrap)} || {S.escape(new)} || {lit(wrap)} end")
        out.append(f"case when {old} <> '' and {old} <> {new} then {lit(mark + '~')} || {S.escape(old)} || '~' end")
    return "concat_ws(chr(10), " + ", ".join(out) + ")"


ITEM = f"""case change_type when 'added' then {record_lines('current_')}
 when 'removed' then {record_lines('previous_')} else {change_lines()} end"""
SECTION_ROWS = " union all ".join(
    f"""select url, {10 * (n + 1)} as block_no, 'section' as block_type,
 '*{title} Promotions (' || cast(n_{k} as varchar) || '):*' as text from src where s{n} > 0
union all select url, {10 * (n + 1) + 9}, 'context',
 '_... and ' || cast(n_{k} - s{n} as varchar) || ' more {word} promotions_' from src where s{n} > 0 and n_{k} > s{n}"""
    for n, (k, title, word) in enumerate(
        (("added", "🆕 New", "new"), ("changed", "🔄 Updated", "updated"), ("removed", "❌ Removed", "removed"))))
CHANGE_DIGEST = f"""with src as (select *, least(n_added, 3) as s0, least(n_changed, 3 - least(n_added, 3)) as s1,
  least(n_removed, 3 - least(n_added, 3) - least(n_changed, 3 - least(n_added, 3))) as s2
  from ({MATERIAL}) where has_changes),
blocks as (
 select url, 0 as block_no, 'header' as block_type,
   '🎯 ' || case when n_changed > 3 then url else 'Watched page' end as text from src
 union all select url, 1, 'context', '<' || url || '|View Page> • 2 days ago' from src
 union all select url, 2, 'section', '*Changes detected:* ' || summary from src
 union all select url, 3, 'divider', null from src
 union all {SECTION_ROWS}
 union all select url, 10 * (section + 1) + item_no, 'section', {ITEM} from {TOP3} where item_no <= 3)"""
SQL["change_digest"] = f"{CHANGE_DIGEST} select url, cast(block_no as bigint) as block_no, block_type, text from blocks"
SQL["digest_sink"] = f"""{CHANGE_DIGEST} select url, '[' || string_agg('{{"block_no":' || cast(block_no as varchar)
 || ',"block_type":' || cast(to_json(block_type) as varchar)
 || case when text is null then '' else ',"text":' || cast(to_json(text) as varchar) end || '}}', ',' order by block_no)
 || ']' as message from blocks group by url"""
DEAL_TEXT = f"""concat_ws(chr(10), '*' || {S.escape('d.title')} || '*',
 nullif(concat_ws(' • ', '💰 ' || nullif(d.price, ''), '💸 ' || nullif(d.savings, '')), ''),
 case when coalesce(d.location, '') <> '' then '📍 ' || {S.escape('d.location')} end,
 case when coalesce(d.dates, '') <> '' then '📅 ' || {S.escape('d.dates')} end,
 case when d.description <> '' and d.description <> d.title then '_' || {S.escape("case when length(d.description) > 100 then substr(d.description, 1, 100) || '...' else d.description end")} || '_' end)"""
SQL["summary_digest"] = f"""with s as (select * from {summary(3, 2, 2, 8)})
select url, 0::bigint as block_no, 'header' as block_type, 'Page summary' as text from s
union all select url, 1, 'context', '<' || url || '|View Page> • Jan 2, 3:04 PM • Fetch: 120ms' from s
union all select url, 2, 'section', '*Page Summary:*' || chr(10) || '*Title:* ' || {S.escape('title')} || chr(10)
 || '*Type:* ' || kind || chr(10) || '*Content:* ' || cast(cast(floor(content_length / 1024 + 0.5) as bigint) as varchar)
 || 'KB' || chr(10) || '*Promotions:* ' || cast(n_promos as varchar) || ' found' from s
union all select url, 3, 'section', '*Description:* ' || {S.escape('meta_description')} from s where meta_description <> ''
union all select url, 4, 'divider', null from s where len(deals) > 0
union all select url, 5, 'section', '*🎯 Deals Found (' || cast(len(deals) as varchar) || '):*' from s where len(deals) > 0
union all select url, 5 + i, 'section', {DEAL_TEXT} from (
  select url, unnest(deals) as d, generate_subscripts(deals, 1) as i from s) where i <= 4
union all select url, 10, 'context', '_... and ' || cast(len(deals) - 4 as varchar) || ' more deals found on the page_'
 from s where len(deals) > 4
union all select url, 11, 'divider', null from s where len(deals) = 0 and len(key_elements) > 0
union all select url, 12, 'section', '*Key Elements Found:*' || chr(10)
 || array_to_string(list_transform(key_elements, lambda k: '• ' || {S.escape('k')}), chr(10))
 from s where len(deals) = 0 and len(key_elements) > 0
union all select url, 13, 'context',
 'End of the summary' from s"""

# --- quota and chunks ------------------------------------------------------------------
SQL["window_quota"] = f"""select user_id, bucket, event_id, ts,
 row_number() over (partition by user_id, bucket order by ts, event_id) <= 2 as allowed
from (select *, cast(floor(epoch_ms(ts) / 3600000) as bigint) as bucket from {D('requests')} r)"""
SQL["map_chunks"] = """select doc_id, len(regexp_extract_all(text, '[^ ]+')) as n_words from documents"""

# --- runs and streams ------------------------------------------------------------------
def listed(side: str, valid: str, curr: str, prev: str) -> str:
    """Records of the pages that are diffed, one row each."""
    touched = f"""(select c.url, c.promos as cur, p.promos as old from
 (select * from {curr} where {STATE_OK}) c
 join (select * from {prev} where {valid}) p on p.url_key = c.url_key where p.hash <> c.hash)"""
    return f"""(select url, pos, p.id as id, p.title as title, p.perk as perk, p.dates as dates, p.price as price
 from (select url, unnest({side}) as p, generate_subscripts({side}, 1) - 1 as pos from {touched}))"""


def snapshot_rows(valid: str, curr: str = states("curr"), prev: str = states("prev")) -> str:
    old, cur = listed("old", valid, curr, prev), listed("cur", valid, curr, prev)
    pairs = S.with_clean(
        "(select c.url, c.id, c.pos, "
        + ", ".join(f"p.{f} as previous_{f}, c.{f} as current_{f}" for f in FIELDS)
        + f" from {cur} c join {old} p on p.url = c.url and p.id = c.id)",
        ("previous_", "current_"),
    )
    return f"""(select url, id, pos, case when {S.equal_records('previous_', 'current_')} then 'same' else 'changed' end
   as change_type, {SIDES}, {S.material_edit('previous_', 'current_')} as material from {pairs}
union all select url, id, pos, 'added', {", ".join(f"null, {f}" for f in FIELDS)}, {S.material_promo('')}
  from {cur} c where not exists (select 1 from {old} p where p.url = c.url and p.id = c.id)
union all select url, id, pos, 'removed', {", ".join(f"{f}, null" for f in FIELDS)}, {S.material_promo('')}
  from {old} p where not exists (select 1 from {cur} c where p.url = c.url and p.id = c.id))"""


def run_rows(curr: str, prev: str) -> str:
    """One row for each current page: first_run, the material changes and the sentence for them."""
    counted = "(select url, " + ", ".join(
        f"count(*) filter (change_type = '{k}' and material) as n_{k}" for k in ("added", "changed", "removed")
    ) + f" from {snapshot_rows(STATE_OK, curr, prev)} group by url)"
    return f"""(select url, first_run, n_added + n_changed + n_removed > 0 as has_changes,
 n_added, n_changed, n_removed, case when first_run then 'Initial state captured'
  else {S.change_sentence('No material changes detected')} end as summary
from (select c.url, p.url_key is null as first_run, coalesce(n_added, 0) as n_added,
  coalesce(n_changed, 0) as n_changed, coalesce(n_removed, 0) as n_removed
 from (select * from {curr} where {STATE_OK}) c
 left join (select * from {prev} where {STATE_OK}) p on p.url_key = c.url_key
 left join {counted} n on n.url = c.url))"""


SQL["snapshot_run"] = f"select * from {run_rows(states('curr'), states('prev'))}"

# Selectors of the watched pages, as expressions for their opening tags.
OPENINGS = {
    ".promo": open_tag(["promo"]), "div.promo": r'(?is)<div\b[^>]*class="[^"]*\bpromo\b[^"]*"[^>]*>',
    "#deals": r'(?is)<[^>]*\bid="deals"[^>]*>', "section": r"(?is)<section\b[^>]*>",
    "[data-x]": r"(?is)<[^>]*\sdata-x[^>]*>", ".promo, .deal-card": open_tag(["promo", "deal-card"]),
    "section.card[data-x]": r"(?is)<section\b[^>]*\sdata-x[^>]*>", "div#deals": r'(?is)<div\b[^>]*\bid="deals"[^>]*>',
    ".nothing": open_tag(["nothing"]),
}
WATCHED = f"(select * from {D('crawl_targets')} t where enabled is distinct from false)"


def fetched(odd: int) -> str:
    """The newest fetch of every watched page, with what is wrong with it."""
    known = ", ".join(lit(x) for x in OPENINGS)
    return f"""(select *, coalesce('Failed to fetch content: ' || {FETCH}, case when selector not in ({known})
   then 'Selector not supported: ' || selector end) as error
 from (select c.*, t.selector, t.name, row_number() over (partition by c.url order by ts desc, fetch_id desc) as r
  from {D('crawl_pages')} c join {WATCHED} t on t.url = c.url where fetch_id % 2 = {odd}) where r = 1)"""


def crawl_states(odd: int) -> str:
    blocks = " union all ".join(
        f"""select url as page_id, url, unnest(l) as block, generate_subscripts(l, 1) - 1 as pos from (
 select url, {S.every('html', opening + r'(.*?)</[^>]*>', 1)} as l from ok where selector = {lit(selector)})"""
        for selector, opening in OPENINGS.items())
    later = "ts + interval 20 year" if odd else "ts"
    one = "struct_pack(id := id, title := title, perk := perk, dates := dates, price := price)"
    return f"""(with ok as (select * from {fetched(odd)} where error is null), blocks as ({blocks}),
 listed as (select url, list({one} order by pos) as promos from {promos('blocks')} group by url)
 select {S.hash16('ok.url')} as url_key, ok.url, {S.hash16("cast(to_json(coalesce(promos, [])) as varchar)")} as hash,
  coalesce(promos, []) as promos, {later} as last_seen from ok left join listed l on l.url = ok.url)"""


SQL["crawl_run"] = f"""select url, true as success, has_changes, summary, null as name, null as error
from {run_rows(crawl_states(1), crawl_states(0))}
union all select url, false, null, null, name, error from {fetched(1)} where error is not null"""
OUTCOMES = f"""(select 0 as run_id, c.url, f.name, true as success, false as has_changes, false as notified,
  'Initial state captured' as summary, null as error
 from (select * from {crawl_states(0)} where {STATE_OK}) c join {fetched(0)} f on f.url = c.url
union all select 1, r.url, f.name, true, has_changes, has_changes, summary, null
 from {run_rows(crawl_states(1), crawl_states(0))} r join {fetched(1)} f on f.url = r.url
union all select 0, url, name, false, null, null, null, error from {fetched(0)} where error is not null
union all select 1, url, name, false, null, null, null, error from {fetched(1)} where error is not null)"""
SQL["crawl_stream"] = f"""select *, case when coalesce(name, '') = '' then 'Unnamed Target' else name end as shown_name,
 case when success then 'success' else 'failed' end as status,
 case when success and has_changes then 'Changes detected: ' || summary when success then 'No changes detected'
   when coalesce(error, '') = '' then 'Processing failed' else error end as message from {OUTCOMES}"""
RUN_TOTALS = f"""select run_id, count(*) as total, count(*) filter (success) as successful, count(*) filter (not success) as failed,
 count(*) filter (success and has_changes) as with_changes, count(*) filter (notified) as notified from {OUTCOMES} group by run_id"""
SQL["crawl_stream_stats"] = f"""select *, {S.plural('total', ' target processed', ' targets processed')}
 || case when successful > 0 then ', ' || cast(successful as varchar) || ' successful' else '' end
 || case when failed > 0 then ', ' || cast(failed as varchar) || ' failed' else '' end
 || case when with_changes > 0 then ', ' || cast(with_changes as varchar) || ' with changes' else '' end
 || case when notified > 0 then ', ' || {S.plural('notified', ' notification sent', ' notifications sent')} else '' end
 as summary from ({RUN_TOTALS})"""
SQL["stream_run"] = f"""select 0 as run_id, url, true as first_run, false as has_changes, 0 as n_added, 0 as n_changed,
 0 as n_removed, 'Initial state captured' as summary from {states('prev')} where {STATE_OK}
union all select 1, url, first_run, has_changes, n_added, n_changed, n_removed, summary
from ({SQL['snapshot_run']})"""
SQL["stream_changes"] = f"""select url, id, pos, change_type, {SIDES} from {snapshot_rows(STATE_OK)}
where change_type <> 'same' and material"""
SEEN = {side: f"(select url, last_seen as ts from {states(side)} where {STATE_OK})" for side in ("prev", "curr")}
SQL["stream_unseen"] = f"""with prev as {SEEN['prev']}, curr as {SEEN['curr']},
 last as (select url, ts, max(ts) over () as mark, false as again from prev
  union all select url, ts, (select max(ts) from curr), false from prev where url not in (select url from curr)
   and ts + interval 10 day > (select max(ts) from prev)
  union all select url, ts, max(ts) over (), true from curr)
select url, change_type, count(*) as n from (
 select url, 'unseen' as change_type from last where ts + interval 10 day <= mark
 union all select url, change_type from ({SQL['stream_changes']}) c) group by url, change_type"""
SQL["stream_grants"] = f"""select event_id, user_id, bucket, nth <= 2 as allowed, case when nth <= 2 then nth end as nth
from (select *, row_number() over (partition by user_id, bucket order by ts, event_id) as nth
 from (select *, cast(floor(epoch_ms(ts) / 3600000) as bigint) as bucket from {D('requests')} r))"""
SQL["quota_closed"] = f"""select user_id, time_bucket(interval 1 hour, ts) as window_start, count(*) as n_requests
from {D('requests')} r group by 1, 2
having time_bucket(interval 1 hour, any_value(ts)) + interval 1 hour <= (select date_trunc('millisecond', max(ts)) from {D('requests')} m)"""
SQL["stream_quota"] = f"""select user_id, bucket, event_id, ts,
 row_number() over (partition by user_id, bucket order by ts, event_id) <= 2 as allowed
from (select *, cast(floor(epoch_ms(ts) / 3600000) as bigint) as bucket from {D('requests')} r)"""
SQL["quota_expiry"] = f"""select user_id, time_bucket(interval 1 hour, ts) as window_start, count(*) as n_requests
from {D('requests')} r group by 1, 2"""
