"""Inputs the test tables do not have, derived from them as whole tables.

The statements keep to SQL that Spark and the check engine both read, so both sides of a
check start from one definition.  ``{name}`` stands for a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

HOST = "https://travel.example.com"
DOMAINS = ("example.com", "example.net")
AS_OF = "2024-01-31 00:00:00"


def _money(cents: str) -> str:
    whole = f"cast(cast(floor(({cents}) / 100) as bigint) as string)"
    rest = f"lpad(cast(({cents}) % 100 as string), 2, '0')"
    return f"concat('$', {whole}, '.', {rest})"


_PART = f"""
select p_partkey as k, concat('{HOST}/', lower(replace(p_brand, '#', '-'))) as url,
       p_brand as brand, p_name as name, lower(p_type) as kind, cast(p_size as bigint) as s,
       cast(round(p_retailprice * 100) as bigint) as cents
from {{part}}"""

_DATES = "concat('Valid through Mar ', cast(1 + s % 28 as string), ', 2025')"
_PERK = "concat('Complimentary breakfast with the ', kind, ' room')"
_TITLE = "concat('The ', name, ' vacation package')"

# Two record snapshots.  The size of a part says what happens to its record in between.
PROMOS_PREV = f"""
select url, k as pos, concat('p', cast(k as string)) as id, {_TITLE} as title, {_PERK} as perk,
       {_DATES} as dates, concat({_money('cents')}, ' per night') as price
from ({_PART}) a where s not in (5, 6)
union all
select url, k + 1000000000 as pos, concat('p', cast(k as string)) as id, {_TITLE} as title,
       'An older note on breakfast' as perk, {_DATES} as dates,
       concat({_money('cents')}, ' per night') as price
from ({_PART}) b where s in (1, 21, 22)"""

_CENTS_NOW = "case s when 11 then cast(floor(cents * 6 / 5) as bigint) when 12 then cents + 50 else cents end"
PROMOS_CURR = f"""
select url, k as pos, concat('p', cast(k as string)) as id,
       case s when 13 then concat('The  ', name, '   vacation package ref:a1')
              when 14 then concat('Exclusive ', name, ' family getaway week')
              when 19 then concat('The ', name, ' vacation packages')
              else {_TITLE} end as title,
       case s when 16 then 'Please enable javascript'
              when 6 then 'Loading, please wait'
              when 20 then concat('HURRY! ', {_PERK}, ' (updated 01/08/2025)')
              else {_PERK} end as perk,
       case s when 17 then concat('Valid through Mar ', cast(1 + s % 28 as string), ', 2026')
              when 18 then concat('Valid through Mar ', cast(4 + s % 28 as string), ', 2025')
              else {_DATES} end as dates,
       concat({_money(_CENTS_NOW)}, ' per night') as price
from ({_PART}) a where s not in (1, 2)
union all
select url, k + 1000000000 as pos, concat('p', cast(k as string)) as id, {_TITLE} as title,
       {_PERK} as perk, {_DATES} as dates, concat({_money('cents')}, ' per night') as price
from ({_PART}) b where s in (5, 22)"""

# Field pairs for the similarity jobs: the two versions of each record.
PROMO_PAIRS = f"""
select c.id, c.pos, p.title as a_title, p.perk as a_perk, p.dates as a_dates, p.price as a_price,
       c.title as b_title, c.perk as b_perk, c.dates as b_dates, c.price as b_price
from ({PROMOS_CURR}) c join ({PROMOS_PREV}) p on p.id = c.id and p.pos = c.pos"""

# Texts with numeric dates and several amounts, one row per order.
ORDER_PAIRS = """
select o_orderkey as id,
       concat('Valid ', cast(month(o_orderdate) as string), '/', cast(day(o_orderdate) as string),
              '/', cast(year(o_orderdate) as string)) as a_dates,
       concat(case o_orderpriority when '1-URGENT' then 'Until ' when '2-HIGH' then 'From '
                                   else 'Valid ' end,
              case when o_orderpriority = '5-LOW' then 'summer'
                   when o_orderstatus = 'O' then concat(
                     cast(year(o_orderdate) as string), '-',
                     lpad(cast(month(o_orderdate) as string), 2, '0'), '-', '10')
                   else concat(cast(month(o_orderdate) as string), '/', '45/',
                     substring(cast(year(o_orderdate) as string), 3, 2)) end) as b_dates,
       concat('$', cast(cast(floor(o_totalprice) as bigint) as string),
              case when o_orderstatus = 'P' then ' or $25 off' else ' total' end) as a_price,
       concat('$', cast(cast(floor(o_totalprice * case o_orderpriority
                when '1-URGENT' then 1.0 when '2-HIGH' then 1.009 else 1.02 end) as bigint) as string),
              case when o_orderpriority = '3-MEDIUM' then ', or $25 off'
                   when o_orderstatus = 'P' then ' or $26 off' else ' total' end) as b_price
from {orders}"""

_PLACE = """case when s < 8 then 'Maui' when s < 16 then 'Las Vegas' when s < 24 then 'Cancun'
 when s < 32 then 'Oahu' when s < 40 then 'Paris' else 'The coast' end"""
_PRICE = _money("cents")

# One offer page per part, with every kind of mention the extractors know.
OFFER_PAGES = f"""
select k as page_id,
  concat('{HOST}/offer/', case when s >= 49 then 'HAWLIH1HOTELHANALEIBAY20230309/' else '' end,
         cast(k as string)) as url,
  concat('<!DOCTYPE html><html lang="en"><head><title>', brand, ' &amp; ', name, ' offers </title>',
    case when s > 10 then concat('<meta name="description" content=" Offers on ', name, ' for ',
      cast(s as string), ' nights ">') else '' end,
    '<style>p.x</style><script>var price="$1.00"; track(', cast(k as string), ');</script></head><body>',
    '<div class="promo featured"><h2 class="title">', name, ' Escape  Package</h2>',
    case when s % 3 = 0 then '' else concat('<div class="perk">Complimentary breakfast with the ',
      kind, ' room</div>') end,
    '<span class="dates">Valid through Mar ', cast(1 + s % 28 as string), ', 2025</span>',
    '<span class="price">', {_PRICE}, ' per night</span></div>',
    '<div class="deal-card">Free ', name, ' tour: bonus lunch included, valid until 6/30/2025 from ',
      {_PRICE}, ' &bull; 1,234 views</div>',
    '<div class="other-card">Nothing here</div>',
    '<div class="deal-card"><p>Upgrade to the ', kind, ' suite</p></div>',
    case when s % 4 <> 1 then concat('<p>', {_PLACE}, ': The ', name,
      ' Grand Resort &amp; Spa with ocean view rooms and daily breakfast, only ', {_PRICE},
      ' per person. Save up to $', cast(10 * s as string),
      ' when booked early, valid through 12/31/2025!</p>') else '' end,
    case when s % 4 <> 2 then concat('<p>The ', name, ' family vacation package for ',
      cast(s as string), ' nights from ', {_PRICE}, ' per night.</p>') else '' end,
    case when s % 4 <> 3 then concat('<p>Members who book the ', name, ' suite this month save ',
      cast(s as string), '% on tours.</p>') else '' end,
    '<p>A trip across the ', name, ' coast of Jamaica and the Bahamas is starting at ', {_PRICE}, '.</p>',
    case when s % 5 <> 0 then concat('<p>Stay now and enjoy a $', cast(50 + s as string),
      ' gift that you can use as resort credit per room &diams; per stay.</p>') else '' end,
    case when s % 5 <> 1 then
      '<p>Guests get the waived mandatory daily and nightly resort fee with $59 value per day.</p>'
      else '' end,
    case when s >= 49 then
      '<p>You receive a $300 resort credit per room, per stay. Included extras are worth $536 for a four to six night stay. Kauai: 1 Hotel Hanalei Bay welcome package with parking.</p>'
      else '<p>The list of included extras has parking, wifi and welcome drinks.</p>' end,
    '<p>Book by Jan ', cast(1 + s % 28 as string), ', 2025 and travel by 2025-06-30.</p></body></html>'
  ) as html
from ({_PART}) a"""

# One page per part with nested containers, and with what is not well formed.
NESTED_PAGES = f"""
select k as page_id, concat('{HOST}/tree/', cast(k as string)) as url,
  concat('<!DOCTYPE html><html><body><!-- <div class="promo">old</div> --><div class="deals main" id="top" data-kind="', kind, '">',
    '<div class="promo card"><h2 class="title">', name, '</h2><div class="inner"><p class="perk">Free breakfast for two</p></div>',
    '<span class="price">', {_PRICE}, '</span></div>',
    case when s % 3 = 0 then concat('<div class="wrap"><div class="promo">Wrapped <div>offer ', cast(s as string),
      '</div> with dinner</div></div>') else '' end,
    case when s % 4 = 0 then concat('<ul><li class="promo">First of ', cast(s as string),
      '<li class="promo">Second <b>bold</b></ul>') else '' end,
    case when s % 5 = 0 then '<p class="promo">Never closed <i>mixed <b>up</i> text</b>' else '' end,
    '<br class="promo"/><img src="a>b.png" alt="class=''promo''"><script>var x = "<div class=''promo''>";</script>',
    '</div></div><div class=other><DIV Class=''promo  late'' data-kind=plain>Outside ', cast(k as string), '</DIV>',
    '<a href="/offer/', cast(k as string), '.html" class="link promo">Link &amp; more</a></div>',
    case when s % 7 = 0 then concat('<section><div class="promo">Open until the end of page ', cast(k as string)) else
      '</body></html>' end) as html
from ({_PART}) a"""

# A target per customer; the nation decides what is wrong with it.
TARGETS = """
select c_custkey as pos,
  concat(case c_nationkey when 0 then 'http://shop.example.com' when 1 then 'https://localhost'
      when 2 then 'https://127.0.0.1' when 3 then 'https://10.2.3.4' when 4 then 'https://172.20.0.9'
      when 5 then 'https://192.168.1.1' when 6 then 'https://169.254.169.254'
      when 7 then 'https://db.internal' when 8 then 'https://printer.local'
      when 9 then 'https://shop.example.org' when 10 then 'https://notexample.com'
      when 11 then 'https://user:pw@SHOP.Example.com:8443' when 12 then 'https://example.net'
      when 13 then 'https://172.32.0.1.example.com' else 'https://shop.example.com' end,
    '/c/', cast(c_custkey as string)) as url,
  case c_nationkey when 14 then '.promo{color}' when 15 then 'a[href^="JAVASCRIPT:x"]'
      when 16 then ' ' when 17 then repeat('.promo ', 40) when 18 then '.a, .b > h2' else '.promo' end
    as selector,
  case when c_nationkey = 19 then '' when c_nationkey = 20 then concat('<b>', c_name, '</b>')
       when c_nationkey = 21 then repeat(c_name, 8) when c_mktsegment = 'MACHINERY' then null
       else c_name end as name,
  case when c_nationkey = 22 then 'see <SCRIPT src=x>' when c_nationkey = 23 then repeat('n', 501)
       when c_mktsegment = 'BUILDING' then null else concat('segment ', lower(c_mktsegment)) end as notes,
  case when c_acctbal < 1000 then false when c_acctbal < 5000 then true else null end as enabled
from {customer}"""

# One fetch per order.
CRAWL = """
select o_orderkey as fetch_id, concat('https://shop.example.com/c/', cast(o_custkey as string)) as url,
  o_orderdate as ts,
  case o_orderstatus when 'F' then 500 when 'P' then 204 else 200 end as status,
  case o_orderstatus when 'F' then 'Internal Server Error' when 'P' then 'No Content' else 'OK' end
    as status_text,
  case o_orderpriority when '1-URGENT' then 'application/pdf' when '2-HIGH' then null
       when '3-MEDIUM' then 'text/html' else 'text/html; charset=utf-8' end as content_type
from {orders}"""

# The fetched pages, with the containers that the selectors of the watched pages name.
CRAWL_PAGES = f"""
select fetch_id, url, ts, cast(case when status = 204 then 200 else status end as int) as status, status_text,
  case when content_type = 'application/pdf' then content_type else 'text/html' end as content_type,
  concat('<html><body><div id="deals" class="box promo"><h2>Deal ', cast(n as string),
    '</h2><span class="price">$', cast(100 + n * 7 as string), '</span></div><section data-x="1" class="card">',
    '<h3 class="title">Extra ', cast(n % 5 as string), '</h3><span class="perk">Free breakfast for ',
    cast(2 + n % 3 as string), '</span></section>',
    case when n % 2 = 0 then concat('<div class="deal-card">Late offer number ', cast(n as string),
      ' with a free tour</div>') else '' end, '</body></html>') as html
from (select *, cast(fetch_id % 13 as bigint) as n from ({CRAWL}) c) p"""

# Watched pages, with selectors of every kind; the last two kinds are not supported.
CRAWL_TARGETS = """
select concat('https://shop.example.com/c/', cast(c_custkey as string)) as url,
  case c_nationkey % 11 when 0 then '.promo' when 1 then 'div.promo' when 2 then '#deals' when 3 then 'section'
    when 4 then '[data-x]' when 5 then '.promo, .deal-card' when 6 then 'section.card[data-x]'
    when 7 then 'div#deals' when 8 then '.nothing' when 9 then 'div > h2' else '.promo h2' end as selector,
  c_name as name, cast(null as string) as notes, c_acctbal > -500 as enabled
from {customer}"""

# One run result per order.
RESULTS = """
select o_orderkey as result_id, case when o_orderpriority = '5-LOW' then '' when o_orderpriority = '2-HIGH'
    then null else concat('Customer ', cast(o_custkey as string)) end as name,
  concat('https://shop.example.com/c/', cast(o_custkey as string)) as url,
  o_orderstatus <> 'F' as success,
  case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'Failed to fetch content: HTTP 500'
    end as error,
  case when o_orderstatus = 'F' then null else o_orderpriority in ('1-URGENT', '2-HIGH') end
    as has_changes,
  case when o_orderpriority = '1-URGENT' then '2 new promotions' else '1 promotion removed' end as summary,
  o_orderstatus = 'O' and o_orderpriority = '1-URGENT' as notified
from {orders}"""

# A page history per user, one snapshot per event; error events left an unusable hash.
HISTORY = """
select concat('user-', cast(user_id as string)) as url_key, ts, event_id as seq,
  case when event_type = 'error' then ' ' else substring(sha2_hex, 1, 16) end as hash
from (select user_id, ts, event_id, event_type, {sha}(props) as sha2_hex from {events}) e"""


def _snapshots(engine: str, now: bool) -> str:
    """A page per part with its record array, before (``now=False``) and after."""

    def rec(**fields: str) -> str:
        if engine == "spark":
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def arr(*items: str) -> str:
        return ("array(" if engine == "spark" else "list_value(") + ", ".join(items) + ")"

    cents = "case when s between 11 and 20 then cents + 20000 else cents end" if now else "cents"
    title = f"case when s = 27 then concat({_TITLE}, '  ') else {_TITLE} end" if now else _TITLE
    first = rec(
        id="case when s = 8 then '' else concat('p', cast(k as string), '-a') end",
        title=title, perk=_PERK, dates=_DATES, price=f"concat({_money(cents)}, ' per night')",
    )
    second = rec(
        id="concat('p', cast(k as string), '-b')", title="concat(name, ' weekend escape')",
        perk="'Free parking and wifi for two'", dates="'Summer 2025'", price="'$250'",
    )
    one, two = arr(first), arr(first, second)
    promos = f"case when s between 21 and 26 then {one} else {two} end" if now else two
    month, gone = (2, 9) if now else (1, 7)
    return f"""
select concat('{HOST}/p/', cast(k as string)) as url,
  make_timestamp(2024, {month}, cast(1 + s % 28 as int), 6, 0, 0) as ts, {promos} as promos, s
from ({_PART}) a where s <> {gone}"""


_REMARKS = (
    "seen 3/14/2025 here", "seen 2025-03-14 here", "open at 10:45 PM", "code ABCD12345 given", "ref:abc7", "utm_source=mail",
    "tracking7", "id=77x", "1,234 views", "Updated: yesterday", "(posted today)", "limited time only", "call now or later",
    "a *bold* word", "(terms apply)", "(conditions apply)", "(restrictions apply)", "120 people booked", "a trending place",
    "nothing else", "! loud", "loud !",
)
# A text per order, with the remarks that normalising and noise removal look for.
NOTED_TEXTS = """
select o_orderkey + 1000000000 as doc_id, concat(case when o_custkey % 5 = 0 then '! ' else '' end,
  'Offer for customer ', cast(o_custkey as string), ' ', case o_custkey % """ + str(len(_REMARKS)) + " " + " ".join(
    f"when {i} then '{r}'" for i, r in enumerate(_REMARKS)) + """ end, case when o_custkey % 3 = 0 then
  '. Complimentary breakfast for two. Valid through March 2025 from $249.00 per night' when o_custkey % 3 = 1
  then '. Expires on the last day of 2026, bonus tour for $75' else '. A plain sentence' end,
  case when o_custkey % 7 = 0 then ' !' else '' end) as text
from {orders}"""

_MARKS = (
    "&quot;quoted&quot;", "it&#x27;s", "this &amp; that", "a &lt; b", "a &gt; b", "a&nbsp;b", "&diams; one", "&clubs; two",
    "&hearts; three", "&spades; four", "&bull; five", "&#8226; six", "<script>x()</script>", "<iframe src=x>y</iframe>",
    "<object data=x>y</object>", "<embed src=x>", "<link rel=x>", "<meta name=x>", "see javascript:go", "see data:text/html,x",
    "say onclick = now", "a * b _ c ~ d",
)
# A page per order, with the entities and the markup that decoding and escaping look for.
MARKED_PAGES = """
select o_orderkey + 1000000000 as page_id, concat('<p>Order ', cast(o_orderkey as string), ' ',
  case o_custkey % """ + str(len(_MARKS)) + " " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(_MARKS)) + """ end,
  '</p>') as html
from {orders}"""

# Requests: those of the events, and as many again from one user as make a third of all.
REQUESTS = """
select event_id, user_id, ts from {events}
union all select event_id + 1000000000 as event_id, 0 as user_id, ts from {events} where event_id % 2 = 0"""

_RULES = (
    ("[$][0-9.,]+ per night", "'$1'", "null"), ("save [0-9]+% on tours", "null", "'5%'"),
    ("trip across the [a-z ]+ coast", "null", "null"), ("no such words", "null", "null"),
)
# A hundred site rules: four for each nation, of pages whose number starts alike.
SITE_RULES = " union all ".join(
    f"""select concat('/offer/', cast(n_nationkey + 10 as string)) as url_contains, '{pattern}' as pattern,
  concat(n_name, ' offer {i}') as title, cast({price} as string) as price, cast({savings} as string) as savings,
  n_name as location, cast(n_nationkey * 4 + {i} as bigint) as ord from {{nation}}"""
    for i, (pattern, price, savings) in enumerate(_RULES)
)

# A rule for each part, and one for the parts whose numbers end alike: more than travel with a page.
PART_RULES = """
select concat('offer/', cast(p_partkey as string)) as url_contains, '[$][0-9.,]+ per night' as pattern,
  concat('Offer of ', p_brand) as title, cast(null as string) as price, cast(null as string) as savings,
  p_type as location, 1000000 - cast(p_partkey as bigint) as ord from {part}
union all
select right(cast(p_partkey as string), 3) as url_contains, 'trip across the [a-z ]+ coast' as pattern,
  concat('Trip ', p_name) as title, cast(null as string) as price, cast(null as string) as savings,
  cast(null as string) as location, 2000000 + cast(p_partkey as bigint) as ord from {part} where p_size < 10
union all
select substring(r_name, 1, 0) as url_contains, 'no such words' as pattern, 'For all' as title, cast(null as string) as price,
  cast(null as string) as savings, cast(null as string) as location, cast(9000000 as bigint) as ord from {region}"""

# The urls of tenants, and the domains of each: the nation says which kinds it has.
TENANT_URLS = f"""
select concat('tenant-', cast(pos % 97 as string)) as tenant, pos, url from ({TARGETS}) t
union all
select case when o_custkey % 89 = 0 then null else concat('tenant-', cast(o_custkey % 97 as string)) end as tenant,
  o_orderkey + 1000000000 as pos, concat('https://', case o_orderpriority when '1-URGENT' then 'www.' when '2-HIGH' then 'a.b.'
    when '3-MEDIUM' then 'not-' else '' end, 'site', cast(o_custkey % 11 as string), '.example.com/', cast(o_custkey as string)) as url
from {{orders}}"""
TENANT_DOMAINS = """
select concat('tenant-', cast(c_custkey % 97 as string)) as tenant,
  case c_nationkey % 5 when 0 then 'example.com' when 1 then 'EXAMPLE.net' when 2 then 'shop.example.com'
    else concat('site', cast(c_custkey % 11 as string), '.example.com') end as domain
from {customer} where c_custkey % 97 > 20 or c_nationkey % 5 > 2"""

STATEMENTS = {
    "tenant_urls": TENANT_URLS,
    "tenant_domains": TENANT_DOMAINS,
    "part_rules": PART_RULES,
    "site_rules": SITE_RULES,
    "noted_texts": NOTED_TEXTS,
    "marked_pages": MARKED_PAGES,
    "requests": REQUESTS,
    "promos_prev": PROMOS_PREV,
    "promos_curr": PROMOS_CURR,
    "promo_pairs": PROMO_PAIRS,
    "order_pairs": ORDER_PAIRS,
    "offer_pages": OFFER_PAGES,
    "nested_pages": NESTED_PAGES,
    "targets": TARGETS,
    "crawl": CRAWL,
    "crawl_pages": CRAWL_PAGES,
    "crawl_targets": CRAWL_TARGETS,
    "results": RESULTS,
    "history": HISTORY,
}
SNAPSHOTS = {"snapshots_prev": False, "snapshots_curr": True}


def _statement(name: str, engine: str) -> str:
    if name in SNAPSHOTS:
        return _snapshots(engine, SNAPSHOTS[name])
    return STATEMENTS[name]


def _tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)) - {"color", "sha"})


def _fill(text: str, names: dict[str, str]) -> str:
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text


def duckdb_sql(name: str) -> str:
    """The derived table as a sub-select for the check engine."""
    text = _statement(name, "duckdb")
    return "(" + _fill(text, {"sha": "sha256"} | {t: t for t in _tables(text)}) + ")"


#: Tables of pages and long texts.  A page is some twenty times the row it is built from and takes far longer
#: to search than to read, so a file that one task can read holds the work of many.
SPREAD = {
    "noted_texts", "marked_pages", "offer_pages", "nested_pages", "crawl_pages", "snapshots_prev", "snapshots_curr",
}
SPREAD_BY = {"part": "p_partkey", "orders": "o_orderkey"}


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The derived table as a DataFrame over the given tables.

    The narrow rows that pages are built from are dealt over all tasks by their key, before they grow.
    """
    text = _statement(name, "spark")
    names = {"sha": "sha2_256"}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table in _tables(text):
        names[table] = f"parquet.`{folder}/{table}.parquet`"
        if name in SPREAD:
            # With a number the rows are not put together again for their few bytes.
            names[table] = f"(select /*+ repartition({parts}, {SPREAD_BY[table]}) */ * from {names[table]})"
    text = _fill(text, names).replace("sha2_256(props)", "sha2(props, 256)")
    return spark.sql(text)
