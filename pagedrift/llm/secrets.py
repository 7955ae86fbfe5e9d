"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean trigram query: an OR of ANDs of lower-case trigrams that
any match must contain.  The index holds the postings (trigram, document) of the trigrams the
rules ask for.  The postings of each AND are intersected by counting, and only the documents left
are searched with the regex.  A rule without mandatory trigrams searches all documents.

Everything runs as DataFrame functions.  A span is where the whole match lies, in code points, end
exclusive.  Positions are the lengths of the pieces between matches, since Spark has no function
for them.

Defined cases: a null text is empty; rows may repeat and are searched on their own; rows that share
a ``doc_id`` (null too) share candidates, which only widens the search.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: Kind, regex, the group whose length counts, its least length, part of the base set.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # A greedy run is the longest from its start, so its least length may stand in the regex.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
    ("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, False),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 1, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
)

Query = frozenset  # of frozensets of trigrams: any of them, all within
ANY: Query = frozenset([frozenset()])
MOST_TEXTS, MOST_CHOICES = 64, 8


# --- regex to trigrams -----------------------------------------------------------------------

def _either(*queries: Query) -> Query:
    """OR; an AND that contains another one adds nothing."""
    every = frozenset().union(*queries)
    return frozenset(a for a in every if not any(b < a for b in every))


def _both(a: Query, b: Query) -> Query:
    return _either(frozenset(x | y for x in a for y in b))


def _of_texts(texts: set[str]) -> Query:
    """What a string that contains one of the texts must contain."""
    return _either(frozenset(
        frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts
    ))


def _choices(members) -> set[str] | None:
    out: set[str] = set()
    for op, value in members:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST_CHOICES:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHOICES else None


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """(all texts it can match, if they are few; what else a match must contain)."""
    texts, needed, whole = {""}, ANY, True

    def add(exact: set[str] | None, query: Query) -> None:
        nonlocal texts, needed, whole
        if exact is not None and len(texts) * len(exact) <= MOST_TEXTS:
            texts = {a + b for a in texts for b in exact}
            needed = _both(needed, query)
            return
        needed, whole = _both(_both(needed, _of_texts(texts)), query), False
        texts = {""} if exact is None else exact

    for op, value in nodes:
        if op is C.LITERAL:
            add({chr(value).lower()}, ANY)
        elif op is C.IN:
            add(_choices(value), ANY)
        elif op is C.SUBPATTERN:
            add(*_analyse(value[-1]))
        elif op is C.BRANCH:
            parts = [_analyse(branch) for branch in value[1]]
            if all(exact is not None for exact, _ in parts):
                add(set().union(*[exact for exact, _ in parts]), _either(*[q for _, q in parts]))
            else:
                add(None, _either(*[_both(q, _of_texts(e) if e else ANY) for e, q in parts]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = value
            exact, query = _analyse(body)
            if (least, most) == (0, 1) and exact is not None:
                add(exact | {""}, ANY)
            elif least == most == 1:
                add(exact, query)
            elif least:
                add(None, _both(query, _of_texts(exact) if exact else ANY))
            else:
                add(None, ANY)
        elif op is not C.AT:
            add(None, ANY)
    return (texts, needed) if whole else (None, _both(needed, _of_texts(texts)))


def trigram_query(pattern: str) -> Query:
    exact, query = _analyse(_parser.parse(pattern))
    return _both(query, _of_texts(exact)) if exact is not None else query


# --- index and candidates --------------------------------------------------------------------

def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram doc_id`` of the given lower-case trigrams."""
    if not trigrams:
        return docs.select(F.lit("").alias("trigram"), "doc_id").where("false")
    has = F.transform(
        F.array(F.lower("text")),
        lambda text: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(text, g)),
    )[0]
    return docs.select("doc_id", F.explode(has).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``of rules``: for each document with any, the rules whose trigram query it satisfies."""
    terms = [
        (rule, n, gram, len(grams))
        for rule, query in queries.items() for n, grams in enumerate(sorted(query, key=sorted)) for gram in sorted(grams)
    ]
    spark = postings.sparkSession
    asked = spark.createDataFrame(terms, "rule string, nth int, trigram string, size long")
    hits = postings.join(F.broadcast(asked), "trigram")  # a few dozen rows, from the rules alone
    met = hits.groupBy("doc_id", "rule", "nth", "size").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = size").groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("rule").alias("rules"))


# --- spans -----------------------------------------------------------------------------------

def spans(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Sorted array of (start, rank, end, kind) of the leftmost non-overlapping matches."""
    p = F.lit(pattern)
    found = F.array(F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("part"),
        F.split(text, pattern, -1).alias("between"),
    ))

    def walk(x: Column) -> Column:
        empty = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
        zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(x["between"][i])
            end = start + F.length(x["whole"][i])
            one = F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")
            )
            kept = F.when(F.length(x["part"][i]) >= least, F.array(one)).otherwise(empty)
            return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

        places = F.sequence(F.lit(0), F.size(x["whole"]) - 1)
        return F.aggregate(places, zero, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return F.when(text.rlike(pattern), F.transform(found, walk)[0]).otherwise(none)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id text spans`` of every row of ``docs`` (``doc_id``, ``text``): spans by start, then rule."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {rule[0]: trigram_query(rule[1]) for rule in rules}
    asked = {kind: q for kind, q in queries.items() if q != ANY}
    grams = sorted({g for q in asked.values() for grams in q for g in grams})
    found = candidates(index(rows, grams), asked)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["of"]), "left")
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    each = []
    for rank, (kind, pattern, group, least, _) in enumerate(rules):
        value = spans(F.col("text"), pattern, group, least, rank, kind)
        if kind in asked:
            value = F.when(F.array_contains("rules", kind), value).otherwise(none)
        each.append(value)
    return joined.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = scan(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    base = [kind for kind, *_, in_base in RULES if in_base]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined_spans(F.filter("spans", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same in DuckDB, without an index: pieces and matches of each rule, lengths summed up."""
    each = []
    for rank, (kind, pattern, group, least, _) in enumerate(RULES):
        p = pattern.replace("'", "''")
        each.append(f"""select k, doc_id, {rank} as rank, '{kind}' as kind, unnest(list_transform(
 generate_series(1, len(w)), lambda i: {{'s': list_sum(list_transform(b[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0), 'n': length(w[i]), 'g': length(g[i])}})) as m
from (select k, doc_id, regexp_extract_all(text, '{p}') as w, regexp_extract_all(text, '{p}', {group}) as g,
 string_split_regex(text, '{p}') as b from d) where len(w) > 0""")
    union = "\nunion all\n".join(
        f"select k, rank, kind, m.s as s, m.s + m.n as e from ({q}) where m.g >= {RULES[n][3]}" for n, q in enumerate(each)
    )
    one = "kind || ':' || cast(s as bigint) || ':' || cast(e as bigint)"
    return f"""with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
m as ({union}),
s as (select k, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
 count(*) filter (rank = 2) as n_hex, string_agg({one}, ',' order by s, rank) filter (rank < 3) as base,
 string_agg({one}, ',' order by s, rank) as spans from m group by k)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
 sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join s on s.k = d.k"""


OP2_SQL = _sql()
