"""Dataset manifest: a Merkle tree over the rows of a table, with a proof for each row.

A leaf hashes the fields of a row, each with its length.  The leaves of a group (a language) are
ordered and numbered; at each level two neighbours have one parent, the last one may be alone in
its run.  The roots of the groups, in the order of the groups, form a tree of their own.

Nodes are dealt into blocks of consecutive slots of a group, and all levels of a block are columns
of window functions over it: on the row that is the first leaf below a node stands the hash of the
node, a lag or lead by the fixed width of the level, masked by slot and run length, is its sibling,
and rows of first children hash their parents.  On the way down the same lags hand the siblings
above a node to its second child.  The roots of the blocks are the nodes of the next table, until
every group has one.  A block is bounded, so no group meets in one task.

Defined cases: null fields are marked as such and differ from empty ones; a null group stands first
and differs from an empty one.  Rows of one id are ordered by their leaf, a null id comes first, and
repeated rows are leaves of their own.  Other columns of the table are not part of a leaf.  An
empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, prepare, table, written

#: Levels of the tree that one block of slots holds.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """The hash of a row: each field as its length in bytes and its value, ``-`` for null."""

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.when(field.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        )

    return F.sha2(F.concat(*[told(f) for f in fields]), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """With ``pos``, the gapless number of a row in its group, and ``n``, the size of the group.

    Rows are sorted over ranges of (group, order), so a large group lies in many ranges; a range
    adds what the ranges before it hold of the group.  Equal rows are spread by where they stood.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "__stood")]
    ranges = rows.withColumn("__stood", F.monotonically_increasing_id()).repartitionByRange(
        partitions(spark), *keys
    ).sortWithinPartitions(*keys)
    # The number of a row within its range is the lower part of this id.
    at = F.monotonically_increasing_id()
    sorted_rows = written(ranges.drop("__stood").select(
        "*", F.spark_partition_id().alias("__range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")
    ), "manifest-order")
    counts = sorted_rows.groupBy(group, "__range").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__g"), F.col("__range").alias("__r"),
        (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__o"),
        F.sum("__c").over(of_group).alias("n"),
    )
    return sorted_rows.join(
        offsets, (F.col(group) == F.col("__g")) & (F.col("__range") == F.col("__r"))
    ).select(*rows.columns, (F.col("__at") + F.col("__o")).alias("pos"), "n")


def _nodes(level: int) -> Column:
    """How many nodes the group has at a level."""
    return F.shiftright(F.col("n") + F.lit((1 << level) - 1), level)


def _slot(level: int) -> Column:
    return F.shiftright("pos", level).bitwiseAND(F.lit(1))


def _block() -> Window:
    return Window.partitionBy("g", "block").orderBy("pos")


def _lifted(nodes: DataFrame) -> DataFrame:
    """With ``h0`` to ``h{LEVELS}`` and the siblings ``s0`` ...: on the row of the first leaf of a node."""
    out = nodes.withColumn("block", F.shiftright("pos", LEVELS)).withColumn("h0", F.col("h"))
    for k in range(LEVELS):
        mine, step = F.col(f"h{k}"), 1 << k
        right, left = F.lead(mine, step).over(_block()), F.lag(mine, step).over(_block())
        first = F.col("pos").bitwiseAND(F.lit(step - 1)) == 0
        last = F.shiftright("pos", k) + 1 >= _nodes(k)
        sibling = F.when(first & (_slot(k) == 1), left).when(first & ~last, right)
        out = out.withColumn(f"s{k}", sibling)
        parent = F.when(_nodes(k) > 1, F.sha2(F.concat(mine, F.coalesce(F.col(f"s{k}"), F.lit(""))), 256)).otherwise(mine)
        out = out.withColumn(f"h{k + 1}", F.when(first & (_slot(k) == 0), parent))
    return out


def _descended(lifted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """With ``path``: the siblings of a node and of all above it within the block, lowest first.

    A step is ``<`` and the sibling before the node, or ``>`` and the one after it, if any.
    """
    out = lifted.withColumn("path", F.lit(""))
    for k in reversed(range(LEVELS)):
        above = F.when(_slot(k) == 0, F.col("path")).otherwise(F.lag("path", 1 << k).over(_block()))
        step = F.when(_nodes(k) > 1, F.concat(
            F.when(_slot(k) == 1, F.lit("<")).otherwise(F.lit(">")), F.coalesce(F.col(f"s{k}"), F.lit("")), F.lit(",")
        )).otherwise(F.lit(""))
        first = F.col("pos").bitwiseAND(F.lit((1 << k) - 1)) == 0
        out = out.withColumn("path", F.when(first, F.concat(step, above)))
    return out.select(*columns, "block", "path")


def proved(nodes: DataFrame, most: int, beyond: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (``g pos n h`` and others; ``most`` is the largest ``n``) with ``path subroot root``.

    ``beyond`` does that for the table with one node for each group.
    """
    if most <= 1:
        return beyond(nodes)
    lifted = _lifted(nodes)
    tops = written(lifted.where(F.col("pos").bitwiseAND(F.lit((1 << LEVELS) - 1)) == 0).select(
        "g", F.col("block").alias("pos"), _nodes(LEVELS).alias("n"), F.col(f"h{LEVELS}").alias("h")
    ), "manifest-tops")
    upper = proved(tops, (most + (1 << LEVELS) - 1) >> LEVELS, beyond).select(
        F.col("g").alias("__g"), F.col("pos").alias("__block"), F.col("path").alias("__above"), "subroot", "root"
    )
    return _descended(lifted, nodes.columns).join(
        upper, (F.col("g") == F.col("__g")) & (F.col("block") == F.col("__block"))
    ).select(*nodes.columns, F.concat("path", "__above").alias("path"), "subroot", "root")


def _size(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def _of_groups(subroots: DataFrame) -> DataFrame:
    """Path and root of each subroot in the tree over the groups."""
    own = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "h"), "g", ["key"])
    whole = proved(own, _size(own), lambda one: one.select(
        "*", F.lit("").alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root")
    ))
    of_key = whole.select(F.col("key").alias("__k"), "path", F.col("h").alias("subroot"), "root")
    return subroots.join(of_key, F.col("g") == F.col("__k")).drop("__k")


def manifest(leaves: DataFrame, group: Column, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with the hash ``leaf``) and ``path subroot root``.

    ``path`` is the proof: the siblings from the leaf to the root.
    """
    # A group of its own for null, before all others.
    key = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group))
    nodes = numbered(leaves.withColumn("g", key).withColumn("h", F.col("leaf")), "g", order)
    return proved(nodes, _size(nodes), _of_groups).select(*leaves.columns, "path", "subroot", "root")


def proof_sha256(path: Column) -> Column:
    """The hash of the siblings of a proof, in its order."""
    return F.sha2(F.translate(path, "<>,", ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    steps = F.filter(F.split(path, ","), lambda s: s != F.lit(""))

    def up(now: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        return F.sha2(
            F.when(F.startswith(step, F.lit("<")), F.concat(sibling, now)).otherwise(F.concat(now, sibling)), 256
        )

    return F.aggregate(steps, start, up)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    after = leaf(*{**fields, "n_chars": F.col("n_chars") + 1}.values())
    leaves = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf(*fields.values()).alias("leaf"),
        F.when(touched, after).alias("tampered"),
    ), "manifest-leaves")
    whole = manifest(leaves, F.col("lang"), ["doc_id", "leaf"])
    return whole.select(
        "doc_id", "leaf", "subroot", "root", proof_sha256(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _told(field: str) -> str:
    return f"coalesce(strlen({field}::varchar) || ':' || {field}::varchar, '-')"


def _levels(name: str, source: str) -> str:
    return f"""{name}(g, k, pos, n, h) as (
  select g, 0, pos, n, h from {source}
  union all
  select g, k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos))
  from {name} where n > 1 group by g, k, pos // 2, n)"""


_SQL_LEAF = " || ".join(_told(f) for f in FIELDS)
_SQL_TAMPERED = " || ".join(_told("(n_chars + 1)" if f == "n_chars" else f) for f in FIELDS)
OP12_SQL = f"""
with recursive
crc_table as (select list(c order by b) as t from (
  select b, list_reduce(list_prepend(b, range(8)),
    lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from (select unnest(range(256)) as b))),
crcs as (select doc_id, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as crc
  from (select distinct doc_id from documents), crc_table),
leaves as (select doc_id, coalesce('=' || lang, '-') as g, sha256({_SQL_LEAF}) as h,
    sha256(case when crc % 7 = 0 and n_chars is not null then {_SQL_TAMPERED} else {_SQL_LEAF} end) as changed
  from documents left join crcs using (doc_id)),
low as (select *, row_number() over (partition by g order by doc_id, h) - 1 as pos, count(*) over (partition by g) as n
  from leaves),
{_levels("tree", "low")},
top as (select '' as g, g as of, h, row_number() over (order by g) - 1 as pos, count(*) over () as n
  from tree where n = 1),
{_levels("crown", "top")},
steps as (
  select l.doc_id, l.g, t.k, (l.pos >> t.k) & 1 as slot, s.h
  from low l join tree t on t.g = l.g and t.pos = l.pos >> t.k and t.n > 1
  left join tree s on s.g = t.g and s.k = t.k and s.pos = xor(t.pos, 1)
  union all
  select l.doc_id, l.g, 1000 + c.k, (p.pos >> c.k) & 1, s.h
  from low l join top p on p.of = l.g join crown c on c.pos = p.pos >> c.k and c.n > 1
  left join crown s on s.k = c.k and s.pos = xor(c.pos, 1)),
paths as (select doc_id, list(slot order by k) as slots, list(coalesce(h, '') order by k) as hashes from steps group by doc_id),
folds as (
  select doc_id, 0 as i, changed as h from low
  union all
  select f.doc_id, i + 1, sha256(case when slots[i + 1] = 1 then hashes[i + 1] || h else h || hashes[i + 1] end)
  from folds f join paths p on p.doc_id = f.doc_id where i < len(slots))
select l.doc_id, l.h as leaf, p.h as subroot, r.h as root,
  sha256(coalesce(array_to_string(hashes, ''), '')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from low l join top p on p.of = l.g cross join (select h from crown where n = 1) r
left join paths q on q.doc_id = l.doc_id
join folds f on f.doc_id = l.doc_id and f.i = coalesce(len(slots), 0)
"""
