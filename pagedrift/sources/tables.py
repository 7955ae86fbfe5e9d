"""Reading crawl and target tables, writing targets, states, changes and digests."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import url_allowed
from ..operators.targets import accepted_targets, rejected_targets
from ..schemas import CRAWL, STATE, TARGET
from ..session import shared_folder
from . import commits


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows from a new folder of the shared place: computed once for all that read them."""
    spark = rows.sparkSession
    path = shared_folder(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# --- crawl -----------------------------------------------------------------------

def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CRAWL).parquet(path)


def fetch_problem(allowed_domains: Sequence[str] | None = None) -> Column:
    """Why a fetched page is not accepted, or null."""
    content_type = F.coalesce(F.col("content_type"), F.lit(""))
    problem = F.when(
        F.coalesce(~F.col("status").between(200, 299), F.lit(True)),
        F.concat(
            F.lit("HTTP "),
            F.coalesce(F.col("status").cast("string"), F.lit("")),
            F.lit(": "),
            F.coalesce(F.col("status_text"), F.lit("")),
        ),
    ).when(
        ~content_type.contains("text/html"),
        F.concat(F.lit("Unexpected content type: "), content_type),
    )
    if allowed_domains is None:
        return problem
    return F.when(
        ~url_allowed(F.col("url"), allowed_domains),
        "URL not allowed: Only HTTPS URLs from approved domains are permitted",
    ).otherwise(problem)


def check_crawl(crawl: DataFrame, allowed_domains: Sequence[str] | None = None) -> DataFrame:
    """Crawl rows with ``error``: null for accepted pages, the reason for the others."""
    problem = fetch_problem(allowed_domains)
    return crawl.withColumn(
        "error", F.when(problem.isNotNull(), F.concat(F.lit("Failed to fetch content: "), problem))
    )


# --- targets ---------------------------------------------------------------------

def _target_rows(spark: SparkSession, path: str, fmt: str, version: int | None) -> DataFrame:
    """The rows of a list: of a version of it, and of files put beside it since."""
    found = commits.read(spark, path, version) if version is not None else commits.latest(spark, path)
    if found is None:
        return spark.read.schema(TARGET).format(fmt).load(path)
    loose = set(commits.loose_files(spark, path)) - set(found.manifest["replaced"]) if version is None else ()
    places = [*found.manifest["folders"], *sorted(loose)]
    return spark.read.schema(TARGET).format(found.manifest["format"]).load([f"{path}/{p}" for p in places])


def read_targets(
    spark: SparkSession,
    path: str,
    allowed_domains: Sequence[str],
    strict: bool = False,
    fmt: str = "json",
    version: int | None = None,
) -> DataFrame:
    """The valid targets of a list.  Unreadable JSON rows have no url, so they count as invalid.

    ``strict`` gives an empty list as soon as one row is invalid; otherwise invalid rows are
    left out (see :func:`read_rejected_targets`).  ``version``: an earlier state of the list.
    """
    return accepted_targets(_target_rows(spark, path, fmt, version), allowed_domains, strict)


def read_rejected_targets(
    spark: SparkSession, path: str, allowed_domains: Sequence[str], fmt: str = "json", version: int | None = None
) -> DataFrame:
    return rejected_targets(_target_rows(spark, path, fmt, version), allowed_domains)


def replace_targets(
    targets: DataFrame, path: str, allowed_domains: Sequence[str], fmt: str = "json"
) -> int:
    """Make the rows the new version of the list, only when every one is valid.

    The rows are written before they are checked, so what is checked is what counts.  Until the version is
    committed readers see the list as it was.  ``targets`` may come from the list itself.
    """
    spark = targets.sparkSession
    last = commits.latest(spark, path)
    number = last.number + 1 if last else 0
    folder = commits.new_folder(f"version={number}")
    targets.write.format(fmt).save(f"{path}/{folder}")
    written = spark.read.schema(TARGET).format(fmt).load(f"{path}/{folder}")
    if not rejected_targets(written, allowed_domains).isEmpty():
        raise ValueError("Invalid targets configuration provided")
    manifest = {"folders": [folder], "format": fmt, "replaced": commits.loose_files(spark, path)}
    commits.commit(spark, path, number, manifest)
    return number


# --- run outputs -----------------------------------------------------------------
# Every run writes its own sub-folder, in overwrite mode: repeating a run (a retried micro-batch)
# replaces its own output and nothing else.

def write_run(rows: DataFrame, path: str, run_id: int, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").format(fmt).save(f"{path}/run_id={run_id}")


# --- keyed tables ------------------------------------------------------------------
# Of a key, the rows of its newest run count, or none if that run deleted it.  A run writes the keys it
# touched, dealt into buckets of the key's hash and sorted by key.  Every so many runs (an epoch) the first
# one also takes over all other keys, so a run reads one epoch, of it the buckets it touches, and of them
# its own keys.  Each run is a version (see ``commits``); its manifest says how the table is dealt.

BUCKETS, EVERY = 64, 20
DELETED = "__deleted"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _plain(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def keyed_version(
    spark: SparkSession, path: str, before: int | None = None, **expected: object
) -> commits.Version | None:
    """The newest version before a run.  What is ``expected`` of the manifest must be so."""
    found = commits.latest(spark, path, before)
    if found is None:
        return None
    for name, value in expected.items():
        if value is not None and found.manifest.get(name) != value:
            raise ValueError(f"{path} is stored with {name} {found.manifest.get(name)}, not {value}")
    return found


def _stored(spark: SparkSession, path: str, version: commits.Version) -> DataFrame:
    """All rows of the folders of a version, with ``run_id`` and ``bucket``."""
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in version.manifest["schema"]])
    schema = schema.add(DELETED, T.BooleanType()).add("run_id", T.LongType()).add("write", T.StringType()).add(
        "bucket", T.IntegerType()
    )
    folders = [f"{path}/{f}" for f in version.manifest["folders"]]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).drop("write")


def read_keyed(
    spark: SparkSession, path: str, schema: T.StructType, run_id: int | None = None, keys: DataFrame | None = None,
    key: str = "url_key", buckets: int | None = None, every: int | None = None,
) -> DataFrame:
    """The rows as they are before ``run_id`` (default: now); of ``keys`` (a column ``key``) only, if given.

    The table knows its buckets and epochs; other ones, another key or another schema are an error.
    """
    found = keyed_version(
        spark, path, run_id, key=key, buckets=buckets, every=every, schema=[list(f) for f in _plain(schema)]
    )
    if found is None:
        return spark.createDataFrame([], schema)
    rows = _stored(spark, path, found)
    if keys is not None:
        wanted = keys.select(key).distinct()
        n = found.manifest["buckets"]
        touched = wanted.select(bucket_of(F.col(key), n)).distinct().collect()  # at most buckets
        rows = rows.where(F.col("bucket").isin([r[0] for r in touched])).join(wanted, key, "left_semi")
    newest = rows.groupBy(key).agg(F.max("run_id").alias("run_id"))
    return rows.join(newest, [key, "run_id"], "left_semi").where(~F.col(DELETED)).drop(DELETED, "run_id", "bucket")


def scan_keyed(
    spark: SparkSession, path: str, schema: T.StructType, value: str, run_id: int | None = None, key: str = "url_key",
) -> DataFrame:
    """The rows of one key before ``run_id``: one bucket is read, of it the pages that may hold the key."""
    found = keyed_version(spark, path, run_id, key=key, schema=[list(f) for f in _plain(schema)])
    if found is None:
        return spark.createDataFrame([], schema)
    rows = _stored(spark, path, found).where(
        (F.col("bucket") == bucket_of(F.lit(value), found.manifest["buckets"])) & (F.col(key) == value)
    )
    newest = rows.agg(F.max("run_id").alias("top")).scalar()
    return rows.where((F.col("run_id") == newest) & ~F.col(DELETED)).drop(DELETED, "run_id", "bucket")


def write_keyed(
    rows: DataFrame, path: str, run_id: int, key: str = "url_key",
    buckets: int | None = None, every: int | None = None, keep: Column | None = None,
    deleted: DataFrame | None = None,
) -> None:
    """Store the rows of the keys of this run; a key's earlier rows no longer count.

    ``keep``: which rows of other keys a new epoch takes over (default: all).  ``deleted``: keys
    (a column ``key``) whose rows are gone with this run, unless ``rows`` has new ones.  A
    repeated run replaces itself; a run before the newest one is an error.
    """
    spark = rows.sparkSession
    plain = [list(f) for f in _plain(rows.schema)]
    base = keyed_version(spark, path, run_id, key=key, buckets=buckets, every=every, schema=plain)
    there = commits.numbers(spark, path)
    if there and there[-1] > run_id:
        raise ValueError(f"{path} already holds run {there[-1]}, run {run_id} comes too late")
    how = base.manifest if base else {"buckets": buckets or BUCKETS, "every": every or EVERY}
    buckets, every = how["buckets"], how["every"]
    new = rows.withColumn(DELETED, F.lit(False))
    folders = list(base.manifest["folders"]) if base else []
    if deleted is not None:
        marks = deleted.select(F.col(key).cast(rows.schema[key].dataType).alias(key)).where(
            F.col(key).isNotNull()).distinct().join(rows.select(key).distinct(), key, "left_anti")
        new = new.unionByName(marks.withColumn(DELETED, F.lit(True)), allowMissingColumns=True)
    if base and run_id // every > base.number // every:
        old = read_keyed(spark, path, rows.schema, run_id, None, key)
        old = old if keep is None else old.where(keep)
        old = old.join(new.select(key).distinct(), key, "left_anti").withColumn(DELETED, F.lit(False))
        # Everything older is merged, so marks have nothing left to hide.
        new, folders = new.where(~F.col(DELETED)).unionByName(old), []
    folder = commits.new_folder(f"run_id={run_id}")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    dealt = new.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition(
        F.col("bucket"), F.pmod(F.hash(key), F.lit(parts))
    ).sortWithinPartitions("bucket", key)
    # Sorted by key, so pages and row groups without a key are known; the filter tells for single groups.
    dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(f"{path}/{folder}")
    manifest = {"key": key, "buckets": buckets, "every": every, "schema": plain, "folders": [*folders, folder]}
    commits.commit(spark, path, run_id, manifest, again=True)


def delete_keyed(keys: DataFrame, path: str, run_id: int, schema: T.StructType, key: str = "url_key") -> None:
    """Delete the rows of the keys, as run ``run_id`` of the table."""
    write_keyed(keys.sparkSession.createDataFrame([], schema), path, run_id, key, deleted=keys)


# --- bucketed tables -----------------------------------------------------------------
# A table of the catalog that Spark itself knows to be dealt and sorted by key: a join by that key moves and
# sorts the other side only.  Its own bucket count is its number of tasks, so it is sized to the data.

def store_bucketed(rows: DataFrame, name: str, key: str, buckets: int | None = None) -> str:
    """Store the rows as a new table bucketed and sorted by ``key``; gives its name.

    Spark relies on the order within a bucket where ``spark.sql.legacy.bucketedTableScan.outputOrdering``
    is set; without it a join sorts the stored side again, but still does not move it.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    # One task for each bucket, so each bucket is one sorted file.
    rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option(
        "path", f"{shared_folder(spark, 'bucketed')}/{table}"
    ).saveAsTable(table)
    return table


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def write_digest(messages: DataFrame, path: str, run_id: int) -> None:
    """Digest messages as JSON lines."""
    write_run(messages, path, run_id, "json")
