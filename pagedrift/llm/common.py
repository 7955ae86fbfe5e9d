"""What the training-data operators share: session settings, written intermediates, ranks."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import configure, shared_folder

SETTINGS = {
    # Whole texts travel in Arrow batches: bound a batch by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.python.filterPushdown.enabled": "true",
}
#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings of the library and of these operators.

    Functions of this package go to the workers by value: they need no installed copy of it.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    configure(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has; sized by whoever runs the job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write to a new folder of the shared place and read that.

    The rows outlive lost executors, and every later reader sees the same ones.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def written_at(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared place."""
    return f"{shared_folder(spark, purpose)}-{uuid.uuid4().hex[:8]}"


def dealt(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """With ``__h``, a hash that puts rows in a random order, and ``__b``, a bucket of it.

    A bucket is the upper bits of the hash, so the order by bucket and hash is that of the hash, however
    many buckets the session asks for.
    """
    bits = (64 * max(partitions(rows.sparkSession), 8) - 1).bit_length()
    return rows.withColumn("__h", F.xxhash64(*order)).withColumn("__b", F.shiftright("__h", 64 - bits))


def columns_of(rows: DataFrame) -> list[Column]:
    """The columns, whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | None, name: str) -> DataFrame:
    """Add the sum of ``value`` (None: the number) of the rows of the same key that come before.

    No key is brought into one task: rows are dealt by (key, bucket of :func:`dealt`), summed up,
    and the sums of the earlier buckets are added.  Only one row for each bucket of a key meets in
    a task.  The order is that of the bucket, the hash and ``order``; rows equal in all of it come
    in any order.  The rows of :func:`dealt` are used as they are when they have its columns.
    """
    hashed = rows if "__b" in rows.columns else dealt(rows, order)
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    by = [*keys, "__b"]
    sums = hashed.groupBy(*by).agg(F.sum(amount).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
    )
    within = Window.partitionBy(*by).orderBy("__h", *order).rowsBetween(Window.unboundedPreceding, -1)
    summed = hashed.withColumn("__r", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
    return summed.join(offsets, _all(same), "left").select(
        *columns_of(rows), (F.col("__o") + F.col("__r")).cast("long").alias(name)
    )


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 in the order of :func:`running`."""
    return running(rows, keys, order, None, name)


#: Most rows (of a few longs) that are broadcast; about 16 MB.
BROADCAST_ROWS = 500_000


def bounded(rows: DataFrame) -> DataFrame:
    """With the hint to broadcast, if there are few enough rows; else a join shuffles them."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def arrow_map(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` takes a record batch and yields record batches (or nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return rows.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each text; null: empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
