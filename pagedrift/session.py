"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # ISO texts, date arithmetic and relative ages are all read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # One hot url or record id must not pin a join to one task.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; safe to call on any session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint location.

    A temporary folder of this machine is used only by a local session that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        return tempfile.mkdtemp(prefix=f"pagedrift-{purpose}-")
    return f"{base.rstrip('/')}/pagedrift/{purpose}-{uuid.uuid4().hex}"
