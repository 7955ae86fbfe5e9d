"""Versions of a stored table: a manifest for each commit, switched by one rename.

Data goes to new folders first.  Then the manifest that names them is written under another name
and renamed; a writer that stops before leaves the table as it was.  A reader takes one manifest
and reads the folders it names, so it sees one version to its end, and older versions stay readable
until :func:`forget` removes them.  The file system must rename a file in one step, as HDFS and local
ones do.
"""

from __future__ import annotations

import json
import uuid
from typing import Any, NamedTuple

from pyspark.sql import SparkSession


class Version(NamedTuple):
    number: int
    manifest: dict[str, Any]


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, table: str) -> list[int]:
    """The commits of a table, oldest first."""
    folder = _path(spark, table, "commits")
    files = _files(spark, folder)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def read(spark: SparkSession, table: str, number: int) -> Version:
    path = _path(spark, table, "commits", f"{number:020d}.json")
    stream = _files(spark, path).open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, json.loads(text))


def latest(spark: SparkSession, table: str, before: int | None = None) -> Version | None:
    """The newest version, of those below ``before`` if given."""
    found = [n for n in numbers(spark, table) if before is None or n < before]
    return read(spark, table, found[-1]) if found else None


def commit(spark: SparkSession, table: str, number: int, manifest: dict[str, Any], again: bool = False) -> None:
    """Make the manifest version ``number``.  Another one of that number is an error unless ``again``."""
    jvm, folder = spark._jvm, _path(spark, table, "commits")
    draft = _path(spark, table, "commits", f"_{uuid.uuid4().hex}")
    files = _files(spark, folder)
    files.mkdirs(folder)
    stream = files.create(draft, False)
    try:
        stream.write(json.dumps(manifest).encode())
    finally:
        stream.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if again else kinds.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(
        files.makeQualified(draft), files.makeQualified(_path(spark, table, "commits", f"{number:020d}.json")), how
    )


def loose_files(spark: SparkSession, table: str) -> list[str]:
    """Names of files that lie in the folder of the table itself: no version holds them."""
    folder = _path(spark, table)
    files = _files(spark, folder)
    if not files.exists(folder):
        return []
    found = [s.getPath().getName() for s in files.listStatus(folder) if s.isFile()]
    return sorted(n for n in found if not n.startswith((".", "_")))


def new_folder(name: str) -> str:
    """A folder of the table that no other write uses, relative to the table."""
    return f"data/{name}/write={uuid.uuid4().hex}"


def forget(spark: SparkSession, table: str, keep: int) -> list[int]:
    """Remove all but the newest ``keep`` versions, and every folder that none of those names.

    Not while a reader of an old version or a writer is at work.  Gives the versions removed.
    """
    if keep < 1:
        raise ValueError("at least the newest version stays")
    found = numbers(spark, table)
    gone, stay = found[:-keep], found[-keep:]
    # The manifests go first: what only they name is then out of reach.
    for n in gone:
        path = _path(spark, table, "commits", f"{n:020d}.json")
        _files(spark, path).delete(path, False)
    named = {f for n in stay for f in read(spark, table, n).manifest["folders"]}
    folders = _path(spark, table, "data", "*", "write=*")
    for status in _files(spark, folders).globStatus(folders) or ():
        path = status.getPath()
        if f"data/{path.getParent().getName()}/{path.getName()}" not in named:
            _files(spark, path).delete(path, True)
    return gone
