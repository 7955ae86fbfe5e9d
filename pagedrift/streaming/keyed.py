"""The same diff with keyed streaming state instead of a state table.

Cleaning and materiality are native columns before and after the stateful step; the Python
part only looks records up by id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.policy import snapshot_valid
from ..functions.text import clean_text, promos_hash
from ..operators.diff import mark_material
from ..schemas import FIELDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIDES = ("previous", "current")
OUTPUT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("change_type", T.StringType()),
        *[T.StructField(f"{side}_{f}", T.StringType()) for side in SIDES for f in FIELDS],
    ]
)
#: Pages meet in so many groups: the cost of a group, its calls and its timer is not paid for each page.
PARTS = 4_096
#: A page with up to so many records keeps them in its own entry.
TOGETHER = 16
#: Entries are looked up one by one if they are few; else by a scan that passes at most so many for each.
FEW, PASSED = 8, 20
URL = T.StructType([T.StructField("url", T.StringType())])
# Of a page: time and hash of its last snapshot, when it counts as unseen, and its records, or the ids of them in order.
PAGE = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("due", T.LongType()),
        T.StructField("promos", T.StringType()),
        T.StructField("ids", T.StringType()),
    ]
)
# Of an id of a page with many: the records that have it, in order; nearly always one.
RECORD_ID = T.StructType([T.StructField("url", T.StringType()), T.StructField("id", T.StringType())])
RECORDS = T.StructType([T.StructField("records", T.StringType())])
TOLD = T.StructType([T.StructField("until", T.LongType())])
UNSEEN = "unseen"


class ChangeTracker(StatefulProcessor):
    """Keeps the records of the urls of a part, and emits their changes.

    A snapshot writes the entry of its page and, of a page with many records, those that differ from the
    stored ones, and no others.  Of the snapshots of one micro-batch the newest counts; it is found while the
    chunks pass, so memory holds one snapshot for each url of the part, whatever the number of rows of a url.

    ``unseen_ms``: a url without a snapshot for so long is reported, once, as ``unseen``.  Time is that
    of the snapshots, or the clock if ``ttl_ms`` is set, which forgets a url after so long.
    """

    def __init__(self, ttl_ms: int | None = None, unseen_ms: int | None = None):
        self._ttl_ms, self._unseen_ms = ttl_ms, unseen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pages = handle.getMapState("pages", URL, PAGE, self._ttl_ms)
        self._records = handle.getMapState("records", RECORD_ID, RECORDS, self._ttl_ms)
        self._told = handle.getValueState("told", TOLD)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        newest: dict[str | None, tuple[int, str, str]] = {}
        for chunk in rows:
            for url, *row in zip(*[chunk[c].tolist() for c in ("url", "ts", "hash", "promos")]):
                held = newest.get(url)
                if held is None or tuple(row[:2]) > held[:2]:
                    newest[url] = tuple(row)
        known = _look_up(self._pages, [(url,) for url in newest])
        changes: list[tuple] = []
        first_due: int | None = None
        for url, (ts, hash_, text) in newest.items():
            page = known.get((url,))
            if page is not None and ts < page[0]:
                continue
            due = self._due(ts, timerValues)
            first_due = due if first_due is None else min(first_due, due)
            if page is not None and page[1] == hash_:
                self._pages.updateValue((url,), (ts, hash_, due, page[3], page[4]))
                continue
            current = json.loads(text)
            previous = self._previous(url, page)
            # What a page keeps for so long ends as a whole.
            together = len(current) <= TOGETHER or self._ttl_ms is not None
            ids = None if together else json.dumps([p["id"] for p in current])
            self._pages.updateValue((url,), (ts, hash_, due, text if together else None, ids))
            self._store(
                url, {} if page is None or page[4] is None else _by_id(previous), {} if together else _by_id(current)
            )
            if page is not None:
                changes.extend(_diff(url, previous, current))
        if first_due is not None:
            self._wait_until(first_due)
        if changes:
            yield pd.DataFrame(changes, columns=OUTPUT.names)

    def _previous(self, url: str | None, page: tuple | None) -> list[dict]:
        """The records of the stored snapshot, in order."""
        if page is None:
            return []
        if page[3] is not None:
            return json.loads(page[3])
        ids = json.loads(page[4])
        stored = _look_up(self._records, [(url, i) for i in dict.fromkeys(ids)])
        left = {i: iter(json.loads(text)) for (_, i), (text,) in stored.items()}
        return [next(left[i]) | {"id": i} for i in ids]

    def _store(self, url: str | None, stored: dict[str, str], current: dict[str, str]) -> None:
        """Write the records that are new or differ, remove those that are gone."""
        for i, text in current.items():
            if stored.get(i) != text:
                self._records.updateValue((url, i), (text,))
        for i in stored.keys() - current.keys():
            self._records.removeKey((url, i))

    def _now(self, timerValues: Any) -> int:
        if self._ttl_ms is None:
            return timerValues.getCurrentWatermarkInMs()
        return timerValues.getCurrentProcessingTimeInMs()

    def _due(self, ts: int, timerValues: Any) -> int:
        """When a url seen at ``ts`` counts as unseen."""
        if self._unseen_ms is None:
            return 0
        return (ts // 1000 if self._ttl_ms is None else self._now(timerValues)) + self._unseen_ms

    def _wait_until(self, due: int) -> None:
        """One timer for a part, not later than the first of its pages is due."""
        if self._unseen_ms is None:
            return
        timers = list(self._handle.listTimers())
        if timers and min(timers) <= due:
            return
        for old in timers:
            self._handle.deleteTimer(old)
        self._handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        told = self._told.get()
        told = -1 if told is None else told[0]
        missing, waiting = [], None
        for (url,), page in self._pages.iterator():
            due = page[2]
            if due > now:
                waiting = due if waiting is None else min(waiting, due)
            elif due > told:
                missing.append((url, None, None, UNSEEN, *[None] * (len(OUTPUT.names) - 4)))
        self._told.update((now,))
        if waiting is not None:
            self._handle.registerTimer(waiting)
        if missing:
            frame = pd.DataFrame(missing, columns=OUTPUT.names)
            frame["pos"] = frame["pos"].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def _look_up(state: Any, keys: list[tuple]) -> dict[tuple, tuple]:
    """The entries of those keys that are in a map.

    An entry that a scan passes costs far less than one that is asked for; so many are found by a scan, as far
    as that pays, and a few keys never read the whole map.
    """
    found: dict[tuple, tuple] = {}
    if len(keys) > FEW:
        wanted, passed = set(keys), 0
        for k, v in state.iterator():
            if tuple(k) in wanted:
                found[tuple(k)] = tuple(v)
            passed += 1
            if passed == PASSED * len(keys):
                break
        else:
            return found
    for k in keys:
        if k not in found:
            v = state.getValue(k)
            if v is not None:
                found[k] = tuple(v)
    return found


def _by_id(promos: list[dict]) -> dict[str, str]:
    """The records of each id, as they are stored."""
    records: dict[str, list[dict]] = {}
    for promo in promos:
        records.setdefault(promo["id"], []).append({k: v for k, v in promo.items() if k != "id"})
    return {i: json.dumps(r) for i, r in records.items()}


def _diff(url: str, previous: list[dict], current: list[dict]) -> list[tuple]:
    last = {p["id"]: p for p in previous}
    now = {p["id"] for p in current}

    def values(promo: dict | None) -> list:
        return [promo.get(f) if promo else None for f in FIELDS]

    found = []
    for pos, promo in enumerate(current):
        old = last.get(promo["id"])
        if old is None or old["clean"] != promo["clean"]:
            kind = "added" if old is None else "changed"
            found.append((url, promo["id"], pos, kind, *values(old), *values(promo)))
    for pos, promo in enumerate(previous):
        if promo["id"] not in now:
            found.append((url, promo["id"], pos, "removed", *values(promo), *values(None)))
    return found


def stream_changes(
    snapshots: DataFrame, ttl_ms: int | None = None, unseen_ms: int | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Material change rows of a stream of snapshots (url, ts, promos).

    ``ttl_ms``: forget a url that has not been seen for so long (processing time; default: never).
    ``unseen_ms``: also a row ``unseen`` for a url without a snapshot for so long, once until it is
    seen again; in the time of the snapshots, which may come late by ``delay`` (older ones are
    left out), or by the clock together with ``ttl_ms``.
    """
    spark: SparkSession = snapshots.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cleaned = F.transform(
        "promos",
        lambda p: F.struct(
            p["id"].alias("id"),
            *[p[f].alias(f) for f in FIELDS],
            F.sha2(
                F.to_json(F.transform(F.array(*[p[f] for f in FIELDS]), clean_text)), 256
            ).alias("clean"),
        ),
    )
    valid = snapshot_valid(promos_hash(F.col("promos")), F.col("ts").cast("string"), F.col("promos"))
    event_time = unseen_ms is not None and ttl_ms is None
    timed = snapshots.withColumn("__at", F.col("ts").cast("timestamp")).where(valid)
    timed = timed.withWatermark("__at", delay) if event_time else timed
    rows = timed.select(
        "url",
        *(["__at"] if event_time else []),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        promos_hash(F.col("promos")).alias("hash"),
        F.to_json(cleaned).alias("promos"),
        F.pmod(F.xxhash64("url"), F.lit(PARTS)).alias("part"),
    )
    tracked = rows.groupBy("part").transformWithStateInPandas(
        statefulProcessor=ChangeTracker(ttl_ms, unseen_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="EventTime" if event_time else "None" if ttl_ms is None else "ProcessingTime",
    )

    def side(name: str):
        none = F.col("change_type").isin(UNSEEN, "added" if name == "previous" else "removed")
        record = F.struct(*[F.col(f"{name}_{f}").alias(f) for f in FIELDS])
        return F.when(~none, record).alias(name)

    changes = tracked.select("url", "id", "pos", "change_type", side("previous"), side("current"))
    return mark_material(changes).where(F.col("material") | (F.col("change_type") == UNSEEN)).drop("material")
