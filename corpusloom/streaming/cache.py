"""Caches whose entries expire, over streams and over stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWER = "key string, ts timestamp, hit boolean, refreshed timestamp"
#: The store that timers and expiring state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ExpiringEntries(StatefulProcessor):
    """One entry for each key: the time at which it was made anew, dropped by a timer once no later request can use it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made = self.made.get()[0] if self.made.exists() else None
        begun = made
        asked = pd.concat(list(rows)).sort_values("ts", kind="stable")
        hits, refreshed = [], []
        for ms in asked["ts"].astype("datetime64[ms]").astype("int64"):
            hit = made is not None and 0 <= ms - made < self.ttl_ms
            if not hit and (made is None or ms > made):
                made = ms
            hits.append(hit)
            refreshed.append(made)
        if made is not None and made != begun:
            self.made.update((made,))
            if begun is not None:
                self.handle.deleteTimer(begun + self.ttl_ms)
            self.handle.registerTimer(made + self.ttl_ms)
        yield pd.DataFrame({"key": key[0], "ts": asked["ts"].to_numpy(), "hit": hits, "refreshed": pd.to_datetime(refreshed, unit="ms")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.made.exists() and self.made.get()[0] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.made.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached_requests(requests: DataFrame, ttl: str, late: str = "10 minutes") -> DataFrame:
    """(key, ts, hit, refreshed) of a stream of requests (key, ts): whether the key's entry was made less than ``ttl`` before, else it is made anew.

    ``refreshed`` is when the entry that answers was made.  Requests of one batch
    are answered in order of their time, batches as they come; a request older
    than the entry neither uses nor changes it, and one later than ``late`` behind
    the newest is dropped by the watermark.  An entry leaves the state once the
    watermark has passed its end.  Requests without key or time are left out.
    A batch of a key is held in memory: triggers bound it
    (``maxFilesPerTrigger``).  The session's state store has to be ``STATE_STORE``.
    """
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    known = requests.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return known.groupBy("key").transformWithStateInPandas(ExpiringEntries(ms), ANSWER, "Append", "EventTime")


def is_due(last: Column, now: Column, every: str = "24 hours") -> Column:
    """Whether what was done ``last`` (null: never) is to be done again."""
    return F.coalesce(now - last >= F.expr(f"INTERVAL '{every.split()[0]}' {every.split()[1]}"), F.lit(True))


def remembered(rows: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """``compute(rows)``, which gives the keys and some more columns, of which only keys that ``folder`` does not hold yet are computed.

    New results are written beside the earlier ones, each call in a folder of its
    own, whose name holds until its job has ended; a call that fails leaves
    nothing that later calls read.  Rows that agree in the keys are computed once.
    Keys with null are as good as others.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in system.listStatus(at)] if system.exists(at) else []
    done = [str(p) for p in parts if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    known = spark.read.parquet(*done) if done else None
    wanted = rows.dropDuplicates(keys)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    if known is not None:
        held = known.select(*keys)
        wanted = wanted.join(held, same(wanted, held), "left_anti")
    path = f"{folder}/{uuid.uuid4().hex}"
    compute(wanted).write.parquet(path)
    fresh = spark.read.parquet(path)
    return fresh if known is None else known.select(*fresh.columns).unionByName(fresh)
