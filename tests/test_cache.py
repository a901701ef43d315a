"""Expiring entries over two triggers, and results that are computed once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import cache as C

T0 = datetime(2024, 1, 1, 10)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, C.STATE_STORE)
    yield
    spark.conf.set(name, before)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_entries_expire(spark, store, tmp_path):
    batches = [[("a", at(0)), ("a", at(59)), ("b", at(30)), (None, at(1)), ("c", None)], [("a", at(61)), ("a", at(120)), ("b", at(89)), ("b", at(91))], [("a", at(300)), ("b", at(10_000))], [("a", at(10_001))]]
    folder = f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("key string, ts timestamp").parquet(folder)
        q = C.cached_requests(stream, "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        assert q.exception() is None
    got = {(r["key"], r["ts"]): (r["hit"], r["refreshed"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("a", at(0)): (False, at(0)), ("a", at(59)): (True, at(0)), ("b", at(30)): (False, at(30)), ("a", at(61)): (False, at(61)), ("a", at(120)): (True, at(61)), ("b", at(89)): (True, at(30)), ("b", at(91)): (False, at(91)),
        ("a", at(300)): (False, at(300)), ("b", at(10_000)): (False, at(10_000)), ("a", at(10_001)): (False, at(10_001)),
    }
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_due(spark):
    rows = [(None, at(0)), (at(0), at(1439)), (at(0), at(1440)), (at(0), at(9000))]
    got = spark.createDataFrame(rows, "last timestamp, now timestamp").select(C.is_due(F.col("last"), F.col("now"))).collect()
    assert [r[0] for r in got] == [True, False, True, True]


def test_remembered(spark, tmp_path):
    seen = []

    def compute(new):
        seen.append(sorted(map(str, (r["path"] for r in new.select("path").collect()))))
        return new.select("path", "lines", F.upper("text").alias("enriched"))

    frame = lambda rows: spark.createDataFrame(rows, "path string, lines string, text string")
    first = C.remembered(frame([("a", "1-5", "x"), ("a", "1-5", "x"), ("b", "1-9", "y"), (None, "1", "n")]), ["path", "lines"], compute, f"{tmp_path}/c")
    assert sorted(map(tuple, first.collect()), key=str) == sorted([("a", "1-5", "X"), ("b", "1-9", "Y"), (None, "1", "N")], key=str)

    def broken(new):
        raise ValueError

    with pytest.raises(ValueError):
        C.remembered(frame([("z", "1", "q")]), ["path", "lines"], broken, f"{tmp_path}/c")
    again = C.remembered(frame([("a", "1-5", "changed"), ("a", "6-7", "z"), (None, "1", "m")]), ["path", "lines"], compute, f"{tmp_path}/c")
    assert {tuple(r) for r in again.collect()} == {("a", "1-5", "X"), ("b", "1-9", "Y"), (None, "1", "N"), ("a", "6-7", "Z")}
    assert seen == [["None", "a", "b"], ["a"]]
