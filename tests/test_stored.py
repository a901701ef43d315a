"""Stored tables follow the files that they are made from, and rounds leave no files behind."""

import os

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.sources.stored import Rounds, stored


def test_changed_file_is_read_again(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    made = []

    def build(d):
        made.append(1)
        return d.groupBy("w").count()

    for rows, want in (([("a",), ("a",), ("b",)], {"a": 2, "b": 1}), ([("a",), ("c",)], {"a": 1, "c": 1})):
        spark.createDataFrame(rows, "w string").coalesce(1).write.mode("overwrite").parquet(path)
        for _ in range(2):
            assert {r["w"]: r["count"] for r in stored(spark.read.parquet(path), "words", build).collect()} == want
    assert len(made) == 2
    one = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    data = spark.createDataFrame([("z",)] * 3, "w string").coalesce(1)
    data.write.parquet(f"{tmp_path}/other")
    other = next(f for f in os.listdir(f"{tmp_path}/other") if f.endswith(".parquet"))
    os.replace(f"{tmp_path}/other/{other}", f"{path}/{one}")  # the same name with other contents
    crc = f"{path}/.{one}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    spark.catalog.refreshByPath(path)
    assert {r["w"]: r["count"] for r in stored(spark.read.parquet(path), "words", build).collect()} == {"z": 3}


def test_index_follows_its_table(spark, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    for texts, want in ((["x y", "x"], {"x": 2, "y": 1}), (["y z"], {"y": 1, "z": 1})):
        spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
        index = R.term_index(spark.read.parquet(path), F.split("text", " "), "follows")
        assert {r["term"]: r["df"] for r in index.frequencies.collect()} == want


def test_rounds(spark, tmp_path):
    rounds = Rounds(spark)
    for i in range(3):
        df = rounds.keep("a", spark.range(i + 1))
    other = rounds.keep("b", df.select((F.col("id") * 2).alias("id")))
    rounds.close("b")
    assert sorted(r["id"] for r in other.collect()) == [0, 2, 4]
    assert [f for f in os.listdir(rounds.folder.removeprefix("file://")) if f.startswith("a-")] == []
