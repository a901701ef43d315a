from pyspark.sql import functions as F

from corpusloom.streaming.changes import file_events, maintain_index, windowed_counts


def test_index_follows_the_stream(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "path string, content_hash string, seen long"
    for k, rows in enumerate([[("a", "1", 1), ("b", "2", 1)], [("a", "9", 3), ("a", "8", 2), ("c", "3", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        maintain_index(file_events(spark, folder, schema), spark, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/index/version={k}").select("path", "content_hash").collect()}
        assert got == ([{("a", "1"), ("b", "2")}, {("a", "9"), ("b", "2"), ("c", "3")}][k])


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 01:20:00", "y")]
    spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind").write.parquet(f"{tmp_path}/e")
    stream = windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/e"), "ts", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["kind"], r["n"]) for r in spark.table("windowed").collect()} == {("x", 2), ("y", 1)}
