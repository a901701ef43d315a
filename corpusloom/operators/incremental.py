"""Change detection between snapshots, bounded logs and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_path, change) between snapshots (path, content_hash).

    A new path with the content of a vanished one is moved from the first such
    path; one vanished path may have moved to several.
    """
    o, n = old.select("path", F.col("content_hash").alias("old_hash")), new.select("path", F.col("content_hash").alias("new_hash"))
    both = o.join(n, "path", "full_outer")
    fresh = both.where("old_hash IS NULL").select("path", F.col("new_hash").alias("hash"))
    gone = both.where("new_hash IS NULL").select(F.col("path").alias("old_path"), F.col("old_hash").alias("hash"))
    first = gone.groupBy("hash").agg(F.min("old_path").alias("old_path"))
    placed = fresh.join(first, "hash", "left").select("path", "old_path", F.when(F.col("old_path").isNotNull(), "moved").otherwise("added").alias("change"))
    sources = placed.where("change = 'moved'").select("old_path").distinct()
    deleted = gone.join(sources, "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("deleted").alias("change"))
    modified = both.where("old_hash <> new_hash").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("change"))
    return placed.unionByName(deleted).unionByName(modified)


def apply_changes(index: DataFrame, found: DataFrame, new: DataFrame) -> DataFrame:
    """The index after deletes, moves and upserts; ``index`` and ``new`` have a path and equal columns."""
    touched = found.select(F.coalesce("old_path", "path").alias("path")).unionByName(found.select("path")).distinct()
    kept = index.join(touched, "path", "left_anti")
    upserts = new.join(found.where("change <> 'deleted'").select("path"), "path", "left_semi")
    return kept.unionByName(upserts.select(*kept.columns))


def last_n(df: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def within_window(df: DataFrame, key: str, ts: str, milliseconds: int) -> DataFrame:
    """Adds in_window: rows of the key in the window that ends with each row."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(ms).rangeBetween(-(milliseconds - 1), 0)
    return df.withColumn("in_window", F.count("*").over(w))
