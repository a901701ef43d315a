"""What a file or a whole code base was like at a time: as-of joins and running totals over logs of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, order: list[str], period: Column, before: bool = False) -> DataFrame:
    """Each row of ``left`` with ``last``, a struct of the last row of ``right`` of its key that is not later than it.

    ``order`` are columns of ``right`` that break ties of ``time``, the greatest
    wins.  With ``before`` rows of the same time do not count.  Without such a
    row, and where key or time is null, ``last`` is null; no row of ``left`` is lost.

    Both sides are sorted together within a key and a period (``period`` is an
    expression over ``time``, such as its month, that never falls as time grows),
    and what a period's first rows miss comes from the last rows of the periods
    before, of which there is one each.  So a key that holds a third of all rows
    is spread over its periods.
    """
    row = F.struct(*[F.col(c) for c in right.columns])
    own = left.withColumn("period", period)
    events = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("period", period)
    side = F.lit(0 if not before else 1)
    a = events.select(key, "period", F.col(time).alias("at"), side.alias("side"), F.struct(*order).alias("tie"), row.alias("event"), F.lit(None).cast(own.schema).alias("asked"))
    b = own.select(key, "period", F.col(time).alias("at"), F.lit(1 if not before else 0).alias("side"), F.lit(None).cast(a.schema["tie"].dataType).alias("tie"), F.lit(None).cast(a.schema["event"].dataType).alias("event"), F.struct(*own.columns).alias("asked"))
    # questions of a key or time that is missing meet nothing and need not be sorted
    known = b.where(F.col(key).isNotNull() & F.col("at").isNotNull())
    unknown = b.where(F.col(key).isNull() | F.col("at").isNull()).select("asked", F.col("event").alias("inside"), F.col("event").alias("earlier"))
    within = Window.partitionBy(key, "period").orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(known).withColumn("inside", F.last("event", ignorenulls=True).over(within)).where("asked IS NOT NULL")
    lasts = events.groupBy(key, "period").agg(F.max_by(row, F.struct(F.col(time), *order)).alias("event"))
    # each period's last row serves all later periods that ask
    asked = own.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, "period").distinct().withColumn("event", F.lit(None).cast(a.schema["event"].dataType)).withColumn("asks", F.lit(True))
    periods = lasts.withColumn("asks", F.lit(False)).unionByName(asked)
    prior = Window.partitionBy(key).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    periods = periods.withColumn("rank", F.dense_rank().over(Window.partitionBy(key).orderBy("period"))).withColumn("earlier", F.last("event", ignorenulls=True).over(prior)).where("asks").select(key, "period", "earlier")
    out = seen.select(key, "period", "asked", "inside").join(periods, [key, "period"], "left").select("asked", "inside", "earlier").unionByName(unknown)
    return out.select(*[F.col("asked")[c].alias(c) for c in left.columns], F.coalesce("inside", "earlier").alias("last"))


def commit_totals(changes: DataFrame, day: Column) -> DataFrame:
    """(hash, date, changed_files, files, lines) of each commit of changes (hash, date, path, additions, deletions).

    ``files`` are the paths that have been changed up to the commit, ``lines``
    the additions less the deletions of all changes up to it; commits of one date
    follow each other by hash.  Running totals are those of a day's commits plus
    those of all days before, one row for each day.
    """
    first = changes.groupBy("path").agg(F.min(F.struct("date", "hash")).alias("c")).groupBy("c.date", "c.hash").agg(F.count("*").alias("new_files"))
    each = changes.groupBy("hash", "date").agg(F.countDistinct("path").alias("changed_files"), F.sum(F.col("additions") - F.col("deletions")).alias("net")).join(first, ["date", "hash"], "left")
    each = each.select("hash", "date", day.alias("day"), "changed_files", F.coalesce("new_files", F.lit(0)).alias("new_files"), "net")
    days = each.groupBy("day").agg(F.sum("new_files").alias("f"), F.sum("net").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    inside = Window.partitionBy("day").orderBy("date", "hash").rowsBetween(Window.unboundedPreceding, 0)
    out = each.withColumns({"files": F.sum("new_files").over(inside), "lines": F.sum("net").over(inside)}).join(days, "day")
    return out.select("hash", "date", "changed_files", (F.col("files") + F.col("f")).alias("files"), (F.col("lines") + F.col("n")).alias("lines"))


def file_versions(changes: DataFrame) -> DataFrame:
    """(path, hash, date, author, version, lines, previous_hash, days) of each change: its number, the file's lines after it, and the change before."""
    each = changes.groupBy("path", "hash", "date", "author").agg(F.sum(F.col("additions") - F.col("deletions")).alias("net"))
    order = Window.partitionBy("path").orderBy("date", "hash")
    previous = F.lag(F.struct("hash", "date")).over(order)
    rows = each.withColumns({"version": F.row_number().over(order), "lines": F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, 0)), "previous": previous})
    return rows.select("path", "hash", "date", "author", "version", "lines", F.col("previous.hash").alias("previous_hash"), F.datediff("date", F.col("previous.date")).alias("days"))


#: Header of a porcelain blame entry, and the entries of it that are kept (fixed values).
_BLAME = r"^([0-9a-f]{40}) (\d+) (\d+)"
_BLAME_FIELDS = {"author": "author", "author_time": "author-time", "summary": "summary"}


def blame_lines(texts: DataFrame) -> DataFrame:
    """(path, line, hash, author, author_time, summary, content) of porcelain blame texts (path, value).

    A line of the file begins with a tab; the header before it names its commit
    and its number.  What is known of a commit stands only where it is first
    named and holds for its other lines.  Lines outside of an entry are left out.
    """
    rows = texts.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "row"))
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("row").rlike(_BLAME), F.struct(F.regexp_extract("row", _BLAME, 1).alias("hash"), F.regexp_extract("row", _BLAME, 3).cast("int").alias("line")))
    rows = rows.withColumn("head", F.last(head, ignorenulls=True).over(upto)).where("head IS NOT NULL")
    value = lambda name: F.max(F.when(F.col("row").startswith(name + " "), F.substring("row", len(name) + 2, 1 << 30)))
    about = rows.where(~F.col("row").startswith("\t")).groupBy("path", F.col("head.hash").alias("hash")).agg(*[value(v).alias(k) for k, v in _BLAME_FIELDS.items()])
    lines = rows.where(F.col("row").startswith("\t")).select("path", F.col("head.line").alias("line"), F.col("head.hash").alias("hash"), F.substring("row", 2, 1 << 30).alias("content"))
    return lines.join(about, ["path", "hash"], "left").select("path", "line", "hash", "author", F.timestamp_seconds(F.col("author_time").cast("long")).alias("author_time"), "summary", "content")


def status_entries(texts: DataFrame) -> DataFrame:
    """(repository, path, old_path, state) of porcelain status texts (repository, value): staged, unstaged, untracked or both kinds of change of a path."""
    rows = texts.select("repository", F.explode(F.split("value", "\n")).alias("row")).where(F.length("row") > 3)
    x, y, rest = F.substring("row", 1, 1), F.substring("row", 2, 1), F.substring("row", 4, 1 << 30)
    states = F.when(F.substring("row", 1, 2) == "??", F.array(F.lit("untracked"))).otherwise(F.array_compact(F.array(F.when(x != " ", "staged"), F.when(y != " ", "unstaged"))))
    moved = F.contains(rest, F.lit(" -> "))
    return rows.select("repository", F.when(moved, F.substring_index(rest, " -> ", -1)).otherwise(rest).alias("path"), F.when(moved, F.substring_index(rest, " -> ", 1)).alias("old_path"), F.explode(states).alias("state"))
