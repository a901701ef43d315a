"""Snapshots, logs, windows over time and version history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.incremental import changes, last_n, within_window
from ..sources.stored import deal_by_size
from ..sources.tables import table
from .registry import query


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 10
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    old = d.where(m != 0).select(path.alias("path"), F.md5("text").alias("content_hash"), F.col("n_chars").alias("size"))
    text = F.when(m == 2, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    new = d.where(m != 1).select(F.when(m == 3, F.concat(F.lit("moved/"), path)).otherwise(path).alias("path"), F.md5(text).alias("content_hash"), F.length(text).cast("long").alias("size"))
    return old, new


_SNAP_SQL = """o AS (SELECT source || '/' || doc_id AS path, md5(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' ELSE '' END || source || '/' || doc_id AS path, md5(CASE WHEN doc_id % 10 = 2 THEN text || ' changed' ELSE text END) AS content_hash FROM documents WHERE doc_id % 10 <> 1),
gone AS (SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)), fresh AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM o)),
mv AS (SELECT f.path, min(g.path) AS old_path FROM fresh f JOIN gone g USING (content_hash) GROUP BY f.path)"""


@query(f"""WITH {_SNAP_SQL} SELECT path, old_path, 'moved' AS change FROM mv UNION ALL SELECT path, NULL, 'added' FROM fresh WHERE path NOT IN (SELECT path FROM mv)
UNION ALL SELECT path, NULL, 'deleted' FROM gone WHERE path NOT IN (SELECT old_path FROM mv) UNION ALL SELECT n.path, NULL, 'modified' FROM n JOIN o USING (path) WHERE n.content_hash <> o.content_hash""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, modified, moved and deleted paths between two snapshots."""
    return changes(*_snapshots(spark, sf_dir))


@query(f"""WITH {_SNAP_SQL} SELECT change, CAST(count(*) AS BIGINT) AS files FROM (SELECT 'moved' AS change FROM mv UNION ALL SELECT 'added' FROM fresh WHERE path NOT IN (SELECT path FROM mv)
UNION ALL SELECT 'deleted' FROM gone WHERE path NOT IN (SELECT old_path FROM mv) UNION ALL SELECT 'modified' FROM n JOIN o USING (path) WHERE n.content_hash <> o.content_hash) GROUP BY change""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(*_snapshots(spark, sf_dir)).groupBy("change").agg(F.count("*").alias("files"))


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100""")
def bounded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred entries of each kind."""
    return last_n(table(spark, sf_dir, "events"), "event_type", 100, ["ts", "event_id"]).select("event_id", "event_type")


@query("""SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) > 2 AS rejected FROM events""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user within a sliding hour, and whether they pass a limit of two."""
    e = within_window(table(spark, sf_dir, "events"), "user_id", "ts", 3_600_000)
    return e.select("event_id", "user_id", "in_window", (F.col("in_window") > 2).alias("rejected"))


@query("""SELECT event_type AS model, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS cost, round(avg(value), 6) AS mean_latency, round(count(*) FILTER (event_type <> 'error') / CAST(count(*) AS DOUBLE), 6) AS success_rate
FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type""")
def usage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost, latency and success since a given time."""
    e = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    ok = F.avg((F.col("event_type") != "error").cast("double"))
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.avg("value"), 6).alias("mean_latency"), F.round(ok, 6).alias("success_rate"))


_COMMITS_SQL = "c AS (SELECT o_orderkey AS hash, o_custkey AS author, o_orderdate AS date, l_partkey AS path, CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    return o.join(li, "hash")


@query(f"""WITH {_COMMITS_SQL} SELECT CAST(count(DISTINCT hash) AS BIGINT) AS commits, CAST(count(DISTINCT author) AS BIGINT) AS authors, CAST(count(DISTINCT path) AS BIGINT) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
round(sum(additions + deletions) / CAST(count(DISTINCT hash) AS DOUBLE), 6) AS mean_commit_size FROM c""")
def evolution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir)
    return c.agg(F.countDistinct("hash").alias("commits"), F.countDistinct("author").alias("authors"), F.countDistinct("path").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.round(F.sum(F.col("additions") + F.col("deletions")) / F.countDistinct("hash"), 6).alias("mean_commit_size"))


_RISK_SQL = "CASE WHEN changes > 20 THEN 2 WHEN changes > 10 THEN 1 ELSE 0 END + CASE WHEN authors > 5 THEN 2 WHEN authors > 2 THEN 1 ELSE 0 END"


@query(f"""WITH {_COMMITS_SQL}, f AS (SELECT path, count(*) AS changes, count(DISTINCT author) AS authors, max(date) AS last_change FROM c GROUP BY path)
SELECT path, CAST(changes AS BIGINT) AS changes, CAST(authors AS BIGINT) AS authors, strftime(last_change, '%Y-%m-%d') AS last_change, CASE WHEN {_RISK_SQL} >= 4 THEN 'high' WHEN {_RISK_SQL} >= 2 THEN 'medium' ELSE 'low' END AS risk FROM f ORDER BY changes DESC, path LIMIT 20""")
def file_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most changed files with a risk class."""
    f = _commits(spark, sf_dir).groupBy("path").agg(F.count("*").alias("changes"), F.countDistinct("author").alias("authors"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_change"))
    risk = F.when(F.col("changes") > 20, 2).when(F.col("changes") > 10, 1).otherwise(0) + F.when(F.col("authors") > 5, 2).when(F.col("authors") > 2, 1).otherwise(0)
    return f.withColumn("risk", F.when(risk >= 4, "high").when(risk >= 2, "medium").otherwise("low")).orderBy(F.desc("changes"), "path").limit(20)


@query(f"""WITH {_COMMITS_SQL} SELECT strftime(date, '%Y-%m') AS month, CAST(count(DISTINCT hash) AS BIGINT) AS commits, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(count(DISTINCT path) AS BIGINT) AS files, CAST(count(DISTINCT author) AS BIGINT) AS authors FROM c GROUP BY 1""")
def evolution_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir).groupBy(F.date_format("date", "yyyy-MM").alias("month"))
    return c.agg(F.countDistinct("hash").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.countDistinct("path").alias("files"), F.countDistinct("author").alias("authors"))


@query(f"""WITH {_COMMITS_SQL}, a AS (SELECT max(date) AS as_of FROM c), f AS (SELECT path, count(*) AS n, count(DISTINCT author) AS contributors, date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) AS days, count(*) FILTER (date >= as_of - INTERVAL 30 DAY) AS recent FROM c CROSS JOIN a GROUP BY path)
SELECT path, CAST(contributors AS BIGINT) AS contributors, round(n / CAST(greatest(days, 1) AS DOUBLE), 6) AS churn, round(CAST(greatest(0, 1 - recent / 10.0) AS DOUBLE), 6) AS stability FROM f""")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn per day and stability over the last thirty days of the log."""
    c = _commits(spark, sf_dir)
    as_of = F.broadcast(c.agg(F.max("date").alias("as_of")))  # one row
    f = c.crossJoin(as_of).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("author").alias("contributors"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.count_if(F.col("date") >= F.col("as_of") - F.expr("INTERVAL 30 DAYS")).alias("recent"))
    return f.select("path", "contributors", F.round(F.col("n") / F.greatest("days", F.lit(1)), 6).alias("churn"), F.round(F.greatest(F.lit(0.0), 1 - F.col("recent") / 10.0), 6).alias("stability"))


@query("""WITH m(model, quality, price, speed) AS (VALUES ('click', 0.6, 0.2, 0.9), ('view', 0.5, 0.1, 1.0), ('purchase', 0.9, 0.8, 0.5), ('signup', 0.7, 0.4, 0.6), ('error', 0.1, 0.1, 0.1)),
u AS (SELECT user_id, event_type AS model, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, model, round(CAST(0.4 * quality + 0.3 * (1 - price) + 0.3 * speed + 0.001 * n AS DOUBLE), 6) AS score FROM u JOIN m USING (model))
SELECT user_id, model, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, model) AS rn FROM s) WHERE rn = 1""")
def select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with the best weighted quality, price and speed among those that a user has used."""
    rows = [("click", 0.6, 0.2, 0.9), ("view", 0.5, 0.1, 1.0), ("purchase", 0.9, 0.8, 0.5), ("signup", 0.7, 0.4, 0.6), ("error", 0.1, 0.1, 0.1)]
    m = F.broadcast(spark.createDataFrame(rows, "model string, quality double, price double, speed double"))  # five rows
    u = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("model")).agg(F.count("*").alias("n"))
    s = u.join(m, "model").withColumn("score", F.round(0.4 * F.col("quality") + 0.3 * (1 - F.col("price")) + 0.3 * F.col("speed") + 0.001 * F.col("n"), 6))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "model"))).where("rn = 1").select("user_id", "model", "score")


@query(f"""WITH {_COMMITS_SQL}, f AS (SELECT path, min((date, hash)) AS first FROM c GROUP BY path),
e AS (SELECT hash, date, count(DISTINCT path) AS changed_files, sum(additions - deletions) AS net FROM c GROUP BY ALL),
n AS (SELECT e.*, (SELECT count(*) FROM f WHERE f.first = (e.date, e.hash)) AS new_files FROM e)
SELECT hash, date, CAST(changed_files AS BIGINT) AS changed_files, CAST(sum(new_files) OVER w AS BIGINT) AS files, CAST(sum(net) OVER w AS BIGINT) AS lines FROM n WINDOW w AS (ORDER BY date, hash)""")
def totals_at_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines of the whole code base at every commit."""
    c = _commits(spark, sf_dir)
    deal_by_size(c)
    return H.commit_totals(c, F.to_date("date"))


@query(f"""WITH {_COMMITS_SQL}, e AS (SELECT path, hash, date, author, sum(additions - deletions) AS net FROM c GROUP BY ALL)
SELECT path, hash, date, author, CAST(row_number() OVER w AS INTEGER) AS version, CAST(sum(net) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lines, lag(hash) OVER w AS previous_hash, CAST(date_diff('day', CAST(lag(date) OVER w AS DATE), CAST(date AS DATE)) AS INTEGER) AS days FROM e WINDOW w AS (PARTITION BY path ORDER BY date, hash)""")
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every file."""
    return H.file_versions(_commits(spark, sf_dir))


@query(f"""WITH {_COMMITS_SQL}, l AS (SELECT path, date, max(hash) AS hash FROM c GROUP BY ALL), q AS (SELECT l_orderkey, l_linenumber, l_partkey AS path, l_shipdate AS date FROM lineitem)
SELECT q.l_orderkey, q.l_linenumber, q.path, l.hash, l.date, o_custkey AS author FROM q ASOF LEFT JOIN l ON q.path = l.path AND q.date >= l.date LEFT JOIN orders ON o_orderkey = l.hash""")
def last_changes_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who changed the part of each line item last by its ship date, and when."""
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("date"))
    versions = _commits(spark, sf_dir).select("path", "date", "hash", "author").distinct()
    deal_by_size(asked, versions)
    found = H.as_of(asked, versions, "path", "date", ["hash"], F.date_trunc("year", "date"))
    return found.select("l_orderkey", "l_linenumber", "path", F.col("last.hash").alias("hash"), F.col("last.date").alias("date"), F.col("last.author").alias("author"))
