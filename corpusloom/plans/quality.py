"""Quality rules, validators and scores over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query

_ISSUES_SQL = f"""{CHUNKS_SQL}, i AS (
SELECT id, 'complexity' AS type, 'medium' AS severity FROM chunks WHERE complexity > 8 UNION ALL
SELECT id, 'coupling', 'low' FROM chunks WHERE len(dependencies) = 0 AND chunk_type <> 'configuration' UNION ALL
SELECT id, 'length', 'high' FROM chunks WHERE end_line > 40 UNION ALL
SELECT id, 'duplication', 'medium' FROM (SELECT id, words, count(*) OVER (PARTITION BY words) AS n FROM (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS words FROM chunks)) WHERE n > 1 AND len(words) > 0)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.issues(Q.with_duplicates(chunks(spark, sf_dir)), Q.DEFAULT_RULES)


@query(f"WITH {_ISSUES_SQL} SELECT id, type, severity FROM i")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(f"""WITH {_ISSUES_SQL} SELECT type, CAST(count(*) AS BIGINT) AS issues, CAST(count(*) FILTER (severity IN ('critical', 'high')) AS BIGINT) AS urgent, CASE WHEN count(*) > 100 THEN 'systematic' ELSE 'local' END AS scope FROM i GROUP BY type""")
def quality_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.recommendations(_issues(spark, sf_dir))


#: Dimension, base, weight (fixed values).
_DIM_SQL = """d AS (SELECT language, avg(complexity) AS c, avg(importance) AS i, avg(CASE WHEN len(dependencies) > 0 THEN 1.0 ELSE 0.0 END) AS deps, avg(CASE WHEN class_name IS NOT NULL OR function_name IS NOT NULL THEN 1.0 ELSE 0.0 END) AS named FROM chunks GROUP BY language),
n AS (SELECT language, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS med, count(DISTINCT chunks.id) AS chunks FROM i JOIN chunks USING (id) GROUP BY language),
s AS (SELECT d.language, greatest(0, 85 - CASE WHEN named < 0.8 THEN 10 ELSE 0 END) AS accuracy, greatest(0, 80 - CASE WHEN deps < 0.6 THEN 15 ELSE 0 END) AS completeness, greatest(0, 90 - CASE WHEN i < 0.7 THEN 20 ELSE 0 END) AS relevance, greatest(0, 80 - CASE WHEN c > 5 THEN 20 ELSE 0 END) AS clarity, coalesce(crit, 0) AS crit, coalesce(high, 0) AS high, coalesce(med, 0) AS med, coalesce(chunks, 1) AS chunks FROM d LEFT JOIN n ON d.language IS NOT DISTINCT FROM n.language)"""


@query(f"""WITH {_ISSUES_SQL}, {_DIM_SQL} SELECT language, round(CAST(accuracy AS DOUBLE), 4) AS accuracy, round(CAST(completeness AS DOUBLE), 4) AS completeness, round(CAST(relevance AS DOUBLE), 4) AS relevance, round(CAST(clarity AS DOUBLE), 4) AS clarity,
round(CAST(greatest(0, least(100, (accuracy * 0.25 + completeness * 0.2 + relevance * 0.15 + clarity * 0.1) / 0.7 - (15.0 * crit + 7.0 * high + 3.0 * med) / chunks)) AS DOUBLE), 4) AS score FROM s""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four dimensions and an overall score for each language; penalties are per chunk with issues."""
    return Q.scores(chunks(spark, sf_dir), _issues(spark, sf_dir), "language")


@query(f"""WITH {CHUNKS_SQL}, v AS (SELECT id, language, (length(content) - length(replace(content, '{{', ''))) = (length(content) - length(replace(content, '}}', ''))) AS balanced, NOT regexp_matches(content, '[ \\t]\\n') AS trimmed, length(content) BETWEEN 50 AND 20000 AS sized FROM chunks)
SELECT language, round(100.0 * avg(CASE WHEN balanced THEN 1 ELSE 0 END), 4) AS syntax, round(100.0 * avg(CASE WHEN trimmed THEN 1 ELSE 0 END), 4) AS style, round(100.0 * avg(CASE WHEN sized THEN 1 ELSE 0 END), 4) AS size, CAST(count(*) FILTER (balanced AND trimmed AND sized) AS BIGINT) AS passed FROM v GROUP BY language""")
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of chunks that pass three validators."""
    c = F.col("content")
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    v = chunks(spark, sf_dir).select("language", (count("{") == count("}")).alias("balanced"), (~c.rlike(r"[ \t]\n")).alias("trimmed"), F.length(c).between(50, 20000).alias("sized"))
    share = lambda n: F.round(100.0 * F.avg(F.col(n).cast("int")), 4)
    return v.groupBy("language").agg(share("balanced").alias("syntax"), share("trimmed").alias("style"), share("sized").alias("size"), F.count_if(F.col("balanced") & F.col("trimmed") & F.col("sized")).alias("passed"))


@query("""WITH l AS (SELECT DISTINCT doc_id, lang, md5(line) AS h FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20), n AS (SELECT h, count(*) AS docs FROM l GROUP BY h)
SELECT lang, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (docs > 1) AS BIGINT) AS shared_lines, round(count(*) FILTER (docs > 1) / CAST(count(*) AS DOUBLE), 6) AS duplication FROM l JOIN n USING (h) GROUP BY lang""")
def duplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") > 20).select("doc_id", "lang", F.md5("line").alias("h"))
    n = lines.groupBy("h").agg(F.count("*").alias("docs"))
    j = lines.join(n, "h")
    return j.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(F.col("docs") > 1).alias("shared_lines"), F.round(F.count_if(F.col("docs") > 1) / F.count("*"), 6).alias("duplication"))


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS BIGINT) AS with_mail, CAST(count(*) FILTER (regexp_matches(lower(text), 'password|secret|api[_-]?key|token')) AS BIGINT) AS with_secret, CAST(count(*) FILTER (regexp_matches(text, '[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}')) AS BIGINT) AS with_phone FROM documents GROUP BY lang""")
def security_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda c, p: F.count_if(F.col("text").rlike(p) if c is None else c.rlike(p))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), hit(None, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("with_mail"), hit(F.lower("text"), r"password|secret|api[_-]?key|token").alias("with_secret"), hit(None, r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}").alias("with_phone"))


@query(f"""WITH {CHUNKS_SQL}, m AS (SELECT framework, avg(CASE WHEN class_name IS NOT NULL THEN 1.0 ELSE 0 END) AS cls, avg(CASE WHEN function_name IS NOT NULL THEN 1.0 ELSE 0 END) AS fn, avg(complexity) AS c, avg(end_line) AS l, count(*) FILTER (chunk_type = 'interface') / CAST(count(*) AS DOUBLE) AS a FROM chunks GROUP BY framework)
SELECT framework, round(greatest(cls, fn), 6) AS naming, round(a, 6) AS abstractness, round(CAST(greatest(0, 100 - 5 * c - 0.5 * l) AS DOUBLE), 6) AS maintainability, round(CAST(greatest(0, 171 - 5.2 * ln(c) - 0.23 * ln(l)) AS DOUBLE), 6) AS maintainability_index FROM m""")
def maintainability(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    m = chunks(spark, sf_dir).groupBy("framework").agg(share(F.col("class_name").isNotNull()).alias("cls"), share(F.col("function_name").isNotNull()).alias("fn"), F.avg("complexity").alias("c"), F.avg("end_line").alias("l"), share(F.col("chunk_type") == "interface").alias("a"))
    return m.select("framework", F.round(F.greatest("cls", "fn"), 6).alias("naming"), F.round("a", 6).alias("abstractness"), F.round(F.greatest(F.lit(0.0), 100 - 5 * F.col("c") - 0.5 * F.col("l")), 6).alias("maintainability"), F.round(F.greatest(F.lit(0.0), 171 - 5.2 * F.log("c") - 0.23 * F.log("l")), 6).alias("maintainability_index"))


@query(f"""WITH {CHUNKS_SQL} SELECT id, round(complexity + importance, 6) AS weight FROM chunks WHERE complexity > 8 OR len(dependencies) > 10 ORDER BY weight DESC, chunk_idx LIMIT 50""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty heaviest components."""
    c = chunks(spark, sf_dir).where((F.col("complexity") > 8) | (F.size("dependencies") > 10)).withColumn("weight", F.round(F.col("complexity") + F.col("importance"), 6))
    return c.orderBy(F.desc("weight"), "chunk_idx").limit(50).select("id", "weight")


@query(f"""WITH {CHUNKS_SQL} SELECT a.id AS controller, b.id AS service FROM (SELECT * FROM chunks WHERE component_type = 'controller') a JOIN (SELECT *, row_number() OVER (PARTITION BY framework, dependencies[1] ORDER BY chunk_idx) AS n FROM chunks WHERE component_type = 'service' AND len(dependencies) > 0) b ON a.framework = b.framework AND a.dependencies[1] = b.dependencies[1] AND n <= 2""")
def related_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two services that share framework and first dependency with a controller."""
    c = chunks(spark, sf_dir).withColumn("dep", F.get("dependencies", 0)).where("dep IS NOT NULL")
    s = c.where("component_type = 'service'").withColumn("n", F.row_number().over(Window.partitionBy("framework", "dep").orderBy("chunk_idx"))).where("n <= 2")
    return c.where("component_type = 'controller'").select(F.col("id").alias("controller"), "framework", "dep").join(s.select(F.col("id").alias("service"), "framework", "dep"), ["framework", "dep"]).select("controller", "service")
