"""Chunk trees, neighbours, relevance and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hierarchy as H
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query

_FILE = "framework || '-' || language"
_TREE_SQL = f"""{CHUNKS_SQL}, c AS (SELECT *, {_FILE} AS file, last_value(CASE WHEN chunk_type = 'class' THEN id END IGNORE NULLS) OVER (PARTITION BY {_FILE} ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cls FROM chunks),
tree AS (SELECT DISTINCT 'file:' || file AS id, NULL AS parent_id, 0 AS level FROM c UNION ALL SELECT id, CASE WHEN chunk_type = 'function' AND cls IS NOT NULL THEN cls ELSE 'file:' || file END, CASE WHEN chunk_type = 'function' AND cls IS NOT NULL THEN 2 ELSE 1 END FROM c)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.tree(chunks(spark, sf_dir).withColumn("file", F.concat_ws("-", "framework", "language")))


@query(f"WITH {_TREE_SQL} SELECT replace(id, '/', '-') AS id, replace(parent_id, '/', '-') AS parent_id, level FROM tree")
def chunk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("id", "parent_id", "level")


@query(f"""WITH {_TREE_SQL}, d AS (SELECT id, parent_id FROM tree), r AS (SELECT parent_id AS id, count(*) AS n FROM d WHERE parent_id IS NOT NULL GROUP BY 1), g AS (SELECT p.parent_id AS id, count(*) AS n FROM d JOIN d p ON d.parent_id = p.id WHERE p.parent_id IS NOT NULL GROUP BY 1)
SELECT replace(d.id, '/', '-') AS id, CAST(coalesce(r.n, 0) + coalesce(g.n, 0) AS BIGINT) AS descendants FROM d LEFT JOIN r USING (id) LEFT JOIN g USING (id)""")
def chunk_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(_tree(spark, sf_dir))


@query("""WITH t AS (SELECT DISTINCT conv_id * 10 + turn AS id, unnest(string_split_regex(lower(text), '\\s+')) AS t FROM conversations WHERE role = 'user'), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM t a JOIN t b USING (t) WHERE a.id <> b.id GROUP BY ALL), s AS (SELECT a, b, round(c / CAST(x.n + y.n - c AS DOUBLE), 6) AS similarity FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b)
SELECT a, b, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS INTEGER) AS rank FROM s WHERE similarity > 0.1) WHERE rank <= 10""")
def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar questions of each."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 10 + F.col("turn")).alias("id"), "text")
    return H.neighbours(c, T.words_of(F.col("text")), 10, 0.1)


_TERMS = ["the", "class", "mit"]


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT id, chunk_idx, round(least(1.0, ({' + '.join(f"CASE WHEN contains(lower(content), '{t}') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(coalesce(class_name, '')), '{t}') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END" for t in _TERMS)}
 + CASE WHEN framework = 'src3' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN chunk_type IN ('function', 'class') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) * importance), 6) AS relevance FROM chunks)
SELECT id, relevance FROM s WHERE relevance > 0.1 ORDER BY relevance DESC, chunk_idx LIMIT 15""")
def relevant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by keywords, framework and intent times importance; the first fifteen above 0.1."""
    hit = lambda c, t, w: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)), w).otherwise(0.0)
    parts = [x for t in _TERMS for x in (hit(F.col("content"), t, 0.2), hit(F.col("class_name"), t, 0.3))]
    parts += [F.when(F.col("framework") == "src3", 0.4).otherwise(0.0), F.when(F.col("chunk_type").isin("function", "class"), 0.2).otherwise(0.0)]
    s = chunks(spark, sf_dir).select("id", "chunk_idx", F.round(F.least(F.lit(1.0), T.total(parts) * F.col("importance")), 6).alias("relevance"))
    return s.where("relevance > 0.1").orderBy(F.desc("relevance"), "chunk_idx").limit(15).drop("chunk_idx")


@query(f"""WITH {CHUNKS_SQL} SELECT 'graph TD' || chr(10) || string_agg(DISTINCT '  ' || framework || ' --> ' || language, chr(10) ORDER BY '  ' || framework || ' --> ' || language) AS text FROM chunks""")
def mermaid_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frameworks and languages; the distinct edges are few."""
    return H.mermaid(chunks(spark, sf_dir).select(F.col("framework").alias("source"), F.col("language").alias("target")).distinct())


@query(f"""WITH {CHUNKS_SQL}, a AS (SELECT id, framework, list_distinct(list_concat(dependencies, [CASE WHEN component_type IS NOT NULL THEN 'spring-' || component_type ELSE 'plain' END])) AS tags, CASE WHEN component_type = 'service' THEN greatest(importance, 0.8) ELSE importance END AS importance FROM chunks)
SELECT id, array_to_string(list_sort(tags), ' ') AS tags, importance FROM a""")
def adapted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a framework appended and an importance floor for services."""
    tag = F.when(F.col("component_type").isNotNull(), F.concat(F.lit("spring-"), F.col("component_type"))).otherwise("plain")
    floor = F.when(F.col("component_type") == "service", F.greatest("importance", F.lit(0.8))).otherwise(F.col("importance"))
    return chunks(spark, sf_dir).select("id", F.array_join(F.array_sort(F.array_union("dependencies", F.array(tag))), " ").alias("tags"), floor.alias("importance"))


@query("""WITH s AS (SELECT n_name AS service, count(*) AS lines, count(DISTINCT p_brand) AS deps, max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) AS deployable FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY n_name)
SELECT service, CAST(deps AS BIGINT) AS dependencies, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN deps > 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN deployable = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN lines > 100 AND lines < 10000 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 6) AS confidence,
CASE WHEN deployable = 1 AND lines > 500 THEN 'microservice' WHEN deps < 5 AND lines < 1000 THEN 'library' ELSE 'module' END AS type FROM s""")
def service_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence and type of services from size, dependencies and deployment."""
    s = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    s = s.groupBy(F.col("n_name").alias("service")).agg(F.count("*").alias("lines"), F.countDistinct("p_brand").alias("deps"), F.max(F.when(F.col("p_size") > 45, 1).otherwise(0)).alias("deployable"))
    plus = lambda c, w: F.when(c, w).otherwise(0.0)
    confidence = F.least(F.lit(1.0), 0.5 + plus(F.col("deps") > 3, 0.2) + plus(F.col("deployable") == 1, 0.2) + plus((F.col("lines") > 100) & (F.col("lines") < 10000), 0.1))
    kind = F.when((F.col("deployable") == 1) & (F.col("lines") > 500), "microservice").when((F.col("deps") < 5) & (F.col("lines") < 1000), "library").otherwise("module")
    return s.select("service", F.col("deps").alias("dependencies"), F.round(confidence, 6).alias("confidence"), kind.alias("type"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS every FROM p)
SELECT user_id, round(CAST((least(1.0, count(*) / 5.0) + least(1.0, max(n) / CAST(max(every) AS DOUBLE))) / 2 AS DOUBLE), 6) AS diversity, round(sum(n * n) / CAST(max(every) * max(every) AS DOUBLE), 6) AS concentration FROM t GROUP BY user_id""")
def result_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("every", F.sum("n").over(Window.partitionBy("user_id")))
    every = F.max("every")
    return p.groupBy("user_id").agg(F.round((F.least(F.lit(1.0), F.count("*") / 5.0) + F.least(F.lit(1.0), F.max("n") / every)) / 2, 6).alias("diversity"), F.round(F.sum(F.col("n") * F.col("n")) / (every * every), 6).alias("concentration"))
