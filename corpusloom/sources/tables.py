"""Input tables and the corpus entities derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Chunk type of a document by its id; stands for the parser's classes.
CHUNK_TYPES = ("file", "function", "class", "interface", "block")
EXTENSIONS = ("py", "ts", "js", "java", "vue", "md", "json", "yml", "html", "css", "go", "txt")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval chunk for each document, with its metadata; ``chunk_idx`` is the insertion order."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        i.alias("chunk_idx"),
        F.concat(F.lit("c"), i.cast("string")).alias("id"),
        F.col("text").alias("content"),
        F.concat_ws("/", "source", "lang", F.concat(i.cast("string"), F.lit("."), pick(EXTENSIONS))).alias("file_path"),
        pick(EXTENSIONS).alias("extension"),
        F.lit(1).cast("long").alias("start_line"),
        F.size(F.split("text", "\n")).cast("long").alias("end_line"),
        pick(CHUNK_TYPES).alias("chunk_type"),
        F.col("source").alias("framework"),
        F.col("lang").alias("language"),
        (1 + i % 10).alias("complexity"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("importance"),
        F.when(i % 3 == 0, F.concat(F.lit("Class"), (i % 50).cast("string"))).alias("class_name"),
        F.when(i % 4 == 0, F.concat(F.lit("run"), (i % 40).cast("string"))).alias("function_name"),
        F.when(i % 5 == 0, F.lit("service")).when(i % 5 == 1, F.lit("controller")).alias("component_type"),
        (F.date_sub(F.lit("2024-06-30").cast("date"), (i % 500).cast("int"))).alias("modified"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit("lib-"), (i % 7).cast("string")), F.concat(F.lit("core-"), (i % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("dependencies"),
    )


def _case(column: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {column} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


CHUNKS_SQL = f"""chunks AS (
  SELECT d.doc_id AS chunk_idx, 'c' || d.doc_id AS id, text AS content,
    source || '/' || lang || '/' || d.doc_id || '.' || {_case('d.doc_id', EXTENSIONS)} AS file_path, {_case('d.doc_id', EXTENSIONS)} AS extension,
    CAST(1 AS BIGINT) AS start_line, CAST(len(string_split(text, chr(10))) AS BIGINT) AS end_line, {_case('d.doc_id', CHUNK_TYPES)} AS chunk_type,
    source AS framework, lang AS language, 1 + d.doc_id % 10 AS complexity, coalesce(CAST(quality AS DOUBLE), 0.5) AS importance,
    CASE WHEN d.doc_id % 3 = 0 THEN 'Class' || (d.doc_id % 50) END AS class_name, CASE WHEN d.doc_id % 4 = 0 THEN 'run' || (d.doc_id % 40) END AS function_name,
    CASE WHEN d.doc_id % 5 = 0 THEN 'service' WHEN d.doc_id % 5 = 1 THEN 'controller' END AS component_type,
    CAST(DATE '2024-06-30' - CAST(d.doc_id % 500 AS INTEGER) AS DATE) AS modified,
    CASE WHEN d.doc_id % 2 = 0 THEN ['lib-' || (d.doc_id % 7), 'core-' || (d.doc_id % 3)] ELSE CAST([] AS VARCHAR[]) END AS dependencies
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
