"""Issues by declarative rules, recommendations and weighted scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import Rounds


@dataclass
class QualityRule:
    type: str
    severity: str
    check: str  # a SQL condition on the columns of chunks


DEFAULT_RULES = [
    QualityRule("complexity", "medium", "complexity > 8"),
    QualityRule("coupling", "low", "size(dependencies) = 0 AND chunk_type <> 'configuration'"),
    QualityRule("length", "high", "end_line > 40"),
    QualityRule("duplication", "medium", "n_same > 1"),
]

#: Points that an issue costs (fixed values).
PENALTIES = {"critical": 15.0, "high": 7.0, "medium": 3.0, "low": 0.0}


def with_duplicates(chunks: DataFrame) -> DataFrame:
    """``chunks`` without their contents, with n_same: how many of them, itself included, have the same set of words; chunks without words are not counted.

    Digests of the sets are written before they are counted, so that words are found once.
    """
    words = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[a-z0-9]+"), F.lit(0))))
    digest = F.nullif(F.md5(F.concat_ws(" ", words).cast("binary")), F.md5(F.lit("").cast("binary")))
    rows = Rounds(chunks.sparkSession).keep("digests", chunks.withColumn("same", digest).drop("content"))
    n = rows.where("same IS NOT NULL").groupBy("same").agg(F.count("*").alias("n_same"))
    return rows.join(n, "same", "left").drop("same")


def issues(chunks: DataFrame, rules: list[QualityRule]) -> DataFrame:
    """(id, type, severity): one row for each rule that a chunk breaks, all rules in one pass."""
    found = [F.when(F.expr(r.check), F.struct(F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"))) for r in rules]
    return chunks.select("id", F.inline(F.array_compact(F.array(*found))))


def recommendations(found: DataFrame) -> DataFrame:
    n = F.count("*")
    return found.groupBy("type").agg(n.alias("issues"), F.count_if(F.col("severity").isin("critical", "high")).alias("urgent"), F.when(n > 100, "systematic").otherwise("local").alias("scope"))


def _less(base: int, condition: Column, points: int) -> Column:
    return F.greatest(F.lit(0.0), F.lit(float(base)) - F.when(condition, float(points)).otherwise(0.0))


def scores(chunks: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Dimensions and overall score of each group; a group without issues has no penalty."""
    share = lambda c: F.avg(c.cast("double"))
    d = chunks.groupBy(by).agg(F.avg("complexity").alias("c"), F.avg("importance").alias("i"), share(F.size("dependencies") > 0).alias("deps"), share(F.col("class_name").isNotNull() | F.col("function_name").isNotNull()).alias("named"))
    lost = sum((F.when(F.col("severity") == k, v).otherwise(0.0) for k, v in PENALTIES.items()), F.lit(0.0))
    n = found.join(chunks.select("id", by), "id").groupBy(by).agg(F.sum(lost).alias("lost"), F.countDistinct("id").alias("chunks"))
    n = n.withColumnRenamed(by, "of")
    s = d.join(n, F.col(by).eqNullSafe(F.col("of")), "left").select(by, _less(85, F.col("named") < 0.8, 10).alias("accuracy"), _less(80, F.col("deps") < 0.6, 15).alias("completeness"), _less(90, F.col("i") < 0.7, 20).alias("relevance"), _less(80, F.col("c") > 5, 20).alias("clarity"), "lost", "chunks")
    overall = (F.col("accuracy") * 0.25 + F.col("completeness") * 0.2 + F.col("relevance") * 0.15 + F.col("clarity") * 0.1) / 0.7 - F.coalesce(F.col("lost") / F.col("chunks"), F.lit(0.0))
    return s.select(by, *[F.round(k, 4).alias(k) for k in ("accuracy", "completeness", "relevance", "clarity")], F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), overall)), 4).alias("score"))
