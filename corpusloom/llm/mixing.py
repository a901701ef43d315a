"""Operator 7: mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed for each cell (source, language, topic).  The weights of the
cells are raked: scaled to the targets of each dimension in turn until no
marginal is further than ``TOLERANCE`` from its target, which gives the table
nearest to the given one that has the targets as its marginals.  A document is
kept with a probability proportional to its cell's raked over its given tokens,
at most 1, so that ``keep`` of all tokens are expected.  The draw is a hash of
the id, so it repeats.

The table of cells has a row for each combination of values, not for each
document; it stays in one partition, so raking shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, documents, written

DIMENSIONS = ("source", "lang", "topic")
#: Sweeps between two looks at the marginals, and sweeps after which raking ends in any case.
SWEEPS = 4
MOST_SWEEPS = 100
#: Furthest that a marginal may be from its target.
TOLERANCE = 1e-11
#: Targets are the given shares to this power, made to sum to 1: below 1 small groups gain.
FLATTEN = 0.8
#: Expected share of tokens that stay.
KEEP = 0.9
MISSING = "(none)"


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's form: table, marked, list, short or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(F.regexp_count(text, F.lit(r"\|")) * 40 > n, "table")
        .when(F.regexp_count(text, F.lit(r"[#*$%&<>]")) * 40 > n, "marked")
        .when(n < 400, "short")
        .when(F.regexp_count(text, F.lit("\n")) * 60 > n, "list")
        .otherwise("prose")
    )


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the MD5 of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets_of(cells: DataFrame, dimension: str, flatten: float, given: dict[str, float] | None = None) -> DataFrame:
    """Target share of each value: the given ones (values not named get 0), else flattened present shares."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    if given:
        share = F.coalesce(*[F.when(F.col(dimension) == k, F.lit(float(v))) for k, v in given.items()], F.lit(0.0))
    else:
        share = F.pow(F.col("t").cast("double"), F.lit(flatten))
    return sums.select(dimension, share.alias("share")).select(dimension, F.coalesce(F.try_divide(F.col("share"), F.sum("share").over(Window.partitionBy())), F.lit(0.0)).alias(f"target_{dimension}"))


def _residual(cells: DataFrame) -> Column:
    """How far the marginals are from their targets at most, as one number on each row."""
    off = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"target_{d}")) for d in DIMENSIONS]
    return F.greatest(*off)


def rake(cells: DataFrame, flatten: float = FLATTEN, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight, raked shares of all tokens, and residual, the same on each row.

    Targets of values that have no tokens cannot be met and are left out.
    Targets that contradict each other (a value whose only cells have a target
    of 0, say) end after ``MOST_SWEEPS`` with a residual above ``TOLERANCE``.
    Cells without tokens are left out; without any cell the result is empty.
    """
    cells = cells.where("tokens > 0")
    for d in DIMENSIONS:
        cells = cells.join(targets_of(cells, d, flatten, (targets or {}).get(d)), d)
    cells = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    cells = written(cells.coalesce(1), "cells").coalesce(1)
    for _ in range(MOST_SWEEPS // SWEEPS):
        for _ in range(SWEEPS):
            for d in DIMENSIONS:
                total = F.sum("weight").over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"target_{d}") / total).otherwise(0.0))
        cells = written(cells.withColumn("residual", _residual(cells)), "cells").coalesce(1)
        residual = cells.agg(F.max("residual")).first()[0]
        if residual is None or residual <= TOLERANCE:
            break
    return cells.select(*DIMENSIONS, "tokens", "weight", F.max("residual").over(Window.partitionBy()).alias("residual"))


def calibrated(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """Raked cells with probability: at most 1, in proportion to weight / tokens where below, and ``keep`` of the tokens expected.

    With the cells in descending order of that ratio, those before the first
    one that stays below 1 are at 1 and the others share what these leave.
    """
    everything = Window.partitionBy()
    falling = everything.orderBy(F.desc("ratio"), *DIMENSIONS)
    cells = cells.withColumn("ratio", F.col("weight") * F.sum("tokens").over(everything) / F.col("tokens"))
    before = F.sum("tokens").over(falling) - F.col("tokens")
    rest = F.sum(F.col("ratio") * F.col("tokens")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    factor = F.when(rest > 0, (F.lit(keep) * F.sum("tokens").over(everything) - before) / rest)
    cells = cells.withColumn("factor", factor).withColumn("nth", F.row_number().over(falling))
    first = F.min(F.when(F.col("factor") * F.col("ratio") <= 1, F.struct("nth", "factor"))).over(everything)["factor"]
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(first * F.col("ratio"), F.lit(1.0))))
    return cells.select(*DIMENSIONS, "tokens", "weight", p.alias("probability"))


def _celled(docs: DataFrame, topic: Column | None, row: list[Column]) -> DataFrame:
    """The cell and the tokens of each row; the columns ``row`` are carried as a struct, apart from those."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dims = [F.coalesce(F.col(d).cast("string"), F.lit(MISSING)).alias(d) for d in ("source", "lang")]
    topic = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(MISSING))
    return docs.select(F.struct(*row).alias("row"), F.col("doc_id").alias("id"), *dims, topic.alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))


def weights_of(celled: DataFrame, flatten: float, keep: float, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """The cells with weight and probability, written as one small file."""
    cells = celled.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    return written(calibrated(rake(cells, flatten, targets), keep).drop("tokens").coalesce(1), "weights")


def _drawn(celled: DataFrame, weights: DataFrame, keep: float, seed: int) -> DataFrame:
    out = celled.join(weights, [*DIMENSIONS], "left")
    out = out.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(float(keep)))})
    return out.withColumn("is_kept", uniform(F.col("id"), seed) < F.col("probability"))


def mixed(docs: DataFrame, flatten: float = FLATTEN, keep: float = KEEP, seed: int = 0, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """Every document's cell, weight and draw: doc_id, source, lang, topic, n_tokens, weight, probability, is_kept.

    ``topic`` is a column of ``docs`` where the caller has one, else the text's
    form.  Null source, lang, topic and text count as ``(none)`` and an empty
    text.  Documents without tokens take no part in the weights and are kept
    with probability ``keep``.  Equal ids, null ones too, have equal draws, so
    repeated rows stay or go together.  Texts of any length count whole; an
    empty table gives an empty result.  Other columns of ``docs`` are ignored.
    Weight and probability are rounded for show, after the draw.
    """
    rows = written(_celled(docs, topic, [F.lit(0).alias("none")]).drop("row"), "token-counts")
    out = _drawn(rows, weights_of(rows, flatten, keep, targets), keep, seed)
    return out.select(F.col("id").alias("doc_id"), *DIMENSIONS, F.col("tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "is_kept")


def sampled(docs: DataFrame, flatten: float = FLATTEN, keep: float = KEEP, seed: int = 0, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` keeps, with all their columns, whatever these are called, unchanged."""
    celled = _celled(docs, topic, [docs[f"`{c}`"] for c in docs.columns])
    weights = weights_of(celled, flatten, keep, targets)
    return _drawn(celled, weights, keep, seed).where("is_kept").select("row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def _oracle() -> str:
    """The same in DuckDB: sweeps are spelled out, many enough to converge far below the six digits that are shown."""
    t = "coalesce(text, '')"
    count = lambda p: f"(length({t}) - length(regexp_replace({t}, '{p}', '', 'g')))"
    n = f"greatest(length({t}), 1)"
    ctes = [
        f"""rows_ AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
        CASE WHEN {count('[|]')} * 40 > {n} THEN 'table' WHEN {count('[#*$%&<>]')} * 40 > {n} THEN 'marked' WHEN {n} < 400 THEN 'short' WHEN {count(chr(10))} * 60 > {n} THEN 'list' ELSE 'prose' END AS topic,
        CAST(len(regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d in DIMENSIONS:
        ctes.append(f"t_{d} AS (SELECT {d}, s / sum(s) OVER () AS target_{d} FROM (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {FLATTEN}) AS s FROM c0 GROUP BY {d}))")
    ctes.append("r0 AS (SELECT c0.*, " + ", ".join(f"target_{d}" for d in DIMENSIONS) + ", CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS weight FROM c0 " + " ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS) + ")")
    k = 0
    for _ in range(6 * SWEEPS):
        for d in DIMENSIONS:
            ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * target_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM r{k})")
            k += 1
    falling = "ORDER BY ratio DESC, source, lang, topic"
    ctes.append(f"p0 AS (SELECT source, lang, topic, tokens, weight, weight * sum(tokens) OVER () / tokens AS ratio FROM r{k})")
    ctes.append(f"p1 AS (SELECT *, ({KEEP} * sum(tokens) OVER () - (sum(tokens) OVER ({falling}) - tokens)) / sum(ratio * tokens) OVER ({falling} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor, row_number() OVER ({falling}) AS nth FROM p0)")
    ctes.append("p2 AS (SELECT *, least(1, greatest(0, coalesce(arg_min(factor, nth) FILTER (factor * ratio <= 1) OVER () * ratio, 1))) AS p FROM p1)")
    draw = "CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 0.0), 6) AS weight, round(coalesce(p, {KEEP}), 6) AS probability, {draw} < coalesce(p, {KEEP}) AS is_kept
FROM rows_ LEFT JOIN p2 USING (source, lang, topic)"""


OP7_SQL = _oracle()
