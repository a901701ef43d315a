"""Nearest vectors through an index of cells, and cross references of chunks through a dependency graph.

Cells are the clusters of a bounded sample; every vector belongs to the cell of
its nearest centre.  A query visits the cells whose centres are nearest to it,
as many as the sample needs to reach a stated recall, and meets all vectors
there; their similarities are exact.  A cell is cut into parts of bounded size,
as are the queries that visit it, so no group grows with a cell that holds a
third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors from which centres and the number of visited cells are learned, at most.
SAMPLE = 8_192
#: Vectors of the sample for each centre, at least, and centres at most.
EACH, MOST_CELLS = 64, 256
#: Share of the sample's own nearest neighbours that has to be found.
RECALL = 0.97
#: Expected vectors and queries of one group.
GROUP_ROWS, GROUP_QUERIES = 8_192, 1_024
#: Parts into which the chunks that a file refers to are dealt.
FILE_PARTS = 32


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def comparable(df: DataFrame, vector: str, d: int) -> DataFrame:
    """Rows with ``d`` finite entries, not all zero; only these have an angle."""
    return df.where((F.size(vector) == d) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vector, lambda c: c != 0))


@dataclass
class Cells:
    """Centres of unit length, and how many a query visits."""

    centres: np.ndarray
    visits: int

    @staticmethod
    def learned(sample: np.ndarray, k: int, recall: float = RECALL) -> Cells:
        """Spherical k-means over at most ``SAMPLE`` vectors; visits by the sample's neighbours among themselves."""
        x, rng = _unit(sample.astype(np.float64)), np.random.default_rng(1)
        n = max(1, min(MOST_CELLS, len(x) // EACH))
        centres = x[rng.choice(len(x), n, replace=False)]
        for _ in range(12):
            own = (x @ centres.T).argmax(axis=1)
            for c in range(n):
                total = x[own == c].sum(axis=0)
                if np.linalg.norm(total) > 0:
                    centres[c] = total / np.linalg.norm(total)
        asked = np.arange(len(x))[: min(len(x), 1024)]
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.zeros((len(asked), 0), int)
        own, rank = (x @ centres.T).argmax(axis=1), np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
        visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else n
        return Cells(centres, min(n, visits))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        near = _unit(x) @ self.centres.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def learned(df: DataFrame, vector: str, d: int, k: int, recall: float = RECALL) -> Cells | None:
    """Cells from the ``SAMPLE`` rows with the smallest hashes of their ids; None without a row."""
    rows = comparable(df, vector, d).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v")).collect()
    return Cells.learned(np.array([r["v"] for r in rows]), k, recall) if rows else None


def placed(df: DataFrame, vector: str, d: int, cells: Cells, visits: int) -> DataFrame:
    """(id, v, cell): each comparable row in its ``visits`` nearest cells."""
    rows = comparable(df, vector, d).select("id", F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cells=list(cells.nearest(np.stack(pdf["v"].to_numpy()), visits).astype(np.int32)))

    return rows.mapInPandas(run, f"id {kind}, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, d: int, vector: str = "v", cells: Cells | None = None) -> DataFrame:
    """(query, id, similarity, rank): for each row of ``queries`` (id, vector) the ``k`` most alike rows of other ids, of those in the cells that it visits.

    Similarity is the cosine; equal ones rank by id.  Rows and queries whose
    vector is null, of another length, not finite or zero have no neighbours.
    """
    cells = cells or learned(rows, vector, d, k)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query {kind}, id {kind}, similarity double"
    if cells is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    own, asked = placed(rows, vector, d, cells, 1), placed(queries, vector, d, cells, cells.visits)
    parts = lambda df, most: {r["cell"]: -(-r["count"] // most) for r in df.groupBy("cell").count().collect()}  # noqa: E731  one row for each cell
    row_parts, query_parts = parts(own, GROUP_ROWS), parts(asked, GROUP_QUERIES)
    n = F.create_map(*[F.lit(x) for c in range(len(cells.centres)) for x in (c, row_parts.get(c, 1))])
    m = F.create_map(*[F.lit(x) for c in range(len(cells.centres)) for x in (c, query_parts.get(c, 1))])
    # every part of a cell's rows meets every part of its queries
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), n[F.col("cell")])).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), m[F.col("cell")] - F.lit(1).cast("bigint"))))
    asked = asked.withColumn("other", F.pmod(F.xxhash64("id"), m[F.col("cell")])).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), n[F.col("cell")] - F.lit(1).cast("bigint"))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = left["id"].to_numpy(), _unit(np.stack(left["v"].to_numpy()))
            for at in range(0, len(right), 256):
                part = right.iloc[at : at + 256]
                near = _unit(np.stack(part["v"].to_numpy())) @ x.T
                near[part["id"].to_numpy()[:, None] == ids[None, :]] = -2
                take = min(k, len(ids))
                least = -np.partition(-near, take - 1, axis=1)[:, take - 1]
                for q, s, low in zip(part["id"], near, least, strict=True):
                    found = np.flatnonzero((s >= low) & (s > -2))
                    found = found[np.lexsort((ids[found], -s[found]))][:take]
                    out.append(pd.DataFrame({"query": q, "id": ids[found], "similarity": s[found]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "similarity": []}).astype({"similarity": float})

    keys = ["cell", "part", "other"]
    found = own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(compare, schema)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def cross_references(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other, relationship, confidence) of chunks (id, file) by graph nodes (node, file, chunk) and edges (source, target).

    A chunk refers to the chunks of all nodes on which a node of its file
    depends, and is used by those of all nodes that depend on one; never to itself.
    What a file refers to is found once for all its chunks, which meet it in the
    end, in parts; only chunks of several files can then refer to one twice.
    """
    files = chunks.select("id", "file").distinct()
    files = files.join(files.groupBy("id").agg((F.count("*") > 1).alias("several")), "id")
    own = nodes.where("file IS NOT NULL").select("node", "file").distinct()
    of_chunk = nodes.where("chunk IS NOT NULL").select(F.col("node").alias("other_node"), F.col("chunk").alias("other")).distinct()
    e = edges.select("source", "target").distinct()
    out = e.join(own.withColumnRenamed("node", "source"), "source").select("file", F.col("target").alias("other_node"), F.lit("depends_on").alias("relationship"))
    into = e.join(own.withColumnRenamed("node", "target"), "target").select("file", F.col("source").alias("other_node"), F.lit("used_by").alias("relationship"))
    found = out.unionByName(into).distinct().join(of_chunk, "other_node").select("file", "other", "relationship").distinct()
    found = found.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(FILE_PARTS)))
    every = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(FILE_PARTS - 1).cast("bigint"))))
    both = found.join(every, ["file", "part"]).where("id <> other").select("id", "other", "relationship", "several")
    return both.where("NOT several").unionByName(both.where("several").distinct()).select("id", "other", "relationship", F.lit(0.8).alias("confidence"))
