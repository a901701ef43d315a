"""Chunk trees, neighbours and context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import Rounds


def tree(chunks: DataFrame) -> DataFrame:
    """(id, parent_id, level, path): files at level 0, their classes below, functions below a class of their file or the file.

    ``chunks`` has id, file, chunk_type and chunk_idx; of several classes in a
    file the last one before a function is its parent.
    """
    order = Window.partitionBy("file").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    last_class = F.last(F.when(F.col("chunk_type") == "class", F.col("id")), ignorenulls=True).over(order)
    root = F.concat(F.lit("file:"), F.col("file"))
    rows = chunks.withColumn("cls", last_class)
    nested = (F.col("chunk_type") == "function") & F.col("cls").isNotNull()
    parent = F.when(nested, F.col("cls")).otherwise(root)
    inner = rows.select("id", parent.alias("parent_id"), F.when(nested, 2).otherwise(1).alias("level"), F.when(nested, F.concat_ws("/", root, "cls", "id")).otherwise(F.concat_ws("/", root, "id")).alias("path"))
    files = chunks.select("file").distinct().select(root.alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), root.alias("path"))
    return files.unionByName(inner)


def descendants(nodes: DataFrame) -> DataFrame:
    """(id, descendants) by the materialised path: each ancestor in a path counts its node."""
    steps = F.split("path", "/")
    up = nodes.select(F.col("id").alias("node"), F.explode(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))).alias("id"))
    return nodes.select("id").join(up.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("descendants"))


#: Expected documents and queries of one group that are compared with each other.
GROUP_ROWS, GROUP_QUERIES = 32_768, 4_096


def neighbours(docs: DataFrame, tokens: Column, k: int, least: float, most_df: int | None = None) -> DataFrame:
    """(a, b, similarity, rank) of the ``k`` most similar documents of each by Jaccard similarity of distinct tokens.

    Pairs come from shared tokens; a token in more than ``most_df`` documents
    makes no pairs but still counts in sizes (None: every token makes pairs).
    Rows of one id are one document.  All documents are compared with all, in
    groups of bounded size that count common tokens along their own postings, so
    that no pair leaves a group but the ``k`` best of each document there.
    """
    rounds = Rounds(docs.sparkSession)
    t = rounds.keep("tokens", docs.select("id", F.explode(F.array_distinct(tokens)).alias("t")).where("id IS NOT NULL").distinct())
    df = t.groupBy("t").agg(F.count("*").alias("df"))
    # a token of one document has no partner; the others get numbers
    paired = df.where((F.col("df") > 1) & (F.col("df") <= most_df) if most_df else F.col("df") > 1)
    numbers = rounds.keep("numbers", paired.select("t", F.monotonically_increasing_id().alias("number")))
    sets = t.join(numbers, "t", "left").groupBy("id").agg(F.count("*").alias("n"), F.collect_list("number").alias("numbers"))
    sets = rounds.keep("sets", sets)
    every = sets.count()
    n, m = -(-every // GROUP_ROWS) or 1, -(-every // GROUP_QUERIES) or 1
    h, whole = F.xxhash64("id"), lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = sets.withColumn("part", F.pmod(h, F.lit(n)).cast("int")).withColumn("other", whole(m))
    asked = sets.withColumn("other", F.pmod(h, F.lit(m)).cast("int")).withColumn("part", whole(n))

    def compare(right: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id", ignore_index=True)
        ids, sizes = right["id"].to_numpy(), right["n"].to_numpy()
        empty = pd.DataFrame({"a": ids[:0], "b": ids[:0], "common": [], "na": [], "nb": []}).astype({c: "int64" for c in ("common", "na", "nb")})
        if not len(right) or not len(left):
            return empty
        lengths = right["numbers"].map(len).to_numpy()
        tokens_ = np.concatenate([*right["numbers"], np.zeros(0, np.int64)]).astype(np.int64)
        known, code = np.unique(tokens_, return_inverse=True)
        postings = np.repeat(np.arange(len(ids)), lengths)[np.argsort(code, kind="stable")]
        begins = np.append(0, np.cumsum(np.bincount(code, minlength=len(known))))
        found = []
        for a, na, words in zip(left["id"], left["n"], left["numbers"], strict=True):
            at = np.searchsorted(known, words)
            at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == words)] if len(known) else at[:0]
            if not len(at):
                continue
            common = np.bincount(np.concatenate([postings[begins[i] : begins[i + 1]] for i in at.tolist()]), minlength=len(ids))
            s = common / (sizes + na - common)
            # the limit holds for rounded similarities, which the query takes
            near = np.flatnonzero((s > least - 1e-6) & (common > 0))
            near = near[ids[near] != a]
            if len(near) > k:
                rounded = np.floor(s[near] * 1e6 + 0.5)
                near = near[rounded >= np.partition(rounded, len(near) - k)[len(near) - k]]
                near = near[np.lexsort((near, -np.floor(s[near] * 1e6 + 0.5)))][:k]
            found.append((a, na, near, common[near]))
        if not found:
            return empty
        near, many = np.concatenate([f[2] for f in found]), [len(f[2]) for f in found]
        of = lambda i: np.repeat(np.array([f[i] for f in found]), many)
        return pd.DataFrame({"a": of(0), "b": ids[near], "common": np.concatenate([f[3] for f in found]), "na": of(1), "nb": sizes[near]})

    kind = sets.schema["id"].dataType.simpleString()
    pairs = own.groupBy("part", "other").cogroup(asked.groupBy("part", "other")).applyInPandas(compare, f"a {kind}, b {kind}, common bigint, na bigint, nb bigint")
    s = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    pairs = pairs.select("a", "b", F.round(s, 6).alias("similarity")).where(F.col("similarity") > least)
    rounds.close("sets")
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mermaid(edges: DataFrame, kind: str = "graph TD") -> DataFrame:
    """One row with Mermaid text of a bounded edge table (source, target)."""
    line = F.format_string("  %s --> %s", F.col("source"), F.col("target"))
    lines = edges.agg(F.array_sort(F.collect_list(line)).alias("l"))
    return lines.select(F.concat(F.lit(kind + "\n"), F.array_join("l", "\n")).alias("text"))
