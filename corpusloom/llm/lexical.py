"""Operator 11: exact ranked lexical search by a dual tree.

Items are handled in blocks of bounded size.  For a block, one pass over all
documents counts its terms in each of them; these term counts, which are small
beside the texts, are written once.  Document frequencies, the number of
documents and their lengths give every term's weight and every document's
coordinates, and a score is the product of an item's weights with a document's
coordinates; neither is ever negative.

A hierarchy over the items holds the largest weight of each term below a node.
Each task reads its documents in batches and builds the same over them: halves
of alike documents down to small leaves, with the largest coordinate of each
term.  The product of two nodes' maxima bounds all scores between them.  Level
by level, a pair of nodes goes as soon as its bound is below the weakest kth
score of its items, from whole batches down to single leaves; what is left is
scored, the highest bounds first.  A score equal to the kth counts, so ties are
exact.

Kth scores start from those of a sample of documents, which bound the final ones
from below, whatever the sample.  Tasks return their best K documents of each
item; these are ranked in two steps, so that no task sees all of them.

Scores are sums of integers below 2**53 and so exact in doubles; an item for
which that does not hold is scored in 64-bit integers.  Terms are compared by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import MARKS, Words, chunks, encoded
from .shared import documents, small_batches, written

K = 10
#: A block has at most so many items, and so many different terms unless it is a single item.
BLOCK_ITEMS, BLOCK_TERMS = 512, 16_384
#: Documents times terms of a batch; documents and items of a leaf.
CELLS = 4 << 20
LEAF, ITEM_LEAF = 32, 8
#: Documents of the sample that gives the first kth scores (expected number).
SEEDS = 4096
#: Share of a length that counts, of 100, and the scale of weights and coordinates.
LENGTH, WEIGHT, COORDINATE = 75, 1000, 1_000_000_000
#: Below this a product of weights and coordinates is exact in doubles.
EXACT = 1 << 53


@dataclass
class Block:
    """Some items: their ids, the terms of any of them in ascending order, and each item's terms with their counts."""

    ids: list
    terms: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]


def blocks(items: DataFrame) -> Iterator[Block]:
    """All rows of ``items`` (item_id, text) that have a term, in blocks of bounded size.  Equal item_ids are separate items."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["text"])
            for b, e in chunks(texts):
                words = Words(texts[b:e], lower=True, gaps=MARKS)
                each = [np.unique(words.hash[a:z], return_counts=True) for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pd.DataFrame({"item_id": pdf["item_id"].iloc[b:e].to_numpy(), "terms": [t.view(np.int64) for t, _ in each], "n": [n for _, n in each]})

    ids, found, terms = [], [], set()
    kind = dict(items.dtypes)["item_id"]
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).mapInPandas(count, f"item_id {kind}, terms array<bigint>, n array<bigint>")
    for item_id, own, n in rows.where(F.size("terms") > 0).toLocalIterator():
        if ids and (len(ids) == BLOCK_ITEMS or len(terms) + len(own) > BLOCK_TERMS and len(terms.union(own)) > BLOCK_TERMS):
            yield _block(ids, found)
            ids, found, terms = [], [], set()
        ids.append(item_id)
        found.append((np.array(own, np.int64).view(np.uint64), np.array(n, np.int64)))
        terms.update(own)
    if ids:
        yield _block(ids, found)


def _block(ids: list, found: list[tuple[np.ndarray, np.ndarray]]) -> Block:
    terms = np.unique(np.concatenate([t for t, _ in found]))
    return Block(ids, terms, [(np.searchsorted(terms, t), n) for t, n in found])


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf) of each document: its terms with repeats, and the places in ``terms`` of those it holds with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, width = shared.value, len(shared.value)
        for pdf in batches:
            texts = encoded(pdf["text"])
            for b, e in chunks(texts):
                words = Words(texts[b:e], lower=True, gaps=MARKS)
                at = np.minimum(np.searchsorted(known, words.hash), width - 1)
                held = np.flatnonzero(known[at] == words.hash)
                cell, tf = np.unique(words.owner()[held] * width + at[held], return_counts=True)
                cut = np.searchsorted(cell, np.arange(1, e - b) * width)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[b:e].to_numpy(), "n": words.count, "terms": np.split((cell % width).astype(np.int32), cut), "tf": np.split(tf, cut)})

    return docs.select(_id(docs).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


#: Stands for a missing doc_id inside the search, so that ids stay integers there; it sorts first, as null does.
NO_ID = -(1 << 63)


def _id(docs: DataFrame):
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


class Tree:
    """A balanced binary tree over rows that are nowhere negative: leaves of about ``leaf`` alike rows, and each node's maxima."""

    def __init__(self, rows: np.ndarray, leaf: int):
        depth = max(0, math.ceil(math.log2(max(1, len(rows) / leaf))))
        self.order = np.arange(len(rows))
        self.edges = np.array([0, len(rows)])
        along = rows @ np.random.default_rng(7).standard_normal((rows.shape[1], 8))
        for _ in range(depth):
            edges = [0]
            for b, e in zip(self.edges[:-1], self.edges[1:], strict=True):
                own, m = self.order[b:e], (e - b) // 2
                if m:
                    widest = along[own][:, along[own].std(axis=0).argmax()]
                    self.order[b:e] = own[np.argpartition(widest, m)]
                edges += [b + m, e]
            self.edges = np.array(edges)
        leaves = np.zeros((1 << depth, rows.shape[1]), rows.dtype)
        for i, (b, e) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            if e > b:
                leaves[i] = rows[self.order[b:e]].max(axis=0)
        self.levels = [leaves]
        while len(self.levels[0]) > 1:
            self.levels.insert(0, np.maximum(self.levels[0][::2], self.levels[0][1::2]))

    def leaf(self, i: int) -> np.ndarray:
        return self.order[self.edges[i] : self.edges[i + 1]]


class Search:
    """The items of a block as a tree, and their best documents so far."""

    def __init__(self, block: Block, weights: np.ndarray, docs: int, length: int, kth: np.ndarray, k: int = K):
        self.k, self.docs, self.length, self.width = k, docs, length, len(block.terms)
        heaviest = max(int(n.sum()) for _, n in block.items) * int(weights.max(initial=0)) * (COORDINATE // WEIGHT)
        self.kind = np.float64 if heaviest < EXACT else np.int64
        rows = np.zeros((len(block.items), self.width), self.kind)
        for row, (t, n) in zip(rows, block.items, strict=True):
            row[t] = n * weights[t]
        self.tree = Tree(rows, ITEM_LEAF)
        self.leaves = []
        for i in range(len(self.tree.edges) - 1):
            own = self.tree.leaf(i)
            terms = np.flatnonzero(rows[own].any(axis=0))
            self.leaves.append((own, terms, rows[own][:, terms].T))
        # bounds are sums in another order than scores, so doubles get some room
        self.room = 1 + 1e-9 if self.kind is np.float64 else 1
        self.kth = kth.astype(np.int64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block.items]
        self.scored = 0

    def coordinates(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A row for each document of a batch."""
        if int(n.max(initial=0)) * LENGTH * self.docs < 1 << 62:
            share = LENGTH * n * self.docs // self.length
        else:
            share = np.array([LENGTH * int(x) * self.docs // self.length for x in n], np.int64)
        m = 100 - LENGTH + share
        rows = np.zeros((len(n), self.width), self.kind)
        rows[owner, terms] = COORDINATE * tf // (WEIGHT * tf + 8 * m[owner])
        return rows

    def weakest(self) -> np.ndarray:
        """The least kth score below each item leaf."""
        return np.array([self.kth[own].min(initial=np.iinfo(np.int64).max) for own, _, _ in self.leaves])

    def batch(self, ids: np.ndarray, rows: np.ndarray) -> None:
        tree = Tree(rows, LEAF)
        a, b = self.tree.levels, tree.levels
        pairs = np.zeros((1, 2), np.int64)  # (item node, document node)
        for level in range(max(len(a), len(b))):
            la, lb = min(level, len(a) - 1), min(level, len(b) - 1)
            if level:
                pairs = pairs[:, None, :] * [1 + (level < len(a)), 1 + (level < len(b))] + np.array([(i, j) for i in range(1 + (level < len(a))) for j in range(1 + (level < len(b)))])
                pairs = pairs.reshape(-1, 2)
            weakest = self.weakest()
            weakest = weakest.reshape(len(a[la]), -1).min(axis=1)
            items, docs = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
            bounds = (a[la][items] @ b[lb][docs].T)[np.searchsorted(items, pairs[:, 0]), np.searchsorted(docs, pairs[:, 1])]
            keep = (bounds > 0) & (bounds * self.room >= weakest[pairs[:, 0]])
            pairs, bounds = pairs[keep], bounds[keep]
        for i in np.argsort(-bounds, kind="stable"):
            leaf, node = pairs[i]
            own, terms, weights = self.leaves[leaf]
            if bounds[i] * self.room >= self.kth[own].min():
                at = tree.leaf(node)
                self._take(own, ids[at], (rows[at[:, None], terms] @ weights).astype(np.int64))

    def _take(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.scored += scores.size
        for j in np.flatnonzero((scores >= np.maximum(self.kth[items], 1)).any(axis=0)):
            item = items[j]
            new = scores[:, j] >= max(self.kth[item], 1)
            s, d = np.concatenate([self.best[item][0], scores[new, j]]), np.concatenate([self.best[item][1], ids[new]])
            first = np.lexsort((d, -s))[: self.k]
            self.best[item] = s[first], d[first]
            if len(first) == self.k:
                self.kth[item] = max(self.kth[item], s[first[-1]])


def _searched(counts: DataFrame, search: Search) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in each task."""
    shared = counts.sparkSession.sparkContext.broadcast(search)
    most = max(LEAF, CELLS // search.width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Search.__new__(Search)
        own.__dict__ |= shared.value.__dict__ | {"kth": shared.value.kth.copy(), "best": list(shared.value.best)}
        for pdf in batches:
            for at in range(0, len(pdf), most):
                part = pdf.iloc[at : at + most]
                sizes = part["terms"].map(len).to_numpy()
                owner = np.repeat(np.arange(len(part)), sizes)
                own.batch(part["doc_id"].to_numpy(), own.coordinates(part["n"].to_numpy(), owner, np.concatenate(part["terms"].to_numpy()), np.concatenate(part["tf"].to_numpy())))
        sizes = [len(s) for s, _ in own.best]
        yield pd.DataFrame({"item": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "doc_id": np.concatenate([d for _, d in own.best]), "score": np.concatenate([s for s, _ in own.best])})

    return counts.where(F.size("terms") > 0).mapInPandas(run, "item int, doc_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item; first those of some tasks each, then of these."""
    order = [F.desc("score"), F.asc("doc_id")]
    some = found.withColumn("part", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame | None:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each row of ``items``; None if no item has a term.

    Equal scores rank by ascending doc_id, missing ids first.  Repeated items
    have repeated results; repeated documents count and rank as often as they
    occur.  Null and empty texts have no term.  Items without a matching document
    have no row, as without documents.  Texts of any length are read whole; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for block in blocks(items):
        counts = written(term_counts(docs, block.terms), "term_counts")
        number, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.terms), np.int64)
        for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = np.array([math.floor(WEIGHT * math.log((2 * number + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        first = Search(block, weights, number, max(length, 1), np.zeros(len(block.ids), np.int64), k)
        kth = np.zeros(len(block.ids), np.int64)
        sample = counts.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 40)) < (SEEDS << 40) // max(number, 1))
        for item, score in _ranked(_searched(sample, first), k).where(F.col("rank") == k).select("item", "score").collect():
            kth[item] = score
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        best = _ranked(_searched(counts, Search(block, weights, number, max(length, 1), kth, k)), k).join(F.broadcast(names), "item")
        best = best.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = best if out is None else out.unionByName(written(best, "ranked"))
    return out


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = search(documents(spark, sf_dir), items)
    return found if found is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ws FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS qf FROM (SELECT i, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, CAST(floor({WEIGHT} * ln((2 * big_n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
m AS (SELECT r, doc_id, {100 - LENGTH} + ({LENGTH} * len(ws) * big_n) // big_l AS m FROM d, s WHERE len(ws) > 0),
x AS (SELECT i, item_id, r, doc_id, CAST(sum(qf * w * (({COORDINATE} * tf) // ({WEIGHT} * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {K}"""
