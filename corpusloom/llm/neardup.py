"""Operator 3: near-duplicate documents by DartMinHash and banded joining.

A document is a set: its different runs of ``SHINGLE`` words, each with weight 1
however often it occurs, because links are decided by the similarity of sets; a
weight by counts would draw a text apart from the same text pasted twice.
Darts are thrown at every element: hashed arrival times make a Poisson process
on its strips of weight [0, 1), [1, 2), [2, 4), ..., the same in every document,
and a dart counts where its hashed weight lies under the element's.  A document
looks at darts up to the time when about ``k (ln k + 2)`` have come, deals them
to ``k`` coordinates by a hash and keeps the earliest of each, so a signature
takes one draw per element and a few per coordinate.  Two documents agree in a
coordinate with the probability of their (weighted) Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates are joined; at a similarity of 0.8 two
texts meet in none of them with a probability of 0.00007.  Exact copies are joined by
a hash of all their words first, and only one text of each takes part.  Within a
band's group, members are compared to one pivot, the one that shares most
groups with others.  What those links leave apart is compared across the parts,
but only pairs that can reach the similarity: x and y have at most
``min(|x & pivot|, |y & pivot|)`` shingles of the pivot in common, so either
that is enough, or they share shingles that the pivot lacks, and then one of
the first few of them in hash order (prefix filtering).  Both bounds are exact,
and a large group of copies that differ from each other makes no pairs.  A link
needs a Jaccard similarity of the shingle sets of 0.8 or more.  Classes are the
connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, chunks, encoded, mix, signed, span_hashes
from .components import components
from .shared import documents, small_batches, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5

_U = np.uint64


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each text's distinct shingles; a text of fewer words is one shingle."""
    g, _, of = w.grams(SHINGLE)
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(short):
        g = np.concatenate([g, span_hashes(w.hash, w.first[short], w.first[short + 1])])
        of = np.concatenate([of, short])
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(fresh)
    return of[at], g[at], np.diff(np.concatenate([at, [len(g)]]))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _throw(of: np.ndarray, element: np.ndarray, weight: np.ndarray, until: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, coordinate, time, dart) of the darts that land under each element's weight in time."""
    out = []
    strip, low = 0, 0.0
    while True:
        high = 1.0 if strip == 0 else low * 2
        live = np.flatnonzero(weight > low)
        if not len(live):
            break
        seed = mix(element[live] + _U((0x9E3779B97F4A7C15 * (strip + 1)) % (1 << 64)))
        time = np.zeros(len(live))
        limit, top, who = until[live], weight[live], of[live]
        while len(seed):
            seed = mix(seed + _U(0xD1B54A32D192ED03))
            time = time - np.log(_uniform(seed)) / (high - low)
            go = time < limit
            seed, time, limit, top, who = seed[go], time[go], limit[go], top[go], who[go]
            other = mix(seed ^ _U(0xA0761D6478BD642F))
            under = low + _uniform(other) * (high - low) < top
            coordinate = (mix(seed ^ _U(0xE7037ED1A0B428DB)) % _U(k)).astype(np.int64)
            out.append((who[under], coordinate[under], time[under], seed[under]))
        low, strip = high, strip + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(of: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate of each of ``n`` texts (n x k); an element weighs 1 + ln(count); zero rows for texts without elements."""
    out = np.zeros((n, k), np.uint64)
    weight = 1.0 + np.log(count)
    total = np.bincount(of, weights=weight, minlength=n)
    need = k * (np.log(k) + 2)
    missing = np.flatnonzero(total > 0)
    while len(missing):
        chosen = np.zeros(n, bool)
        chosen[missing] = True
        use = chosen[of]
        who, coordinate, time, dart = _throw(of[use], element[use], weight[use], need / total[of[use]], k)
        order = np.lexsort((dart, time, who * k + coordinate))
        cell = (who * k + coordinate)[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        filled = np.zeros(n * k, bool)
        filled[cell[first]] = True
        flat = out.reshape(-1)
        flat[cell[first]] = dart[order][first]
        missing = missing[~filled.reshape(n, k)[missing].all(axis=1)]
        need *= 2  # a coordinate stayed empty: look at darts twice as long
    return out


def _sign(bands: int, rows: int):
    columns = (np.arange(rows) + 1).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["text"])
            for a, z in chunks(texts):
                w = Words(texts[a:z], lower=True)
                of, element, _ = shingles(w)
                s = signatures(of, element, np.ones(len(of)), z - a, bands * rows).reshape(z - a, bands, rows)
                keys = mix((mix(s + columns * _U(0x8CB92BA72F3D8DD7))).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
                whole = span_hashes(w.hash, w.first[:-1], w.first[1:])
                yield pd.DataFrame({"row": pdf["row"].iloc[a:z].to_numpy(), "doc_id": pdf["doc_id"].iloc[a:z].to_numpy(), "n_words": w.count, "node": signed(whole), "bands": list(signed(keys))})

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = encoded(pdf["text"])
        for a, z in chunks(texts):
            w = Words(texts[a:z], lower=True)
            of, element, _ = shingles(w)
            cut = np.searchsorted(of, np.arange(z - a + 1))
            out = pd.DataFrame({"node": pdf["node"].iloc[a:z].to_numpy(), "items": [element[cut[i] : cut[i + 1]].tobytes() for i in range(z - a)], "size": np.diff(cut)})
            yield out[signed(span_hashes(w.hash, w.first[:-1], w.first[1:])) == out["node"].to_numpy()]


def _common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sizes = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
        yield pdf[["a", "b", "nx", "ny"]].assign(common=np.array(sizes, np.int64))


def _prefixes(similarity: float):
    """The first shingles, by hash, that a member has and its pivot lacks: enough of them to meet any partner's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y, p in zip(pdf["x"], pdf["y"], pdf["common"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                own = np.setdiff1d(x, y, assume_unique=True)
                need = max(int(np.ceil(similarity * len(x) - p - 1e-9)), 1)
                out.append(np.sort(own)[: len(own) - need + 1].view(np.int64) if len(own) >= need else np.zeros(0, np.int64))
            yield pdf[["a", "b"]].assign(items=out)

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sets and sizes."""
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"), F.col("size").alias("nx"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"), F.col("size").alias("ny"))
    own = [c for c in pairs.columns if c not in ("nx", "ny")]
    return pairs.select(*own).join(x, "a").join(y, "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return _with_sets(pairs.select("a", "b"), sets).select("a", "b", "nx", "ny", "x", "y").mapInPandas(_common, "a long, b long, nx int, ny int, common long")


def _linked(compared: DataFrame, similarity: float) -> DataFrame:
    return compared.where(F.col("common") >= F.lit(similarity) * (F.col("nx") + F.col("ny") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The class of every document: doc_id, class_id, class_size, n_links, is_kept.

    class_id is the smallest doc_id of the class; is_kept marks one row of it.
    n_links counts verified links of the document's text to different texts.
    Texts are compared by their words, letters A-Z lowered; texts without words
    (null, empty) are each a class of their own, as is a row with a null id.
    Equal texts are one class without being paired.  Repeated rows are copies,
    of which one is kept.  Of rows with the smallest id of a class the first one
    read is kept.  Whole texts are compared, however long; a text of fewer than
    ``SHINGLE`` words is one shingle.  Further columns are ignored; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()).mapInPandas(_sign(bands, rows), "row long, doc_id long, n_words long, node long, bands array<long>"), "signatures")
    worded = table.where("n_words > 0 AND doc_id IS NOT NULL")
    # a node is a different word sequence, known by its hash; rep is a document that has it
    nodes = worded.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    member = F.explode(F.transform("bands", lambda b, i: F.struct(i.alias("band"), b.alias("key")))).alias("m")
    members = nodes.select("node", member).select("node", "m.*")
    groups = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(groups, ["band", "key"]), "members")
    # the pivot of a group is the member whose groups are largest: it has most in common with the others
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = shared.join(weight, "node").select("band", "key", "node", F.struct("weight", (-F.col("node")).alias("minus")).alias("rank"))
    pivots = ranked.groupBy("band", "key").agg((-F.max("rank")["minus"]).alias("pivot"))
    stars = written(shared.join(pivots, ["band", "key"]).where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    involved = nodes.select("node", "rep").join(shared.select("node").distinct(), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(involved, "rep").select("node", "text")
    sets = written(texts.mapInPandas(_sets, "node long, items binary, size int").dropDuplicates(["node"]), "shingle-sets")
    compared = written(_compared(stars, sets), "compared")
    links = _linked(compared, similarity)

    # across the parts that these links leave around a pivot
    parts = written(components(links), "parts")
    part_of = lambda name, out: parts.select(F.col("node").alias(name), F.col("component").alias(out))
    around = compared.join(part_of("a", "part"), "a", "left").join(part_of("b", "pivot_part"), "b", "left")
    around = around.select("a", "b", F.col("nx").alias("n"), "common", F.coalesce("part", "a").alias("part"), F.coalesce("pivot_part", "b").alias("pivot_part"))
    apart = around.where("part <> pivot_part").groupBy("b").agg(F.count("*").alias("n_apart"))
    around = written(around.join(apart, "b").join(around.groupBy("b").agg(F.min("n").alias("least")), "b"), "around")
    mine = lambda x: [F.col("a").alias(f"{x}_a"), F.col("n").alias(f"{x}_n"), F.col("common").alias(f"{x}_p"), F.col("part").alias(f"{x}_part")]
    most = (1 + similarity) / similarity
    sized = (F.col("x_part") != F.col("y_part")) & (F.least("x_n", "y_n") >= F.lit(similarity) * F.greatest("x_n", "y_n"))
    minor = around.where("part <> pivot_part")
    # pairs that the pivot's shingles can make similar
    by_pivot = minor.where(F.col("common") * most - F.col("n") >= F.col("least")).select("b", *mine("x")).join(around.select("b", *mine("y")), "b").where(sized & (F.least("x_p", "y_p") * most >= F.col("x_n") + F.col("y_n")))
    # pairs that share other shingles
    lists = _with_sets(around.select("a", "b", "common"), sets).select("a", "b", "common", "x", "y").mapInPandas(_prefixes(similarity), "a long, b long, items array<long>")
    item = F.explode("items").alias("item")
    placed = around.join(lists, ["a", "b"]).select("a", "b", "n", "common", "part", "pivot_part", item)
    met = placed.groupBy("b", "item").agg(F.count("*").alias("holders"), F.max((F.col("part") != F.col("pivot_part")).cast("int")).alias("minor")).where("holders > 1 AND minor = 1")
    lists = placed.join(met.select("b", "item"), ["b", "item"]).groupBy("a", "b", "n", "common", "part", "pivot_part").agg(F.collect_list("item").alias("items"))
    lists = written(lists, "prefixes")
    # a pair comes from the smallest item that both have, not from each of them
    first = F.array_min(F.array_intersect("x_items", "y_items")) == F.col("item")
    by_item = lists.where("part <> pivot_part").select("b", *mine("x"), F.col("items").alias("x_items"), item).join(lists.select("b", *mine("y"), F.col("items").alias("y_items"), item), ["b", "item"]).where(sized & first)
    pairs = by_pivot.select("x_a", "y_a").unionByName(by_item.select("x_a", "y_a")).select(F.least("x_a", "y_a").alias("a"), F.greatest("x_a", "y_a").alias("b")).distinct()
    more = _linked(_compared(pairs, sets), similarity)
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(more).distinct(), "links")
    classes = components(edges.select("a", "b"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))

    keyed = nodes.select("node").join(classes, "node", "left").join(degree, "node", "left").select("node", F.coalesce("component", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    done = written(worded.select("row", "doc_id", "node").join(keyed, "node").select("row", "doc_id", "class", "n_links"), "classes")
    # rows of a class are counted, and its first row found, without gathering a class in one task
    summary = done.groupBy("class").agg(F.count("*").alias("class_size"), F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "row"))["row"].alias("first"))
    joined = done.join(summary, "class").select("doc_id", "class_id", "class_size", "n_links", (F.col("row") == F.col("first")).alias("is_kept"))
    alone = table.where("n_words = 0 OR doc_id IS NULL")
    return joined.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("is_kept")))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with the columns of ``docs``.

    Rows with a null id stay.  Rows of the kept id and equal text are one row;
    different texts under the kept id all stay, be they in its class or not.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), similarity).where("is_kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    out = docs.join(kept, "doc_id").select(*docs.columns)
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.where("doc_id IS NULL"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
