"""The vector index against brute force, and cross references by hand."""

import numpy as np
import pytest

from corpusloom.operators import neighbours as N

RNG = np.random.default_rng(4)


def brute(ids, x, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {q: [ids[j] for j in np.lexsort((ids, -np.round(u @ u[i], 12))) if ids[j] != q][:k] for i, q in enumerate(ids) if q in asked}


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id long, v array<float>").repartition(3)


@pytest.mark.parametrize("groups", [None, 40])
def test_recall(spark, monkeypatch, groups):
    if groups:
        monkeypatch.setattr(N, "GROUP_ROWS", groups)
        monkeypatch.setattr(N, "GROUP_QUERIES", 7)
    x = np.concatenate([RNG.standard_normal((20, 16))[RNG.integers(0, 20, 900)] * 3 + RNG.standard_normal((900, 16)), np.repeat(RNG.standard_normal((1, 16)), 300, axis=0)]).astype(np.float32).astype(float)
    ids = np.arange(len(x))
    df = frame(spark, ids, x)
    cells = N.learned(df, "v", 16, 10)
    assert cells.visits < len(cells.centres)
    got = {}
    for r in N.nearest(df, df.where("id % 20 = 0"), 10, 16, cells=cells).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r)
    want = brute(ids, x, set(range(0, 1200, 20)), 10)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == set(want) and all(len(v) == 10 and q not in {r["id"] for r in v} for q, v in got.items())
    assert all(abs(r["similarity"] - u[q] @ u[r["id"]]) < 1e-9 for q, v in got.items() for r in v)
    # as alike as the true ones; equal vectors are interchangeable
    assert np.mean([abs(a["similarity"] - u[q] @ u[b]) < 1e-9 for q in want for a, b in zip(got[q], want[q])]) >= 0.9
    every = N.nearest(df, df.where("id % 20 = 0"), 10, 16, cells=N.Cells(cells.centres, len(cells.centres))).orderBy("query", "rank").collect()
    assert [r["id"] for r in every if r["query"] < 900] == [b for q in sorted(want) if q < 900 for b in want[q]]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [(r["query"], r["id"], round(r["similarity"], 9), r["rank"]) for r in N.nearest(df, df, 5, 2).orderBy("query", "rank").collect()]
    assert got == [(1, 2, 1.0, 1), (1, 3, 0.0, 2), (2, 1, 1.0, 1), (2, 3, 0.0, 2), (3, 1, 0.0, 1), (3, 2, 0.0, 2)]
    assert N.nearest(df.where("id > 3"), df, 5, 2).collect() == []


def test_cross_references(spark):
    chunks = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g"), ("d", "h")], "id string, file string")
    nodes = spark.createDataFrame([(1, "f", "a"), (2, "g", "c"), (3, "h", "d"), (4, "f", None)], "node long, file string, chunk string")
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (1, 1), (2, 4)], "source long, target long")
    got = sorted((r["id"], r["other"], r["relationship"]) for r in N.cross_references(chunks, nodes, edges).collect())
    assert got == [("a", "c", "depends_on"), ("a", "c", "used_by"), ("a", "d", "used_by"), ("b", "a", "depends_on"), ("b", "a", "used_by"), ("b", "c", "depends_on"), ("b", "c", "used_by"), ("b", "d", "used_by"), ("c", "a", "used_by")]


def test_neighbours_of_equal_ids_and_of_many_groups(spark, monkeypatch):
    """Rows of one id are one document, and groups of any size give the same neighbours as all pairs."""
    import random

    from pyspark.sql import functions as F

    from corpusloom.operators import hierarchy as H

    rng = random.Random(3)
    rows = [(rng.randrange(60), " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))) for _ in range(90)]
    sets = {}
    for i, text in rows:
        sets.setdefault(i, set()).update(text.split())
    want = {}
    for a, x in sets.items():
        near = sorted((-round(len(x & y) / len(x | y), 6), b) for b, y in sets.items() if b != a and len(x & y) / len(x | y) > 0.1)
        want |= {(a, b): (-s, i + 1) for i, (s, b) in enumerate(near[:5])}
    monkeypatch.setattr(H, "GROUP_ROWS", 20)
    monkeypatch.setattr(H, "GROUP_QUERIES", 15)
    docs = spark.createDataFrame(rows, "id long, text string")
    got = H.neighbours(docs, F.split("text", " "), 5, 0.1).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): (r["similarity"], r["rank"]) for r in got} == want
