"""Ranked lexical search against brute force."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical as x

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
RNG = random.Random(8)
COMMON, RARE = [f"c{i}" for i in range(12)], [f"r{i}é" for i in range(150)]
SCHEMA = "doc_id long, text string, rank string, terms array<int>"


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    big_n, big_l = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for d, bag, n in bags:
            m = 25 + 75 * n * big_n // big_l if big_l else 1
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def text(n):
    topic = RNG.randrange(10)
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.4 else RARE[15 * topic + RNG.randrange(15)] if RNG.random() < 0.8 else RNG.choice(RARE) for _ in range(n))


SAME = text(30)
DOCS = [(None, SAME), (1, None), (2, ""), (3, " ,; "), (4, SAME), (4, SAME), (5, SAME + " tail"), (6, text(5000))] + [(7 + i, text(RNG.randint(1, 90))) for i in range(500)] + [(900 + i, SAME) for i in range(40)]
ITEMS = [(1, SAME), (1, SAME.upper() + "!"), (2, "c1-C1 c1"), (3, None), (4, "?"), (5, "absent words"), (None, text(12))] + [(10 + i, text(RNG.randint(2, 40))) for i in range(40)]


def searched(spark, docs, items, k=10):
    df = spark.createDataFrame([(d, t, "s", [1]) for d, t in docs], SCHEMA).repartition(3)
    found = x.search(df, spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted(map(tuple, found.collect()), key=repr) if found is not None else []


@pytest.mark.parametrize(("block", "cells", "seeds", "k"), [(512, 4 << 20, 4096, 10), (15, 1, 20, 3)])
def test_best_documents(spark, monkeypatch, block, cells, seeds, k):
    for name, value in (("BLOCK_ITEMS", block), ("CELLS", cells), ("SEEDS", seeds)):
        monkeypatch.setattr(x, name, value)
    assert searched(spark, DOCS, ITEMS, k) == brute(DOCS, ITEMS, k)


def test_empty_tables(spark):
    assert searched(spark, [], ITEMS) == searched(spark, [(1, None), (2, " ")], ITEMS) == []
    assert searched(spark, DOCS, [(3, None), (4, "?")]) == searched(spark, DOCS, []) == []


def test_whole_batches_are_pruned():
    """Batches whose bound is below every item's kth score are not scored, and the result is that of scoring all."""
    rng = np.random.default_rng(2)
    terms_ = np.arange(400, dtype=np.uint64)
    block = x.Block(list(range(60)), terms_, [(np.sort(rng.choice(100, 8, False)) + 100 * (i % 4), np.ones(8, np.int64)) for i in range(60)])
    search = x.Search(block, np.full(400, 5000), 4000, 80_000, np.zeros(60, np.int64))
    every = []
    for b in range(20):
        n = rng.integers(5, 60, 200) if b < 4 else np.full(200, 500)
        held = [np.sort(rng.choice(100, min(int(s), 40), False)) + 100 * (b % 4) for s in n]
        rows = search.coordinates(n, np.repeat(np.arange(200), [len(h) for h in held]), np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
        search.batch(np.arange(200) + 200 * b, rows)
        every.append(rows)
    weights = np.zeros((60, 400))
    for i, (t, c) in enumerate(block.items):
        weights[i, t] = c * 5000
    scores = (weights @ np.concatenate(every).T).astype(np.int64)
    for i in range(60):
        first = np.lexsort((np.arange(4000), -scores[i]))[:10]
        assert search.best[i][1].tolist() == first.tolist() and search.best[i][0].tolist() == scores[i][first].tolist()
    assert search.scored < 0.25 * scores.size


def test_large_weights_are_integers():
    block = x.Block([1], np.arange(2, dtype=np.uint64), [(np.array([0, 1]), np.array([1 << 26, 1]))])
    search = x.Search(block, np.array([40_000, 39_999]), 10, 100, np.zeros(1, np.int64))
    rows = search.coordinates(np.array([3]), np.array([0, 0]), np.array([0, 1]), np.array([7, 2]))
    search.batch(np.array([5]), rows)
    assert search.kind is np.int64 and search.best[0][0].tolist() == [int(rows[0, 0]) * 40_000 * (1 << 26) + int(rows[0, 1]) * 39_999]
