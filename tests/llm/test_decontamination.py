"""Benchmark decontamination against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
RNG = random.Random(3)
FEW = "a b ab ba é 7 İ".split()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if g := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= g
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return out


def passage(n):
    return " ".join(RNG.choice(FEW) for _ in range(n))


ITEMS = [(1, passage(40)), (2, passage(14)), (2, passage(12)), (3, "a, B; ab"), (4, None), (5, " ;,"), (None, passage(11)), (10, passage(10)), (1, passage(9)), (11, "ba a")]
DOCS = [(None, passage(30)), (1, None), (2, ""), (3, ITEMS[0][1].upper() + "!"), (3, ITEMS[0][1].upper() + "!"), (4, "ab\n" + ITEMS[1][1].replace(" ", " -- ")), (5, "a b"), (6, passage(3000))]
DOCS += [(7 + i, passage(RNG.randint(1, 60))) for i in range(60)]


@pytest.mark.parametrize(("window", "shard"), [(10, 100_000), (10, 13), (3, 25), (1, 7)])
def test_hits(spark, monkeypatch, window, shard):
    monkeypatch.setattr(d, "SHARD_WORDS", max(shard, window))
    docs = spark.createDataFrame([(*r, "x", [1]) for r in DOCS], "doc_id long, text string, items string, n_hit array<int>").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], [p for b, e in zip(r["span_begin"], r["span_end"]) for p in range(b, e)], r["items"]) for r in d.matches(docs, items, window).collect()), key=repr)
    assert got == sorted(brute(DOCS, ITEMS, window), key=repr)
    assert all(r["n_hit"] == sum(e - b for b, e in zip(r["span_begin"], r["span_end"])) for r in d.matches(docs, items, window).collect())


def test_longest_match():
    a = d.Automaton([("x", np.arange(20, dtype=np.uint64)), ("y", np.arange(5, 18, dtype=np.uint64)[::-1].copy())], 4)
    assert [(i, n) for i, _, n, _ in a.stream([3, 4, 5, 6, 7, 8, 0, 17, 16, 15, 14])] == [(3, 4), (4, 5), (5, 6), (10, 4)]


def test_removal(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"Before, {long}. After " + "rest " * 60), (2, "(" + long.upper() + ") end"), (3, "clean text"), (4, None), (5, "x " + " ".join(long.split()[:12]) + " y" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], r["rejected"]) for r in d.decontaminate(docs, spark.createDataFrame([(1, long)], "item_id long, text string"), least_words=20).collect()}
    assert got == {1: ("Before, . After " + "rest " * 60, False), 2: ("() end", True), 3: ("clean text", False), 4: (None, False), 5: (rows[4][1], False)}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.matches(none, items).collect() == []
    got = d.matches(spark.createDataFrame(DOCS[:4], "doc_id long, text string"), items.where("false")).select("n_words", "n_hit", F.sha2(F.concat_ws(",", "items"), 256)).collect()
    assert [tuple(r) for r in got] == [(len(words(t)), 0, hashlib.sha256(b"").hexdigest()) for _, t in DOCS[:4]]
