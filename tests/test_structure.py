"""JSON of any depth and marked texts, by hand and against Python's parser."""

import json
import random

from pyspark.sql import functions as F

from corpusloom.functions import structure as S


def leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}" if k.isidentifier() and k.isascii() else f'{path}."{k}"')]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
    if isinstance(value, (dict, list)):
        return [(path, "EMPTY", None)]
    if value is None:
        return [(path, "NULL", None)]
    if isinstance(value, bool):
        return [(path, "BOOLEAN", str(value).lower())]
    return [(path, "STRING" if isinstance(value, str) else "NUMBER", value if isinstance(value, str) else str(value))]


def made(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind > 4:
        return {rng.choice(["a", "b_1", "c d", "é", "x.y"]): made(rng, depth - 1) for _ in range(rng.randrange(4))} if kind < 7 else [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.randrange(10**9), rng.choice(["", "text", "line\nbreak", "日本"]), 0.5][kind]


def test_leaves(spark):
    rng = random.Random(2)
    texts = {i: made(rng, 7) for i in range(60)} | {60: {}, 61: [], 62: [[[[[[[[["deep"]]]]]]]]], 63: "plain", 64: None}
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2))) for i, v in texts.items()]
    bad = [(100, "{"), (101, ""), (102, '{"a": 1, "a": 2}'), (103, None), (104, "[1,]")]
    got = sorted(map(tuple, S.json_leaves(spark.createDataFrame([*rows, *bad], "id long, t string"), "id", "t").collect()), key=repr)
    want = [(i, *leaf) for i, v in texts.items() for leaf in leaves(v)] + [(i, "$", "INVALID", None) for i in (100, 101, 102, 104)]
    assert got == sorted(want, key=repr)
    assert S.json_leaves(spark.createDataFrame([], "id long, t string"), "id", "t").collect() == []


def test_marks(spark):
    rows = [
        ("json", '{"b": [1, 2], "a": {"z": null}}', '{"a":{"z":null},"b":[1,2]}'), ("json", "{oops", "{oops"),
        ("yml", "server:\n  port: 80\n  # note:\n  hosts:  ", "server: # Configuration section\n  port: 80\n  # note:\n  hosts: # Configuration section"),
        ("properties", "# c\ndb.url=x\n\napp.name=y\ndb.user=z", "# DB Configuration\ndb.url=x\ndb.user=z\n\n# APP Configuration\napp.name=y\n\n"),
        ("xml", "<?xml?><a x='1'><!-- n --><b/></a>", "<?xml?><a x='1'> <!-- Configuration element --><!-- n --><b/> <!-- Configuration element --></a>"),
        ("htm", "<p>x</p><H2 id=a>t</H2>", "<p>x</p>\n<H2 id=a> <!-- Template section -->\nt</H2>"), ("md", "# One\ntext\n###  Two", "# One\n<!-- Section: One -->\n\ntext\n### Two\n<!-- Section: Two -->\n"),
        ("txt", "# stays", "# stays"), ("md", None, None),
    ]
    df = spark.createDataFrame([(i, e, t) for i, (e, t, _) in enumerate(rows)], "i int, e string, t string")
    assert [r["s"] for r in df.select("i", S.structured(F.col("t"), F.col("e")).alias("s")).orderBy("i").collect()] == [w for *_, w in rows]


def test_levels_are_opened_together(spark, monkeypatch):
    """Texts of five levels are written once, as their plain values; one of ten levels goes on alone."""
    kept = []
    keep = S.Rounds.keep
    monkeypatch.setattr(S.Rounds, "keep", lambda self, name, df: (out := keep(self, name, df), kept.append(out.count()))[0])
    five = '{"items": [{"part": {"path": [1, 2]}, "none": [], "no": null}]}'
    rows = [(i, five) for i in range(20)]
    leaves_of = lambda r: sorted(tuple(x) for x in S.json_leaves(spark.createDataFrame(r, "id long, t string"), "id", "t").collect() if x[0] == r[-1][0])
    want = [("$.items[0].no", "NULL", None), ("$.items[0].none", "EMPTY", None), ("$.items[0].part.path[0]", "NUMBER", "1"), ("$.items[0].part.path[1]", "NUMBER", "2")]
    assert leaves_of(rows) == [(19, *w) for w in want] and kept == [80]
    kept.clear()
    assert leaves_of([*rows, (20, "[" * 10 + "{}" + "]" * 10)]) == [(20, "$" + "[0]" * 10, "EMPTY", None)] and kept == [81, 1]
