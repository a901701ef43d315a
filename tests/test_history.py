"""As-of joins, running totals, blame and status texts by hand or by brute force."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import history as H


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("period", ["year", "day", None])
def test_as_of(spark, before, period):
    rng = random.Random(9)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(900))
    right = [(rng.choice("ab") if i % 3 else "hot", day(), i, f"v{i}") for i in range(150)] + [(None, date(2020, 5, 5), 900, "x"), ("a", None, 901, "x")]
    right += [(k, d, n + 200, f"w{n}") for k, d, n, _ in right[:30] if k and d]
    left = [(i, rng.choice(["a", "b", "hot", "absent"]), rng.choice([day(), rng.choice(right[:150])[1], date(2019, 1, 1)])) for i in range(120)] + [(500, None, date(2021, 1, 1)), (501, "a", None)]
    r, asked = spark.createDataFrame(right, "k string, t date, n int, v string").repartition(3), spark.createDataFrame(left, "id int, k string, t date")
    got = H.as_of(asked, r, "k", "t", ["n"], F.date_trunc(period, "t") if period else F.lit(0), before)
    assert got.columns == ["id", "k", "t", "last"]
    found = {x["id"]: (x["k"], x["t"], x["last"] and x["last"]["v"]) for x in got.collect()}
    want = {}
    for i, k, t in left:
        rows = [(d, n, v) for kk, d, n, v in right if kk == k and k and d and t and (d < t if before else d <= t)]
        want[i] = (k, t, max(rows)[2] if rows else None)
    assert found == want


def test_totals_and_versions(spark):
    d = [datetime(2024, 1, 1), datetime(2024, 1, 1, 12), datetime(2024, 1, 3)]
    rows = [("c1", d[0], "ann", "a", 10, 0), ("c1", d[0], "ann", "b", 5, 1), ("c2", d[0], "bob", "a", 3, 8), ("c3", d[1], "ann", "c", 7, 0), ("c4", d[2], "cy", "a", 1, 1), ("c4", d[2], "cy", "a", 2, 0)]
    c = spark.createDataFrame(rows, "hash string, date timestamp, author string, path string, additions long, deletions long")
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in H.commit_totals(c, F.to_date("date")).collect())
    assert got == [("c1", 2, 2, 14), ("c2", 1, 2, 9), ("c3", 1, 3, 16), ("c4", 1, 3, 18)]
    got = sorted((r["path"], r["version"], r["hash"], r["lines"], r["previous_hash"], r["days"]) for r in H.file_versions(c).collect())
    assert got == [("a", 1, "c1", 10, None, None), ("a", 2, "c2", 5, "c1", 0), ("a", 3, "c4", 7, "c2", 2), ("b", 1, "c1", 4, None, None), ("c", 1, "c3", 7, None, None)]


def test_blame(spark):
    a, b = "a" * 40, "b" * 40
    text = f"{a} 1 1 2\nauthor Ann Lee\nauthor-mail <ann@x>\nauthor-time 1700000000\nsummary First\n\tauthor is a word\n{a} 2 2\n\t\n{b} 9 3 1\nauthor Bob\nauthor-time 1600000000\nsummary Fix: it\n\tend"
    got = sorted((r["path"], r["line"], r["hash"][0], r["author"], r["author_time"].timestamp(), r["summary"], r["content"]) for r in H.blame_lines(spark.createDataFrame([("f", text), ("g", "no blame"), ("h", None)], "path string, value string")).collect())
    assert got == [("f", 1, "a", "Ann Lee", 1700000000.0, "First", "author is a word"), ("f", 2, "a", "Ann Lee", 1700000000.0, "First", ""), ("f", 3, "b", "Bob", 1600000000.0, "Fix: it", "end")]


def test_status(spark):
    text = "M  staged.py\n M dirty.py\nMM both.py\n?? new file.py\nR  old.py -> new.py\n"
    got = sorted((r["path"], r["old_path"], r["state"]) for r in H.status_entries(spark.createDataFrame([("r", text), ("e", ""), ("n", None)], "repository string, value string")).collect())
    assert got == [("both.py", None, "staged"), ("both.py", None, "unstaged"), ("dirty.py", None, "unstaged"), ("new file.py", None, "untracked"), ("new.py", "old.py", "staged"), ("staged.py", None, "staged")]


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Shuffles have a partition for each part of the input files, never fewer than are set."""
    from corpusloom.plans import changes
    from corpusloom.sources import stored

    d = [datetime(2024, 1, 1), datetime(2024, 1, 3)]
    spark.createDataFrame([(i, i % 7, 10.0, d[i % 2]) for i in range(40)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 40, i % 9, i // 40, 5.0, 0.1, 100.0, d[i % 2], i % 3) for i in range(120)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_shipdate timestamp, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for query in (changes.totals_at_commits, changes.last_changes_as_of):
            spark.conf.set("spark.sql.shuffle.partitions", before)
            plain = sorted(map(repr, query(spark, str(tmp_path)).collect()))
            assert spark.conf.get("spark.sql.shuffle.partitions") == before
            with monkeypatch.context() as m:
                m.setattr(stored, "PART_BYTES", 100)
                got = query(spark, str(tmp_path))
                assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 20
                assert sorted(map(repr, got.collect())) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
