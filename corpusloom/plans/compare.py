"""Compares registered queries with their SQL on the given tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def differences(spark: SparkSession, sf_dir: str, name: str, queries: dict | None = None, sqls: dict | None = None) -> str:
    """Empty if rows and columns agree, whatever their order; else what differs."""
    df = (queries or QUERIES)[name](spark, sf_dir)
    columns, rows = oracle(sf_dir, (sqls or ORACLE_SQL)[name])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    order = sorted(columns)
    own = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [columns.index(c) for c in order]
    other = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)
    if own == other:
        return ""
    a, b = set(map(repr, own)), set(map(repr, other))
    return f"{len(own)} and {len(other)} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"


def main(names: list[str], sf_dir: str) -> None:
    from .. import queries  # noqa: F401

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or sorted(ORACLE_SQL):
        begun = time.time()
        try:
            said = differences(spark, sf_dir, name)
        except Exception as e:  # noqa: BLE001  the report goes on
            said = str(e)[:900]
        print(f"{'ok' if not said else 'DIFFERENT'} {name} {time.time() - begun:.1f} s {said[:900]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
