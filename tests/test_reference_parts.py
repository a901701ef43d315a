"""Cross references of chunks are found once for a file and then dealt out in parts."""

from corpusloom.operators import neighbours as N


def test_cross_references_of_files(spark):
    """Chunks 1 and 2 are of file 0, 3 of file 1, and 4 of both; no table of all nodes of all chunks is made."""
    chunks = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (4, 1)], "id int, file int")
    nodes = spark.createDataFrame([(10, 0, 1), (11, 0, 2), (12, 0, None), (20, 1, 3), (21, 1, 4), (21, 0, 4)], "node int, file int, chunk int")
    edges = spark.createDataFrame([(12, 20), (10, 11), (12, 20), (20, 21)], "source int, target int")
    refs = N.cross_references(chunks, nodes, edges)
    got = sorted((r["id"], r["other"], r["relationship"]) for r in refs.collect())
    files, of = {1: {0}, 2: {0}, 3: {1}, 4: {0, 1}}, {10: {0}, 11: {0}, 12: {0}, 20: {1}, 21: {0, 1}}
    own = {10: 1, 11: 2, 20: 3, 21: 4}
    want = {(i, own[b], kind) for a, b, kind in [(s, t, "depends_on") for s, t in [(12, 20), (10, 11), (20, 21)]] + [(t, s, "used_by") for s, t in [(12, 20), (10, 11), (20, 21)]] for i in files if files[i] & of[a] and b in own and own[b] != i}
    assert got == sorted(want)
    assert "part" in refs._jdf.queryExecution().optimizedPlan().toString()
