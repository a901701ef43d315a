"""The pipeline's stages against brute force."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe

from .test_operators import ROWS, SCHEMA, classes, removed


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    every = {r[0]: r[1] for r in ROWS if r[0] is not None}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    worded = {i: t for i, t in every.items() if t and any(map(str.isalpha, t))}
    assert sorted(r["doc_id"] for r in out["language ID"]) == sorted([*worded, 0])
    label = classes(list(worded.items()))
    assert sorted(r["doc_id"] for r in out["MinHash near-dedup"]) == sorted(set(label.values()))
    left = {r["doc_id"]: r["text"] for r in out["MinHash near-dedup"]}
    want = {i: removed(list(left.items()), 50, i, t) for i, t in left.items()}
    got = {r["doc_id"]: r["text"] for r in out["substring dedup"]}
    assert set(got) == {i for i, (n, k, _) in want.items() if k < n or not n}
    for i, t in got.items():
        assert t == left[i] if not want[i][1] else hashlib.sha256(t.encode()).hexdigest() == want[i][2]
    mixed = {r["doc_id"]: r["text"] for r in out["mixing sources"]}
    assert mixed.items() <= got.items() and len(mixed) > len(got) / 2
    coder = bpe.Codec(bpe.default_path())
    final = {r["doc_id"]: r for r in out["BPE encoding"]}
    assert set(final) == set(mixed) and all(coder.decode(__import__("numpy").array(r["ids"])) == mixed[i] for i, r in final.items())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()) == sorted(final)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, columns of clashing names, and tables without rows, for each stage by itself."""
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("class_id", F.lit(1)).withColumn("op6_places", F.lit("x")).withColumn("tokens", F.lit("t"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (docs.unionByName(docs.limit(3)), docs.limit(0), docs.where("doc_id IS NULL"), docs.withColumn("text", F.lit(None).cast("string"))):
            out = stage(spark, rows, str(tmp_path)).collect()
            assert len(out) <= rows.count() or name == "BPE encoding"
            if k == 3 and out:
                assert set(out[0].asDict()) == set(corpus_pipeline.COLUMNS)
