import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import classify, graph, incremental
from corpusloom.operators import retrieval as R
from corpusloom.operators.filters import Rule, SearchFilter, apply_rules, compare


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokenizers(spark):
    assert one(spark, T.bm25_tokens(F.col("t")), t="The quick_brown foo-Bar 42 a x1") == ["quick", "brown", "foo", "bar", "x1"]
    assert one(spark, T.bm25_tokens(F.col("t"), split_camel=True), t="getUserName") == ["get", "user", "name"]
    assert one(spark, T.hybrid_tokens(F.col("t")), t="a.b c-d, e!") == ["a.b", "c-d"]
    assert one(spark, T.query_keywords(F.col("t")), t="how does the parser handle errors") == ["parser", "handle", "errors"]
    assert one(spark, T.phrases(F.col("t")), t="aa bb cc") == ["aa bb", "aa bb cc", "bb cc"]
    assert one(spark, T.phrases(F.col("t")), t="") == []


def test_int32_hash_wraps(spark):
    def java(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    for s in ("", "a", "hello world", "polygenelubricants", "zzzzzzzzzz"):
        assert one(spark, T.int32_hash(F.col("t")), t=s) == java(s)


def test_globs():
    import re

    assert re.match(T.glob_to_regex("node_modules/**"), "node_modules/a/b.js")
    assert re.match(T.glob_to_regex("**/*.py"), "x.py") and re.match(T.glob_to_regex("**/*.py"), "a/b/x.py")
    assert not re.match(T.glob_to_regex("*.py"), "a/x.py")


def test_similarities(spark):
    assert one(spark, T.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == 1 - 3 / 7
    assert one(spark, T.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    a = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, T.jaccard(a, F.array(F.lit("y"), F.lit("z")))) == 1 / 3
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert abs(one(spark, R.cosine(v(1, 0), v(1, 1))) - math.sqrt(0.5)) < 1e-12
    assert one(spark, R.cosine(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, R.cosine(v(1), v(1, 1))) == 0.0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "cat dog cat"), (1, "dog bird"), (2, "fish")], "id int, text string")
    index = R.term_index(docs, F.split("text", " "), "by-hand")
    q = spark.createDataFrame([(0, "cat", 2)], "qid int, term string, n int")
    got = {r["id"]: r["score"] for r in R.bm25(q, index).collect()}
    k = 1.2 * (0.25 + 0.75 * 3 / 2)
    assert abs(got[0] - 2 * math.log((3 - 1 + 0.5) / 1.5) * 2 / (2 + k)) < 1e-12 and len(got) == 1
    c = R.bm25(q, index, k1=1.5, variant="C").first()["score"]
    k = 1.5 * (0.25 + 0.75 * 3 / 2)
    assert abs(c - math.log(2.5 / 1.5) * 2 * 2.5 / (2 + k)) < 1e-12


def test_packing_loses_nothing(spark):
    rng = random.Random(4)
    texts = ["\n".join("x" * rng.randint(0, 30) for _ in range(rng.randint(1, 20))) for _ in range(30)] + ["", "\n\n", "y" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in df.select("id", C.packed_lines(F.col("t"), 60).alias("c")).collect():
        assert "\n".join(r["c"]) == texts[r["id"]]
        assert all(len(x) <= 60 or "\n" not in x for x in r["c"])


def test_sections_and_windows(spark):
    df = spark.createDataFrame([(1, "lost\n# A\none\ntwo\n### B\nthree")], "id int, t string")
    got = [(r["level"], r["title"], r["content"]) for r in C.sections(df, "id", "t").orderBy("section").collect()]
    assert got == [(1, "A", "one\ntwo"), (3, "B", "three")]
    w = C.line_windows(df, "id", "t", 4).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in w] == [(1, 4), (5, 6)]


def test_tag_sections(spark):
    pages = [
        (1, "<nav a='1'>x</nav><main>m\n<article>in</article></main><article>p</article>\n<ARTICLE>q</ARTICLE><aside></aside><footer>f</footer>"),
        (2, "one\ntwo\n \n\nthree <navy>n</navy>\n\n"), (3, None), (4, "<header>a</header><section>b</section><section>c</section>"),
    ]
    df = spark.createDataFrame(pages, "id int, html string")
    got = {r["id"]: [tuple(x) for x in r["s"]] for r in df.select("id", C.tag_sections(F.col("html")).alias("s")).collect() if r["s"] is not None}
    assert got == {
        1: [("nav", "x"), ("main", "m\n<article>in</article>"), ("article", "p"), ("article", "q"), ("footer", "f")],
        2: [("section_0", "one\ntwo"), ("section_1", "three <navy>n</navy>")],
        4: [("header", "a"), ("section", "b"), ("section", "c")],
    }


def test_code_blocks(spark):
    js = "class A {\n  run() { if (a) { b(); } }\n}\nfunction f(x) { return x && y; }\n"
    py = "class P:\n    def m(self):\n        return 1\n\n\ndef g():\n    for i in x:\n        pass\nz = 1\n"
    df = spark.createDataFrame([(1, js, "javascript"), (2, py, "python"), (3, None, "java"), (4, "class X { open", "java")], "id int, code string, language string")
    got = {(r["id"], r["kind"], r["name"]): r for r in C.code_blocks(df, "id", "code", "language").collect()}
    assert set(got) == {(1, "class", "A"), (1, "function", "f"), (2, "class", "P"), (2, "function", "m"), (2, "function", "g"), (4, "class", "X")}
    assert got[1, "class", "A"]["content"] == js[: js.index("\nfunction")] and got[1, "function", "f"]["complexity"] == 2
    assert got[2, "function", "g"]["content"] == "def g():\n    for i in x:\n        pass"
    assert got[2, "class", "P"]["end_line"] == 3


def test_endpoints(spark):
    text = "app.get('/users/:id', f)\n@app.post('/items')\n@bp.route('/x/<int:n>', methods=['DELETE'])\n@bp.route('/y')\n@GetMapping(\"/z/{k}\")"
    got = {tuple(r)[1:] for r in classify.endpoints(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()}
    assert got == {("express", "GET", "/users/:id"), ("fastapi", "POST", "/items"), ("flask", "DELETE", "/x/:n"), ("flask", "GET", "/y"), ("spring-boot", "GET", "/z/:k")}


def test_filters_and_rules(spark):
    df = spark.createDataFrame([(0, "src/a.py", None, 1.0), (1, "src/b.ts", 7, 1.0), (2, "lib/c.py", 12, 1.0)], "chunk_idx int, file_path string, complexity int, score double")
    assert [r[0] for r in df.where(SearchFilter(path_contains="src", min_complexity=0).condition()).collect()] == [0, 1]
    assert [r[0] for r in df.where(SearchFilter(max_complexity=7).condition()).collect()] == [0, 1]
    assert df.where(compare("file_path", "unknown", 1)).count() == 3
    out = apply_rules(df, [Rule("exclude", [("file_path", "startsWith", "lib")]), Rule("boost", [("complexity", "exists", None)], 0.5)])
    assert {r["chunk_idx"]: r["score"] for r in out.collect()} == {0: 1.0, 1: 1.5}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "8")], "path string, content_hash string")
    found = incremental.changes(old, new)
    assert {tuple(r) for r in found.collect()} == {("b", None, "modified"), ("x", "c", "moved"), ("y", None, "added"), ("d", None, "deleted")}
    assert {tuple(r) for r in incremental.apply_changes(old, found, new).collect()} == {tuple(r) for r in new.collect()}
    assert incremental.changes(old, old).isEmpty()


def test_long_paths(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(23)] + [(23, 0)], "source int, target int")
    start = spark.createDataFrame([(0,)], "node int")
    assert {tuple(x) for x in graph.reachable(spark, e, start).collect()} == {(0, i, i or 24) for i in range(24)}
    with pytest.raises(RuntimeError):
        graph.reachable(spark, e, start, 3)
    with pytest.raises(RuntimeError):
        graph.weak_components(spark, e, 1)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (8, 9)], "source int, target int")
    r = graph.reachable(spark, e, e.select(F.col("source").alias("node")).distinct())
    assert {tuple(x) for x in r.where("start = 1").collect()} == {(1, 2, 1), (1, 3, 2), (1, 1, 3), (1, 4, 3)}
    assert {tuple(x) for x in graph.circular_edges(r, e).collect()} == {(1, 2), (2, 3), (3, 1), (5, 5)}
    assert {tuple(x) for x in graph.weak_components(spark, e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (8, 8), (9, 8)}
