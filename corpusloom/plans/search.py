"""Retrieval queries: statistics, BM25, vectors, hybrid search and ranking."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..sources.stored import Rounds
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query
from .texts import bm25_tokens_sql, hybrid_tokens_sql

_INDEX_SQL = f"""tok AS (SELECT doc_id AS id, unnest({bm25_tokens_sql('text')}) AS term FROM documents),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
size AS (SELECT count(*) AS n, (SELECT sum(dl) FROM dl) / CAST(count(*) AS DOUBLE) AS avgdl FROM documents),
q AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest({bm25_tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL)"""


def _bm25_sql(idf: str, part: str, k1: float) -> str:
    return f"SELECT qid, id, sum({idf} * {part.format(k=f'({k1} * (0.25 + 0.75 * dl / avgdl))')}) AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (id) CROSS JOIN size GROUP BY qid, id"


_IDF_A = "ln((n - df + 0.5) / (df + 0.5))"
_BM25_A = _bm25_sql(_IDF_A, "tf / (tf + {k}) * times", 1.2)
_BM25_B = _bm25_sql("ln((n + 1.0) / (df + 1))", "tf / (tf + {k})", 1.2)
_BM25_C = _bm25_sql(_IDF_A, "tf * 2.5 / (tf + {k})", 1.5)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _index(spark: SparkSession, sf_dir: str) -> R.TermIndex:
    """The BM25 index of all documents."""
    return R.term_index(_documents(spark, sf_dir), T.bm25_tokens(F.col("text")), "bm25")


def _hybrid_index(spark: SparkSession, sf_dir: str) -> R.TermIndex:
    """The positional index of all documents with the tokens of the hybrid engine."""
    return R.term_index(_documents(spark, sf_dir), T.hybrid_tokens(F.col("text")), "hybrid")


def _queries(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """All terms of each benchmark passage, or of other items (item_id, text)."""
    items = table(spark, sf_dir, "benchmark") if items is None else items
    terms = items.select(F.col("item_id").alias("qid"), F.explode(T.bm25_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("qid", "term").agg(F.count("*").alias("n"))


@query(f"""WITH {_INDEX_SQL} SELECT term, CAST(df AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM post JOIN df USING (term) GROUP BY ALL""")
def corpus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"""WITH {_INDEX_SQL} SELECT CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl, (SELECT CAST(count(*) AS BIGINT) FROM df) AS vocabulary FROM size""")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    terms = index.frequencies.agg(F.count("*").alias("vocabulary"))  # one row each
    return index.size.crossJoin(terms).select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"), "vocabulary")


def _top_sql(scores: str, keep: str = "score > 0") -> str:
    return f"WITH {_INDEX_SQL}, s AS ({scores}), r AS (SELECT qid, id, round(score, 6) AS score FROM s WHERE {keep}) SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM r) WHERE rank <= 10"


def _top(spark: SparkSession, sf_dir: str, variant: str, k1: float) -> DataFrame:
    scores = R.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), k1=k1, variant=variant).withColumn("score", F.round("score", 6))
    return R.top_k(scores.where("score > 0"), 10, group="qid").select("qid", "id", "score", "rank")


@query(_top_sql(_BM25_A))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "A", 1.2)


@query(_top_sql(_BM25_B))
def bm25_sparse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "B", 1.2)


@query(_top_sql(_BM25_C))
def bm25_search_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "C", 1.5)


_POS_SQL = f"""tok AS (SELECT doc_id AS id, unnest({hybrid_tokens_sql('text')}) AS term, generate_subscripts({hybrid_tokens_sql('text')}, 1) - 1 AS pos FROM documents),
post AS (SELECT id, term, count(*) AS tf, sum(pos) AS pos_sum FROM tok GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id),
qt AS (SELECT item_id AS qid, unnest({hybrid_tokens_sql('text')}) AS term, generate_subscripts({hybrid_tokens_sql('text')}, 1) AS at FROM benchmark), q AS (SELECT DISTINCT qid, term FROM qt),
pairs AS (SELECT a.qid, a.at, a.term AS l, b.term AS r FROM qt a JOIN qt b ON a.qid = b.qid AND b.at = a.at + 1),
grams AS (SELECT DISTINCT id, l, r FROM (SELECT id, term AS l, lead(term) OVER (PARTITION BY id ORDER BY pos) AS r FROM tok) WHERE r IS NOT NULL),
phrases AS (SELECT qid, id, count(*) * 0.1 AS bonus FROM pairs JOIN grams USING (l, r) GROUP BY ALL)"""
_KEYWORD_SQL = """SELECT qid, id, terms + coalesce(bonus, 0) AS score FROM (
SELECT qid, id, sum(tf / CAST(dl AS DOUBLE) * (1 + 0.2 * greatest(0, 1 - pos_sum / CAST(tf AS DOUBLE) / dl))) AS terms FROM post JOIN q USING (term) JOIN dl USING (id) GROUP BY qid, id) LEFT JOIN phrases USING (qid, id)"""


@query(f"""WITH {_POS_SQL}, s AS ({_KEYWORD_SQL}), r AS (SELECT qid, id, round(score, 6) AS score FROM s) SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM r) WHERE rank <= 10""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term shares with a bonus for early positions and for neighbouring terms that stand together."""
    scores = R.keyword_scores(*_keyword_terms(spark, sf_dir), _hybrid_index(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return R.top_k(scores, 10, group="qid").select("qid", "id", "score", "rank")


def _keyword_terms(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The different terms of each item and its neighbouring terms."""
    items = (table(spark, sf_dir, "benchmark") if items is None else items).select(F.col("item_id").alias("qid"), T.hybrid_tokens(F.col("text")).alias("t"))
    q = items.select("qid", F.explode(F.array_distinct("t")).alias("term"))
    pairs = items.select("qid", F.posexplode(F.arrays_zip(F.col("t").alias("left"), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))).alias("right"))).alias("at", "p")).select("qid", "at", "p.left", "p.right")
    return q, pairs.where("right IS NOT NULL")


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"


@query(f"""WITH s AS (SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT id, score FROM s WHERE score > 0.1 ORDER BY score DESC, id LIMIT 30""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine top k above a threshold; the query is one vector."""
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    s = e.crossJoin(q).select(F.col("vec_id").alias("id"), F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return R.top_k(s.where("score > 0.1"), 30)


_STORE_QUERY = "run8"
#: Metadata that holds the query: column, weight (fixed values).
_META = [("class_name", 0.5), ("function_name", 0.5), ("file_name", 0.3), ("framework", 0.2)]
_META_SQL = "least(1.0, " + " + ".join(f"CASE WHEN contains(lower({c}), {chr(39)}{_STORE_QUERY}{chr(39)}) THEN {w} ELSE 0 END" for c, w in _META) + ")"
#: Words of the query beside its text: those of one benchmark passage, so that it meets documents.
_STORE_TERMS_SQL = f"(SELECT 0 AS item_id, unnest({bm25_tokens_sql(chr(39) + _STORE_QUERY + chr(39))}) AS term UNION ALL SELECT 0, term FROM (SELECT unnest({bm25_tokens_sql('text')}) AS term FROM benchmark WHERE item_id = 0))"

_HYBRID_SQL = f"""WITH {CHUNKS_SQL}, {_INDEX_SQL.replace(f"(SELECT item_id, unnest({bm25_tokens_sql('text')}) AS term FROM benchmark)", _STORE_TERMS_SQL)},
k AS ({_BM25_A}),
w AS (SELECT id, term, ln((n + 1.0) / (df + 1)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM post JOIN df USING (term) JOIN dl USING (id) CROSS JOIN size),
qw AS (SELECT term, ln((n + 1.0) / (coalesce(df, 1) + 1)) * times / (times + 1.2 * (0.25 + 0.75 * (SELECT sum(times) FROM q) / avgdl)) AS qw FROM q LEFT JOIN df USING (term) CROSS JOIN size),
sp AS (SELECT id, sum(w * qw) / ((SELECT sqrt(sum(qw * qw)) FROM qw) * any_value(norm)) AS sparse FROM w JOIN qw USING (term) JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id) USING (id) GROUP BY id),
v AS (SELECT e.vec_id AS id, {_COS} AS dense FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
a AS (SELECT chunk_idx, c.id AS chunk, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse, coalesce(score, 0) AS keyword, CAST({_META_SQL} AS DOUBLE) AS meta FROM (SELECT *, regexp_extract(file_path, '[^/]+$') AS file_name FROM chunks) c LEFT JOIN k ON k.id = chunk_idx LEFT JOIN v ON v.id = chunk_idx LEFT JOIN sp ON sp.id = chunk_idx WHERE language IN ('en', 'de')),
s AS (SELECT *, 0.4 * dense + 0.3 * sparse + 0.3 * keyword + 0.1 * meta AS total FROM a)
SELECT chunk AS id, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(keyword, 6) AS keyword, round(meta, 6) AS metadata, round(total, 6) AS score FROM s WHERE total > 0.1 ORDER BY round(total, 6) DESC, chunk_idx LIMIT 10"""


@query(_HYBRID_SQL)
def hybrid_search_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense, sparse, keyword and metadata scores of filtered chunks, added by weight, thresholded and cut to the first ten."""
    index = _index(spark, sf_dir)
    words = spark.range(1).select(F.explode(T.bm25_tokens(F.lit(_STORE_QUERY))).alias("term"))
    more = table(spark, sf_dir, "benchmark").where("item_id = 0").select(F.explode(T.bm25_tokens(F.col("text"))).alias("term"))
    q = words.unionByName(more).groupBy("term").agg(F.count("*").alias("n")).withColumn("qid", F.lit(0))
    leg = lambda df, name: df.select(F.col("id").alias("chunk_idx"), F.col("score").alias(name))
    keyword = leg(R.bm25(q, index), "keyword")
    sparse = leg(R.sparse_cosine(q, index, R.sparse_vectors(index, "bm25")), "sparse")
    e = table(spark, sf_dir, "embeddings")
    one = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    dense = e.crossJoin(one).select(F.col("vec_id").alias("chunk_idx"), R.cosine(F.col("embedding"), F.col("q")).alias("dense"))
    c = chunks(spark, sf_dir).where(F.col("language").isin("en", "de")).withColumn("file_name", F.regexp_extract("file_path", "[^/]+$", 0))
    metadata = F.least(F.lit(1.0), T.total([F.when(F.contains(F.lower(name), F.lit(_STORE_QUERY)), w).otherwise(0.0) for name, w in _META]))
    a = c.select("chunk_idx", "id", metadata.alias("metadata"))
    for df in (keyword, sparse, dense):
        a = a.join(df, "chunk_idx", "left")
    a = a.fillna(0.0, ["keyword", "sparse", "dense"])
    score = 0.4 * F.col("dense") + 0.3 * F.col("sparse") + 0.3 * F.col("keyword") + 0.1 * F.col("metadata")
    rows = a.where(score > 0.1).select("chunk_idx", "id", *[F.round(n, 6).alias(n) for n in ("dense", "sparse", "keyword", "metadata")], F.round(score, 6).alias("score"))
    return rows.orderBy(F.desc("score"), "chunk_idx").limit(10).drop("chunk_idx")


def _second(sql: str) -> str:
    """The positional index's SQL under names of its own."""
    return re.sub(r"\b(tok|post|dl|q)\b", r"\g<1>2", sql)


_FUSED_SQL = f"""WITH {_INDEX_SQL}, b AS ({_BM25_C}), bp AS (SELECT qid, id, score / greatest(max(score) OVER (PARTITION BY qid), 1.0) AS bm25 FROM b WHERE score > 0),
{_second(_POS_SQL)},
k AS ({_second(_KEYWORD_SQL)}), kp AS (SELECT qid, id, score / greatest(max(score) OVER (PARTITION BY qid), 1.0) AS keyword FROM k),
v AS (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vp AS (SELECT qid, id, score / greatest(max(score) OVER (PARTITION BY qid), 1.0) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM v WHERE score > 0.1) WHERE rn <= 30),
f AS (SELECT qid, id, coalesce(semantic, 0) AS semantic, coalesce(keyword, 0) AS keyword, coalesce(bm25, 0) AS bm25, round(0.4 * coalesce(semantic, 0) + 0.35 * coalesce(keyword, 0) + 0.25 * coalesce(bm25, 0), 6) AS score FROM kp FULL JOIN bp USING (qid, id) FULL JOIN vp USING (qid, id)),"""


@query(_FUSED_SQL + """ r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
SELECT qid, id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(bm25, 6) AS bm25, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic, keyword and BM25 legs, full outer joined after scaling by each query's maximum."""
    top = R.top_k(_fused(spark, sf_dir), 20, group="qid")
    return top.select("qid", "id", *[F.round(n, 6).alias(n) for n in ("semantic", "keyword", "bm25")], "score", "rank")


def _fused(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    q = vectors.join(wanted, "id").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    index = _hybrid_index(spark, sf_dir)
    legs = [
        R.vector_leg(Rounds(spark).keep("semantic", R.semantic_scores(q, vectors))),
        R.keyword_leg(*_keyword_terms(spark, sf_dir, items), index),
        R.bm25_leg(_queries(spark, sf_dir, items), _index(spark, sf_dir), k1=1.5, variant="C"),
    ]
    entries, asked = (reduce(DataFrame.unionByName, side) for side in zip(*legs, strict=True))
    scores = R.summed(entries, asked, index.documents(), {"semantic": ["vector"], "keyword": ["word", "pair"], "bm25": ["bm25"]})
    found = scores.withColumn("bm25", F.when(F.col("bm25") > 0, F.col("bm25")))
    return R.fused(found, R.LEG_WEIGHTS).withColumn("score", F.round("score", 6))


#: Kinds, actions, expected results and scopes that the benchmark passages get as components, in turn.
_KINDS, _ACTIONS, _RESULTS, _SCOPES = ("semantic", "structural", "technical", "other"), ("find", "explain", "analyze", "list", "other"), ("code", "explanation", "list"), ("class", "function", "file", "all")


def _turn(values: tuple[str, ...]) -> str:
    return f"([{', '.join(f'{chr(39)}{v}{chr(39)}' for v in values)}])[CAST(item_id % {len(values)} AS INTEGER) + 1]"


_WEIGHTED_SQL = """semantic * CASE WHEN type = 'semantic' THEN 0.6e0 ELSE 0.4e0 END * CASE WHEN output = 'explanation' THEN 1.2e0 ELSE 1e0 END + keyword * CASE WHEN type = 'structural' THEN 0.7e0 ELSE 0.35e0 END * CASE WHEN output = 'code' THEN 1.2e0 ELSE 1e0 END
 + bm25 * CASE WHEN type = 'technical' THEN 0.5e0 ELSE 0.25e0 END"""
_ASKED_SQL = f"""parts AS (SELECT item_id, {_turn(_KINDS)} AS type, {_turn(_ACTIONS)} AS action, {_turn(_RESULTS)} AS output, {_turn(_SCOPES)} AS scope, text AS subject, regexp_extract_all(text, '[a-z]{{8,}}') AS keywords, regexp_extract_all(text, '[A-Z][a-z]+') AS entities FROM benchmark),
asked AS (SELECT item_id, type, output, scope, subject, concat_ws(' ', nullif(subject, ''), nullif(array_to_string(keywords, ' '), ''), nullif(array_to_string(entities, ' '), ''), CASE action WHEN 'find' THEN 'implementation definition' WHEN 'explain' THEN 'documentation description' WHEN 'analyze' THEN 'structure pattern' END) AS text FROM parts)"""


@query(f"""WITH {_ASKED_SQL}, {_FUSED_SQL.removeprefix("WITH ").replace("FROM benchmark", "FROM asked")} {CHUNKS_SQL},
w AS (SELECT qid, id, round({_WEIGHTED_SQL}, 6) AS score FROM f JOIN asked ON item_id = qid), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM w)
SELECT qid, r.id, rank, score, CASE WHEN contains(lower(content), lower(subject)) THEN 0.2e0 ELSE 0e0 END + CASE WHEN contains(lower(class_name), lower(subject)) THEN 0.3e0 ELSE 0e0 END AS context FROM r JOIN asked ON item_id = qid JOIN chunks ON chunk_idx = r.id
WHERE rank <= 20 AND CASE scope WHEN 'class' THEN contains(chunk_type, 'class') OR contains(lower(content), 'class') WHEN 'function' THEN contains(chunk_type, 'function') OR contains(lower(content), 'function') WHEN 'file' THEN contains(chunk_type, 'file') ELSE true END""")
def component_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each component: every benchmark passage is one, its kind, action, result and scope in turn."""
    turn = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("item_id") % len(values)).cast("int"))
    own = {"type": turn(_KINDS), "action": turn(_ACTIONS), "output": turn(_RESULTS), "scope": turn(_SCOPES), "subject": F.col("text")}
    own |= {"keywords": F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0)), "entities": F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))}
    asked = table(spark, sf_dir, "benchmark").select("item_id", *[c.alias(k) for k, c in own.items()])
    items = asked.select("item_id", R.component_query().alias("text"))
    components = asked.select(F.col("item_id").alias("qid"), "type", "output", "scope", F.col("subject").alias("query"))
    texts = chunks(spark, sf_dir).select(F.col("chunk_idx").alias("id"), "chunk_type", F.col("class_name").alias("name"), "content")
    return R.component_search(components, _fused(spark, sf_dir, items), texts)


_RERANK_SQL = _FUSED_SQL + f""" top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 20), {CHUNKS_SQL},
w AS (SELECT t.qid, t.id, t.score, c.*, ({hybrid_tokens_sql('c.content')}) AS words, (SELECT list(term) FROM q2 WHERE q2.qid = t.qid) AS terms FROM (SELECT qid, id, score FROM top) t JOIN (SELECT * RENAME (id AS cid) FROM chunks) c ON c.chunk_idx = t.id),
x AS (SELECT qid, id, round(score * (1 + 0.2 * CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda y: list_contains(terms, y))) / CAST(len(words) AS DOUBLE) ELSE 0 END)
 * (1 + least(0.2, CASE WHEN length(content) > 100 AND length(content) < 2000 THEN 0.05 ELSE 0 END + CASE WHEN contains(content, 'function') OR contains(content, 'class') THEN 0.05 ELSE 0 END + CASE WHEN contains(content, '//') THEN 0.03 ELSE 0 END)) + 1e-9, 6) AS score, chunk_type, framework, importance, modified FROM w),
d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, chunk_type ORDER BY score DESC, id) = 1 THEN 0.1 ELSE 0 END + CASE WHEN row_number() OVER (PARTITION BY qid, framework ORDER BY score DESC, id) = 1 THEN 0.1 ELSE 0 END AS bonus FROM x)
SELECT qid, id, round(score + bonus + 0.1 * importance + 0.05 * greatest(0, 1 - (DATE '2024-06-30' - modified) / 365.0), 6) AS final_score FROM d"""


@query(_RERANK_SQL)
def reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking by density and quality, bonuses for new types and frameworks, then importance and recency."""
    top = R.top_k(_fused(spark, sf_dir), 20, group="qid").select("qid", "id", "score")
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(T.hybrid_tokens(F.col("text"))).alias("terms"))
    c = chunks(spark, sf_dir).drop("id")
    w = top.join(c, top["id"] == c["chunk_idx"]).join(terms, "qid")
    n = F.length("content")
    structure = F.contains("content", F.lit("function")) | F.contains("content", F.lit("class"))
    quality = F.least(F.lit(0.2), F.when((n > 100) & (n < 2000), 0.05).otherwise(0.0) + F.when(structure, 0.05).otherwise(0.0) + F.when(F.contains("content", F.lit("//")), 0.03).otherwise(0.0))
    w = w.withColumn("score", F.round(F.col("score") * (1 + 0.2 * T.term_density(F.col("content"), F.col("terms"))) * (1 + quality) + 1e-9, 6))  # a product of decimals may lie just between two roundings
    d = R.first_seen_bonus(w.withColumn("bonus", F.lit(0.0)), {"chunk_type": 0.1, "framework": 0.1}, "bonus", [F.desc("score"), "id"])
    recent = F.greatest(F.lit(0.0), 1 - F.datediff(F.lit("2024-06-30").cast("date"), "modified") / 365.0)
    return d.select("qid", "id", F.round(F.col("score") + F.col("bonus") + 0.1 * F.col("importance") + 0.05 * recent, 6).alias("final_score"))


_SIGNALS_SQL = f"""WITH {CHUNKS_SQL}, s AS (SELECT *, length(content) AS n FROM chunks),
g AS (SELECT id, chunk_idx, language, chunk_type, framework, complexity, importance,
 CASE WHEN n < 100 THEN 0.3 WHEN n < 500 THEN 0.6 + (n - 100) / 400.0 * 0.2 WHEN n <= 2000 THEN 0.8 + (n - 500) / 1500.0 * 0.2 WHEN n <= 5000 THEN 1 - (n - 2000) / 3000.0 * 0.3 ELSE 0.7 END AS length_quality,
 CASE WHEN complexity BETWEEN 3 AND 7 THEN 1.0 WHEN complexity < 3 THEN 0.7 WHEN complexity > 10 THEN 0.4 ELSE 0.8 END AS complexity_fit,
 greatest(0, 1 - (DATE '2024-06-30' - modified) / 365.0) AS freshness, least(1.0, len(dependencies) / 10.0) AS reference_count FROM s)"""


@query(_SIGNALS_SQL + """, t AS (SELECT *, 0.3 * length_quality + 0.2 * complexity_fit + 0.2 * importance + 0.2 * freshness + 0.1 * reference_count AS base FROM g),
b AS (SELECT id, chunk_idx, round(base, 6) AS base, round(base + CASE WHEN row_number() OVER (PARTITION BY chunk_type ORDER BY chunk_idx) = 1 THEN 0.05 ELSE 0 END + CASE WHEN row_number() OVER (PARTITION BY framework ORDER BY chunk_idx) = 1 THEN 0.05 ELSE 0 END
 + CASE WHEN row_number() OVER (PARTITION BY CASE WHEN complexity <= 3 THEN 's' WHEN complexity <= 7 THEN 'm' ELSE 'c' END ORDER BY chunk_idx) = 1 THEN 0.03 ELSE 0 END, 6) AS final_score FROM t)
SELECT id, base, final_score FROM b ORDER BY final_score DESC, chunk_idx LIMIT 50""")
def ranked_by_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted ranking signals, diversified in input order, first fifty."""
    g = _signals(spark, sf_dir)
    base = 0.3 * F.col("length_quality") + 0.2 * F.col("complexity_fit") + 0.2 * F.col("importance") + 0.2 * F.col("freshness") + 0.1 * F.col("reference_count")
    g = g.withColumn("base", base).withColumn("final_score", F.col("base")).withColumn("complexity_class", T.complexity_class(F.col("complexity")))
    d = R.first_seen_bonus(g, {"chunk_type": 0.05, "framework": 0.05, "complexity_class": 0.03}, "final_score", ["chunk_idx"])
    d = d.select("id", "chunk_idx", F.round("base", 6).alias("base"), F.round("final_score", 6).alias("final_score"))
    return d.orderBy(F.desc("final_score"), "chunk_idx").limit(50).drop("chunk_idx")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.lit("2024-06-30").cast("date"), "modified")
    return chunks(spark, sf_dir).withColumns({
        "length_quality": T.length_score(F.length("content")),
        "complexity_fit": T.complexity_score(F.col("complexity")),
        "freshness": F.greatest(F.lit(0.0), 1 - days / 365.0),
        "reference_count": F.least(F.lit(1.0), F.size("dependencies") / 10.0),
    })


@query(_SIGNALS_SQL + """, r AS (SELECT g.*, row_number() OVER (PARTITION BY language ORDER BY round(length_quality, 6) DESC, chunk_idx) AS rank, CASE WHEN importance = 1 THEN 1 ELSE 0 END AS relevant FROM g),
i AS (SELECT language, sum(1 / log2(rk + 1)) AS ideal FROM (SELECT language, row_number() OVER (PARTITION BY language ORDER BY relevant DESC) AS rk, relevant FROM r) WHERE rk <= 20 AND relevant = 1 GROUP BY language)
SELECT r.language, round(sum(relevant) / 20.0, 6) AS precision_at_20, round(sum(relevant) / CAST((SELECT sum(relevant) FROM r x WHERE x.language = r.language) AS DOUBLE), 6) AS recall_at_20, round(sum(relevant / log2(rank + 1)) / max(ideal), 6) AS ndcg_at_20
FROM r JOIN i ON i.language = r.language WHERE rank <= 20 GROUP BY r.language""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and nDCG of a ranking against judged documents."""
    g = _signals(spark, sf_dir).withColumn("relevant", (F.col("importance") == 1).cast("int"))
    by = Window.partitionBy("language")
    g = g.select("language", "relevant", F.row_number().over(by.orderBy(F.round("length_quality", 6).desc(), "chunk_idx")).alias("rank"), F.row_number().over(by.orderBy(F.desc("relevant"))).alias("best"))
    gain = lambda rank: F.col("relevant") / F.log2(F.col(rank) + 1)
    m = g.groupBy("language").agg(F.sum(F.when(F.col("rank") <= 20, F.col("relevant"))).alias("hits"), F.sum("relevant").alias("all"), F.sum(F.when(F.col("rank") <= 20, gain("rank"))).alias("dcg"), F.sum(F.when(F.col("best") <= 20, gain("best"))).alias("ideal"))
    return m.select("language", F.round(F.col("hits") / 20.0, 6).alias("precision_at_20"), F.round(F.col("hits") / F.col("all"), 6).alias("recall_at_20"), F.round(F.col("dcg") / F.col("ideal"), 6).alias("ndcg_at_20"))


@query("""WITH i AS (SELECT user_id, CAST(event_id % 5 AS INTEGER) AS framework, count(*) FILTER (event_type IN ('click', 'purchase')) AS n FROM events GROUP BY ALL)
SELECT user_id, framework, round(CAST(0.5 + 0.1 * n AS DOUBLE), 6) AS preference FROM i WHERE n > 0""")
def learned_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences that grow by 0.1 from 0.5 with each click."""
    e = table(spark, sf_dir, "events").withColumn("framework", (F.col("event_id") % 5).cast("int"))
    n = e.where(F.col("event_type").isin("click", "purchase")).groupBy("user_id", "framework").agg(F.count("*").alias("n"))
    return n.select("user_id", "framework", F.round(0.5 + 0.1 * F.col("n"), 6).alias("preference"))


#: Intent, patterns (fixed values); the source length of each pattern counts.
INTENTS = {
    "code-search": ["find.*function", "search.*class", "where.*is", "locate.*method", "show.*implementation", "how.*does.*work"],
    "architecture-analysis": ["architecture", "structure", "design.*pattern", "system.*overview", "how.*organized"],
    "documentation": ["document", "explain", "readme", "guide", "tutorial", "how.*to.*use"],
    "bug-analysis": ["bug", "error", "exception", "issue", "problem", "not.*working", "fail"],
    "security-analysis": ["security", "vulnerability", "authentication", "authorization", "secure", "protect"],
    "performance-analysis": ["performance", "optimize", "slow", "memory", "cpu", "bottleneck", "efficiency"],
    "testing-guidance": ["test", "testing", "unit.*test", "integration.*test", "coverage", "mock"],
    "refactoring-advice": ["refactor", "improve", "clean.*up", "best.*practice", "code.*quality", "maintainable"],
}

_INTENT_SQL = ", ".join(f"({k}, '{name}', '{p}', {len(p) / 10})" for k, (name, ps) in enumerate(INTENTS.items()) for p in ps)


@query(f"""WITH p(ord, intent, pattern, weight) AS (VALUES {_INTENT_SQL}), q AS (SELECT conv_id, turn, lower(text) || CASE conv_id % 5 WHEN 0 THEN ' where is the error in this test' WHEN 1 THEN ' explain the structure' WHEN 2 THEN ' optimize the slow memory' ELSE '' END AS t FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, ord, intent, sum(weight) AS score FROM q JOIN p ON regexp_matches(t, pattern) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 6) DESC, ord) AS rn FROM s)
SELECT q.conv_id, q.turn, coalesce(intent, 'general') AS intent, round(least(1.0, coalesce(score, 0) / 10), 6) AS confidence FROM q LEFT JOIN b ON q.conv_id = b.conv_id AND q.turn = b.turn AND rn = 1""")
def classify_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent with the largest total of matching patterns; ties go to the first."""
    extra = F.element_at(F.array(*[F.lit(x) for x in (" where is the error in this test", " explain the structure", " optimize the slow memory", "", "")]), (F.col("conv_id") % 5 + 1).cast("int"))
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lower("text"), extra).alias("t"))
    scores = {name: T.total([F.when(F.col("t").rlike(p), len(p) / 10).otherwise(0.0) for p in ps]) for name, ps in INTENTS.items()}
    found = F.array(*[F.struct(F.round(s, 6).alias("score"), F.lit(-k).alias("ord"), F.lit(name).alias("intent")) for k, (name, s) in enumerate(scores.items())])
    best = q.select("conv_id", "turn", F.array_max(found).alias("b"))
    return best.select("conv_id", "turn", F.when(F.col("b.score") > 0, F.col("b.intent")).otherwise("general").alias("intent"), F.round(F.least(F.lit(1.0), F.col("b.score") / 10), 6).alias("confidence"))


#: Ordered routing rules of chat commands (fixed values).
COMMANDS = [
    ("diagram", ["diagram", "visualize", "chart"]),
    ("readme", ["readme", "documentation"]),
    ("agile", ["story", "epic", "agile"]),
    ("quality", ["quality", "analyze", "code review", "metrics"]),
    ("stats", ["stats", "statistics", "summary", "overview", "status", "indexed"]),
]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{name}'" for name, ws in COMMANDS) + """ ELSE 'general' END AS command
FROM (SELECT conv_id, turn, lower(text) || CASE conv_id % 4 WHEN 0 THEN ' show a chart' WHEN 1 THEN ' code review and summary' ELSE '' END AS t FROM conversations WHERE role = 'user')""")
def route_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first command of which a word occurs."""
    extra = F.when(F.col("conv_id") % 4 == 0, " show a chart").when(F.col("conv_id") % 4 == 1, " code review and summary").otherwise("")
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lower("text"), extra).alias("t"))
    rule = None
    for name, words in COMMANDS:
        hit = F.col("t").rlike("|".join(words))
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return q.select("conv_id", "turn", rule.otherwise("general").alias("command"))
