"""Queries over scalar text functions, filters, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import similar as S
from ..operators.filters import Rule, SearchFilter, apply_rules, ordered, page
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query

_STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_QSTOP = "[" + ",".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + "]"
_QSTOP2 = "[" + ",".join(f"'{w}'" for w in [*T.QUERY_STOP_WORDS, *T.PRONOUNS]) + "]"


def bm25_tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(regexp_replace(lower({text}), '[_\\-.]', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t) AND NOT regexp_matches(t, '^[0-9]+$'))"


def hybrid_tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({text}), '[^\\w\\s.\\-]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1)"


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, array_to_string(t[1:20], ' ') AS head
FROM (SELECT doc_id, {bm25_tokens_sql('text')} AS t FROM documents)""")
def tokenize_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.bm25_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 20), " ").alias("head"))


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t[1:12], ' ') AS head FROM (SELECT doc_id, {hybrid_tokens_sql('text')} AS t FROM documents)""")
def tokenize_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.hybrid_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 12), " ").alias("head"))


@query(f"""SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) > 2 AND NOT list_contains({_QSTOP}, t))[1:10], ' ') AS keywords,
array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) > 2 AND NOT list_contains({_QSTOP2}, t))[1:10], ' ') AS plain_keywords FROM conversations WHERE role = 'user'""")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    k = F.col("text")
    return asked.select("conv_id", "turn", F.array_join(T.query_keywords(k), " ").alias("keywords"), F.array_join(T.query_keywords(k, [*T.QUERY_STOP_WORDS, *T.PRONOUNS]), " ").alias("plain_keywords"))


@query(f"""WITH t AS (SELECT item_id, {hybrid_tokens_sql('text')} AS t FROM benchmark),
p AS (SELECT item_id, unnest(generate_series(1, len(t) - 1)) AS i, t FROM t),
q AS (SELECT item_id, i, 2 AS k, t[i] || ' ' || t[i + 1] AS phrase FROM p UNION ALL SELECT item_id, i, 3, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FROM p WHERE i + 2 <= len(t)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i, k) AS pos FROM q)
SELECT item_id, pos, phrase FROM r WHERE pos <= 50""")
def phrase_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.phrases(F.col("text"))).alias("pos", "phrase"))
    return found.select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), "phrase")


_SYN_SQL = "MAP {" + ", ".join(f"'{k}': [" + ", ".join(f"'{v}'" for v in vs) + "]" for k, vs in T.SYNONYMS.items()) + "}"


@query(f"""WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text) || ' create function error', '\\s+')) AS w, generate_subscripts(string_split_regex(lower(text) || ' create function error', '\\s+'), 1) AS i FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, i, 0 AS j, w FROM w UNION ALL SELECT conv_id, turn, i, k, s[k] FROM (SELECT conv_id, turn, i, {_SYN_SQL}[w] AS s, unnest(generate_series(1, len({_SYN_SQL}[w]))) AS k FROM w))
SELECT conv_id, turn, CAST(count(DISTINCT w) AS BIGINT) AS n_terms, string_agg(DISTINCT w, ' ' ORDER BY w) AS terms FROM e GROUP BY conv_id, turn""")
def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    e = asked.select("conv_id", "turn", T.synonyms(F.split(F.concat(F.lower("text"), F.lit(" create function error")), r"\s+")).alias("e"))
    return e.select("conv_id", "turn", F.size("e").cast("long").alias("n_terms"), F.array_join(F.array_sort("e"), " ").alias("terms"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(levenshtein(a.s_name, b.s_name) AS BIGINT) AS distance, round(1 - levenshtein(a.s_name, b.s_name) / CAST(greatest(length(a.s_name), length(b.s_name)) AS DOUBLE), 6) AS similarity
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE 1 - levenshtein(a.s_name, b.s_name) / CAST(greatest(length(a.s_name), length(b.s_name)) AS DOUBLE) >= 0.8""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names within a nation."""
    return S.edit_similar_within(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("group"), F.col("s_name").alias("word")), 0.8).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {CHUNKS_SQL} SELECT id, upper(substr(id, 1, 1)) || substr(id, 2) AS title, regexp_replace(file_path, '[^a-zA-Z0-9]', '_', 'g') AS node, chunk_type || '_' || id AS chunk_name,
sha256(content) AS content_hash, md5(file_path) AS path_id FROM chunks""")
def identifiers_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.select("id", T.humanized(F.col("id")).alias("title"), T.identifier(F.col("file_path")).alias("node"), F.concat_ws("_", "chunk_type", "id").alias("chunk_name"), F.sha2("content", 256).alias("content_hash"), F.md5("file_path").alias("path_id"))


@query(f"""WITH {CHUNKS_SQL}, h AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(file_path, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS w FROM chunks)
SELECT id, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS signed_hash, lower(to_hex(CAST(abs(CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END) AS BIGINT))) AS hex_hash FROM h""")
def string_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = chunks(spark, sf_dir).select("id", T.int32_hash(F.col("file_path")).alias("signed_hash"))
    return h.select("id", "signed_hash", F.lower(F.hex(F.abs("signed_hash"))).alias("hex_hash"))


@query(f"""WITH {CHUNKS_SQL} SELECT id, file_path, regexp_matches(file_path, '^src1/.*$') AS in_folder, regexp_matches(file_path, '^(?:.*/)?[^/]*\\.py$') AS python_file, regexp_matches(file_path, '^[^/]*/en/[^/]*$') AS english FROM chunks""")
def glob_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = chunks(spark, sf_dir), F.col("file_path")
    return c.select("id", "file_path", p.rlike(T.glob_to_regex("src1/**")).alias("in_folder"), p.rlike(T.glob_to_regex("**/*.py")).alias("python_file"), p.rlike(T.glob_to_regex("*/en/*")).alias("english"))


_LANG_SQL = "CASE extension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " ELSE 'text' END"


@query(f"""WITH {CHUNKS_SQL} SELECT {_LANG_SQL} AS code_language, CAST(count(*) AS BIGINT) AS files, CAST(sum(end_line) AS BIGINT) AS lines, round(100.0 * sum(end_line) / sum(sum(end_line)) OVER (), 4) AS percent FROM chunks GROUP BY ALL""")
def language_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("code_language", T.language_of(F.col("extension")))
    g = c.groupBy("code_language").agg(F.count("*").alias("files"), F.sum("end_line").alias("lines"))
    return g.withColumn("percent", F.round(100.0 * F.col("lines") / F.sum("lines").over(Window.partitionBy()), 4))


def _count_sql(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_BRANCH_SQL = "1 + " + " + ".join(f"(len(string_split_regex(' ' || {{0}} || ' ', '[^A-Za-z0-9_]{w}[^A-Za-z0-9_]')) - 1)" for w in T.BRANCHES)


@query("""WITH w AS (SELECT doc_id, text, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS w FROM documents),
b AS (SELECT doc_id, count(*) FILTER (w IN ('if', 'else', 'while', 'for', 'switch', 'case', 'catch', 'try')) AS n FROM w GROUP BY doc_id)
SELECT d.doc_id, CAST(1 + n + (length(text) - length(replace(text, '&&', ''))) // 2 + (length(text) - length(replace(text, '||', ''))) // 2 AS BIGINT) AS complexity FROM documents d JOIN b USING (doc_id)""")
def branch_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.branch_complexity(F.col("text")).alias("complexity"))


@query("""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, round(ceil(length(text) / 4.0) / 1000 * 0.03, 6) AS cost, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words,
CAST(ceil(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 200.0) AS BIGINT) AS read_minutes FROM documents""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.ceil(F.length("text") / 4.0)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.cast("long").alias("tokens"), F.round(tokens / 1000 * 0.03, 6).alias("cost"), words.cast("long").alias("words"), F.ceil(words / 200.0).cast("long").alias("read_minutes"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.2f', b * 1.0) || ' Bytes' WHEN b < 1048576 THEN printf('%.2f', round(b / 1024.0, 2)) || ' KB' ELSE printf('%.2f', round(b / 1048576.0, 2)) || ' MB' END AS size FROM (SELECT doc_id, n_chars * 1000 AS b FROM documents)""")
def formatted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(F.col("n_chars") * 1000).alias("size"))


@query("""WITH d AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w, lang FROM documents), q AS (SELECT item_id, string_split_regex(lower(text), '\\s+') AS w FROM benchmark),
dw AS (SELECT DISTINCT doc_id, unnest(w) AS w FROM d), qw AS (SELECT DISTINCT item_id, unnest(w) AS w FROM q), dn AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY 1), qn AS (SELECT item_id, count(*) AS n FROM qw GROUP BY 1),
m AS (SELECT item_id, doc_id, count(*) AS c FROM qw JOIN dw USING (w) GROUP BY ALL)
SELECT item_id, doc_id, round(c / CAST(qn.n + dn.n - c AS DOUBLE), 6) AS similarity FROM m JOIN dn USING (doc_id) JOIN qn USING (item_id) WHERE c / CAST(qn.n + dn.n - c AS DOUBLE) > 0.2""")
def word_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity by a join on shared words; sizes are joined afterwards."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.words_of(F.col("text")))).alias("w"))
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.words_of(F.col("text")))).alias("w"))
    common = q.join(d, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("c"))
    sizes = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    s = F.col("c") / (F.col("nq") + F.col("nd") - F.col("c"))
    return common.join(sizes(d, "doc_id", "nd"), "doc_id").join(sizes(q, "item_id", "nq"), "item_id").where(s > 0.2).select("item_id", "doc_id", F.round(s, 6).alias("similarity"))


@query(f"""WITH {CHUNKS_SQL} SELECT id, file_path, complexity, end_line - start_line + 1 AS lines FROM chunks WHERE lower(language) IN ('en', 'fr') AND lower(chunk_type) IN ('function', 'class', 'file') AND file_path LIKE '%src%'
AND complexity BETWEEN 2 AND 8 AND end_line >= 2 AND len(list_filter(dependencies, lambda d: contains(d, 'lib'))) > 0 AND len(list_filter(dependencies, lambda d: contains(d, 'core-1'))) > 0 ORDER BY file_path, chunk_idx LIMIT 20""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter-only search, alphabetical, first 20."""
    f = SearchFilter(languages=["EN", "fr"], chunk_types=["function", "class", "FILE"], path_contains="src", min_complexity=2, max_complexity=8, min_lines=2, dependencies=["lib", "core-1"])
    found = ordered(chunks(spark, sf_dir).where(f.condition()), "alphabetical", descending=False).limit(20)
    return found.select("id", "file_path", "complexity", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))


@query(f"""WITH {CHUNKS_SQL} SELECT id, complexity, end_line FROM chunks WHERE regexp_matches(file_path, '^src[0-9]/') AND class_name IS NOT NULL ORDER BY complexity DESC, chunk_idx LIMIT 25 OFFSET 10""")
def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = SearchFilter(path_pattern="^src[0-9]/")
    found = chunks(spark, sf_dir).where(f.condition() & F.col("class_name").isNotNull())
    return page(ordered(found, "complexity"), 10, 25).select("id", "complexity", "end_line")


@query(f"""WITH {CHUNKS_SQL} SELECT id, round(importance * CASE WHEN importance BETWEEN 0.8 AND 1 THEN 1.2 ELSE 1 END * CASE WHEN chunk_type IN ('block') THEN 0.7 ELSE 1 END, 6) AS score FROM chunks
WHERE NOT coalesce(component_type = 'controller', false) AND language = 'en'""")
def filter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        Rule("exclude", [("component_type", "equals", "controller")]),
        Rule("require", [("language", "equals", "en")]),
        Rule("boost", [("importance", "range", (0.8, 1.0))], 0.2),
        Rule("demote", [("chunk_type", "in", ["block"])], 0.3),
    ]
    return apply_rules(chunks(spark, sf_dir).withColumn("score", F.col("importance")), rules).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {CHUNKS_SQL}, a AS (SELECT id, 1 AS rank FROM chunks WHERE chunk_type = 'class' UNION ALL SELECT id, 2 FROM chunks WHERE chunk_type = 'function' UNION ALL SELECT id, 3 FROM chunks WHERE extension = 'java')
SELECT id, CAST(min(rank) AS INTEGER) AS first_source FROM a GROUP BY id""")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans, one row for each id: that of the first scan."""
    c = chunks(spark, sf_dir)
    parts = [c.where("chunk_type = 'class'"), c.where("chunk_type = 'function'"), c.where("extension = 'java'")]
    every = parts[0].select("id", F.lit(1).alias("rank")).unionByName(parts[1].select("id", F.lit(2).alias("rank"))).unionByName(parts[2].select("id", F.lit(3).alias("rank")))
    return every.groupBy("id").agg(F.min("rank").alias("first_source"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS owner, regexp_extract(url, '^https?://[^/]+/[^/?#]+/([^/?#]+)', 1) AS name FROM pages""")
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    return p.select("page_id", part(r"^https?://([^/]+)").alias("host"), part(r"^https?://[^/]+/([^/?#]+)").alias("owner"), part(r"^https?://[^/]+/[^/?#]+/([^/?#]+)").alias("name"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS targets, array_to_string(regexp_extract_all(html, 'src="([^"]*)"', 1), ' ') AS sources FROM pages""")
def template_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    of = lambda name: F.regexp_extract_all("html", F.lit(f'{name}="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.size(of("href")).cast("long").alias("links"), F.array_join(of("href"), " ").alias("targets"), F.array_join(of("src"), " ").alias("sources"))
