"""Chunking, endpoints, classification and overview queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structure as J
from ..functions import text as T
from ..operators import chunking as C
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(min(pos) + 1 AS BIGINT) AS start_line, CAST(max(pos) + 1 AS BIGINT) AS end_line, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l GROUP BY doc_id, pos // 5""")
def line_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of five lines."""
    w = C.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 5)
    return w.select("doc_id", "start_line", "end_line", F.md5("content").alias("digest"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, ls, CAST(1 AS BIGINT) AS i, length(ls[1]) AS n, CAST(1 AS BIGINT) AS chunk FROM l UNION ALL
SELECT doc_id, ls, i + 1, CASE WHEN n + 1 + length(ls[i + 1]) > 1000 THEN length(ls[i + 1]) ELSE n + 1 + length(ls[i + 1]) END, CASE WHEN n + 1 + length(ls[i + 1]) > 1000 THEN chunk + 1 ELSE chunk END FROM r WHERE i < len(ls))
SELECT doc_id, chunk, CAST(max(n) AS BIGINT) AS size FROM r GROUP BY doc_id, chunk""")
def packed_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of lines to chunks of at most 1000 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.packed_lines(F.col("text"), 1000)).alias("pos", "content"))
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("chunk"), F.length("content").cast("long").alias("size"))


_MD = "'# ' || source || chr(10) || text || chr(10) || '## ' || lang || chr(10) || 'end'"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_MD}, chr(10))) AS line, generate_subscripts(string_split({_MD}, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\\s+(.+)$') AS header, sum(CASE WHEN regexp_matches(line, '^(#{{1,6}})\\s+(.+)$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(length(regexp_extract(max(line) FILTER (header), '^(#{{1,6}})\\s+(.+)$', 1)) AS INTEGER) AS level, regexp_extract(max(line) FILTER (header), '^(#{{1,6}})\\s+(.+)$', 2) AS title,
md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT header), '')) AS digest, CASE WHEN level = 1 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS importance FROM s WHERE section > 0 GROUP BY doc_id, section""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\n## "), F.col("lang"), F.lit("\nend"))
    s = C.sections(d.select("doc_id", text.alias("text")), "doc_id", "text")
    return s.select("doc_id", F.col("section").cast("long").alias("section"), "level", "title", F.md5("content").alias("digest"), F.when(F.col("level") == 1, 0.9).otherwise(0.6).alias("importance"))


_TAGS = ["nav", "article", "footer"]
_TAG_SQL = " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, regexp_extract(html, '(?s)<{t}[^>]*>(.*?)</{t}>', 1) AS content FROM pages" for t in _TAGS)


@query(f"""SELECT page_id, tag, CAST(length(content) AS BIGINT) AS size, md5(content) AS digest, CASE tag WHEN 'article' THEN 0.9::DOUBLE WHEN 'nav' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS importance FROM ({_TAG_SQL}) WHERE length(content) > 0""")
def template_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.inline(C.tag_sections(F.col("html"))))
    return p.select("page_id", "tag", F.length("content").cast("long").alias("size"), F.md5("content").alias("digest"), F.when(F.col("tag") == "article", 0.9).when(F.col("tag") == "nav", 0.6).otherwise(0.4).alias("importance"))


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS name, props FROM events) SELECT event_id, name, props ->> ('$."' || name || '"') AS value, CAST(least(5, greatest(1, (SELECT count(*) FROM (SELECT unnest(json_keys(k.props)))) // 5)) AS INTEGER) AS complexity FROM k""")
def config_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each top-level entry of a JSON text."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    n = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.size("m") / 5).cast("int")))
    return e.select("event_id", n.alias("complexity"), F.explode("m").alias("name", "value"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made of the first words of documents: a class with a method, in three languages."""
    w = F.split(F.regexp_replace("text", "[^a-zA-Z]+", " "), " ")
    name = lambda k: F.concat(F.lit("n"), F.coalesce(F.get(w, k), F.lit("x")))
    py = F.concat(F.lit("class "), name(0), F.lit(":\n    def "), name(1), F.lit("(self, a):\n        if a:\n            return 1\n        return 2\n\ndef "), name(2), F.lit("():\n    for i in []:\n        pass\n"))
    js = F.concat(F.lit("class "), name(0), F.lit(" {\n  run() { if (a && b) { return 1; } }\n}\nfunction "), name(1), F.lit("(x) {\n  while (x) { x--; }\n}\nconst "), name(2), F.lit(" = (y) => { return y; }\n"))
    java = F.concat(F.lit("public class "), name(0), F.lit(" {\n  public int "), name(1), F.lit("(int a) {\n    if (a > 0) { return 1; }\n    return 0;\n  }\n}\n"))
    m = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", F.when(m == 0, py).when(m == 1, js).otherwise(java).alias("code"), F.when(m == 0, "python").when(m == 1, "javascript").otherwise("java").alias("language"))


@query()
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with balanced or indented blocks; tests compare them with hand-made values."""
    return C.code_blocks(_code(spark, sf_dir), "doc_id", "code", "language")


@query()
def code_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions contained in the class of their file: contains edges by position."""
    b = C.code_blocks(_code(spark, sf_dir), "doc_id", "code", "language")
    cls, fn = b.where("kind = 'class'").alias("c"), b.where("kind = 'function'").alias("f")
    inside = (F.col("c.doc_id") == F.col("f.doc_id")) & (F.col("f.start_line") > F.col("c.start_line")) & (F.col("f.end_line") <= F.col("c.end_line"))
    return cls.join(fn, inside).select(F.col("c.doc_id").alias("doc_id"), F.col("c.name").alias("source"), F.col("f.name").alias("target"))


#: Layers by words of a path, in order (fixed values).
_LAYER_RULES = [("controller", "controller"), ("service", "service"), ("repository", "repository|dao"), ("model", "model|entity"), ("component", "component"), ("view", "view")]
_NAME_SQL = "lower(coalesce(component_type, '') || CASE chunk_idx % 6 WHEN 2 THEN 'UserDao' WHEN 3 THEN 'OrderEntity' WHEN 4 THEN 'ListView' ELSE '' END || file_path)"


@query(f"""WITH {CHUNKS_SQL} SELECT CASE {' '.join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in _LAYER_RULES)} ELSE 'other' END AS layer, CAST(count(*) AS BIGINT) AS components, round(avg(complexity), 6) AS mean_complexity FROM (SELECT {_NAME_SQL} AS n, complexity FROM chunks) GROUP BY 1""")
def architectural_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("chunk_idx") % 6
    extra = F.when(m == 2, "UserDao").when(m == 3, "OrderEntity").when(m == 4, "ListView").otherwise("")
    n = F.lower(F.concat(F.coalesce("component_type", F.lit("")), extra, F.col("file_path")))
    layer = None
    for label, pattern in _LAYER_RULES:
        layer = F.when(n.rlike(pattern), label) if layer is None else layer.when(n.rlike(pattern), label)
    return chunks(spark, sf_dir).groupBy(layer.otherwise("other").alias("layer")).agg(F.count("*").alias("components"), F.round(F.avg("complexity"), 6).alias("mean_complexity"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route files made from the urls of pages: Express, Flask and Spring in turn."""
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1))
    k = F.col("page_id") % 3
    text = F.when(k == 0, F.concat(F.lit("app.get('"), path, F.lit("/:id', show);\napp.post('"), path, F.lit("', make);"))).when(k == 1, F.concat(F.lit("@app.route('"), path, F.lit("/<int:id>', methods=['PUT'])\ndef edit(id): pass"))).otherwise(F.concat(F.lit('@GetMapping("'), path, F.lit('/{id}")\npublic X show() {}\n@DeleteMapping("'), path, F.lit('")\npublic void drop() {}')))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


_ROUTE_SQL = """r AS (SELECT page_id, '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages),
e AS (SELECT page_id, 'express' AS framework, 'GET' AS method, p || '/:id' AS path FROM r WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'express', 'POST', p FROM r WHERE page_id % 3 = 0
 UNION ALL SELECT page_id, 'flask', 'PUT', p || '/:id' FROM r WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'spring-boot', 'GET', p || '/:id' FROM r WHERE page_id % 3 = 2 UNION ALL SELECT page_id, 'spring-boot', 'DELETE', p FROM r WHERE page_id % 3 = 2)"""


@query(f"WITH {_ROUTE_SQL} SELECT page_id, framework, method, path FROM e")
def api_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints found by each framework's patterns, with normalised paths."""
    return _endpoints(spark, sf_dir)


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.classify import endpoints

    return endpoints(_routes(spark, sf_dir), "page_id", "text")


@query(f"""WITH {_ROUTE_SQL} SELECT '/' || list_filter(string_split(path, '/'), lambda x: x <> '')[1] AS base_path, method, framework, CAST(count(*) AS BIGINT) AS endpoints FROM e GROUP BY ALL""")
def endpoints_by_base_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _endpoints(spark, sf_dir)
    base = F.concat(F.lit("/"), F.get(F.filter(F.split("path", "/"), lambda x: x != ""), 0))
    return e.groupBy(base.alias("base_path"), "method", "framework").agg(F.count("*").alias("endpoints"))


@query(f"""WITH {CHUNKS_SQL} SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(sum(end_line) AS BIGINT) AS lines, CAST(count(*) FILTER (chunk_type = 'class') AS BIGINT) AS classes, CAST(count(*) FILTER (chunk_type = 'function') AS BIGINT) AS functions,
CAST(count(DISTINCT framework) AS BIGINT) AS frameworks, CASE WHEN count(*) > 5000 THEN 'very high' WHEN count(*) > 1000 THEN 'high' WHEN count(*) > 500 THEN 'medium' ELSE 'low' END AS size_class FROM chunks""")
def codebase_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return chunks(spark, sf_dir).agg(n.alias("chunks"), F.sum("end_line").alias("lines"), F.count_if(F.col("chunk_type") == "class").alias("classes"), F.count_if(F.col("chunk_type") == "function").alias("functions"), F.countDistinct("framework").alias("frameworks"), F.when(n > 5000, "very high").when(n > 1000, "high").when(n > 500, "medium").otherwise("low").alias("size_class"))


@query(f"""WITH {CHUNKS_SQL} SELECT framework, CAST(count(*) AS BIGINT) AS files, round(avg(importance), 6) AS mean_importance, CAST(count(DISTINCT component_type) AS BIGINT) AS component_types,
CASE WHEN count(*) > 0.3 * sum(count(*)) OVER () THEN 'primary' WHEN count(*) > 0.1 * sum(count(*)) OVER () THEN 'secondary' ELSE 'utility' END AS usage FROM chunks GROUP BY framework""")
def framework_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = chunks(spark, sf_dir).groupBy("framework").agg(F.count("*").alias("files"), F.round(F.avg("importance"), 6).alias("mean_importance"), F.countDistinct("component_type").alias("component_types"))
    share = F.col("files") / F.sum("files").over(Window.partitionBy())
    return g.withColumn("usage", F.when(share > 0.3, "primary").when(share > 0.1, "secondary").otherwise("utility"))


@query(f"""WITH {CHUNKS_SQL} SELECT framework, language, chunk_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (complexity <= 5) AS BIGINT) AS low, CAST(count(*) FILTER (complexity > 5 AND complexity <= 15) AS BIGINT) AS medium FROM chunks GROUP BY GROUPING SETS ((framework), (language), (chunk_type), ())""")
def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by framework, by language, by type and in all, in one pass."""
    c = chunks(spark, sf_dir)
    sets = [["framework"], ["language"], ["chunk_type"], []]
    g = c.groupingSets(sets, "framework", "language", "chunk_type")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("complexity") <= 5).alias("low"), F.count_if((F.col("complexity") > 5) & (F.col("complexity") <= 15)).alias("medium"))


@query(f"""WITH {CHUNKS_SQL}, d AS (SELECT string_split(file_path, '/')[1] AS directory, count(*) AS files, count(*) FILTER (extension IN ('json', 'yml')) AS config_files, count(*) FILTER (extension = 'md') AS documents FROM chunks GROUP BY 1)
SELECT directory, CAST(files AS BIGINT) AS files, CAST(config_files AS BIGINT) AS config_files, CASE WHEN config_files * 3 > files THEN 'configuration' WHEN documents * 3 > files THEN 'documentation' ELSE 'source' END AS purpose FROM d""")
def project_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = chunks(spark, sf_dir).groupBy(F.get(F.split("file_path", "/"), 0).alias("directory")).agg(F.count("*").alias("files"), F.count_if(F.col("extension").isin("json", "yml")).alias("config_files"), F.count_if(F.col("extension") == "md").alias("documents"))
    return g.select("directory", "files", "config_files", F.when(F.col("config_files") * 3 > F.col("files"), "configuration").when(F.col("documents") * 3 > F.col("files"), "documentation").otherwise("source").alias("purpose"))


@query("""WITH s AS (SELECT n_name AS service, list_sort(list_distinct(list(p_brand))) AS dependencies, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY n_name)
SELECT a.service AS a, b.service AS b, CAST(len(list_intersect(a.dependencies, b.dependencies)) AS BIGINT) AS shared, round(len(list_intersect(a.dependencies, b.dependencies)) / CAST(len(list_distinct(list_concat(a.dependencies, b.dependencies))) AS DOUBLE), 6) AS overlap FROM s a JOIN s b ON a.service < b.service""")
def service_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that two services share; services are nations, at most a few dozen rows."""
    s = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    s = s.groupBy(F.col("n_name").alias("service")).agg(F.collect_set("p_brand").alias("dependencies"))
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, F.col("a.service") < F.col("b.service"))
    x, y = F.col("a.dependencies"), F.col("b.dependencies")
    return pairs.select(F.col("a.service").alias("a"), F.col("b.service").alias("b"), F.size(F.array_intersect(x, y)).cast("long").alias("shared"), F.round(T.jaccard(x, y), 6).alias("overlap"))


_LEAVES_SQL = """SELECT x.key, fullkey AS path, CASE json_tree.type WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'BIGINT' THEN 'NUMBER' WHEN 'DOUBLE' THEN 'NUMBER' WHEN 'NULL' THEN 'NULL' WHEN 'BOOLEAN' THEN 'BOOLEAN' ELSE 'EMPTY' END AS kind, CASE WHEN type NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN atom ->> '$' END AS value
FROM x, json_tree(CASE WHEN json_valid(text) THEN text END) WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST((x.text -> fullkey) AS VARCHAR) IN ('{}', '[]')"""


@query(f"""WITH x AS (SELECT event_id AS key, props AS text FROM events), l AS ({_LEAVES_SQL}) SELECT path, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS n_values, min(value) AS least, max(value) AS greatest FROM l GROUP BY path, kind""")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All properties of events, whatever their depth, with their values counted."""
    leaves = J.json_leaves(table(spark, sf_dir, "events"), "event_id", "props")
    return leaves.groupBy("path", "kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest"))


_ORDER_SQL = """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 3 THEN left(j, length(j) - 1) ELSE j END AS text FROM (SELECT o_orderkey, CAST(to_json({'order': o_orderkey, 'customer': {'key': o_custkey, 'open': o_orderstatus = 'O', 'note': CASE WHEN o_custkey % 2 = 0 THEN 'a b' END}, 'items': coalesce(i, []), 'none': {'list': CAST([] AS INTEGER[])}}) AS VARCHAR) AS j
FROM orders LEFT JOIN (SELECT l_orderkey, list({'part': {'key': l_partkey, 'path': [l_suppkey, l_linenumber]}, 'mode': l_returnflag} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


@query(f"""WITH x AS ({_ORDER_SQL}), l AS ({_LEAVES_SQL} UNION ALL SELECT key, '$', 'INVALID', NULL FROM x WHERE NOT json_valid(text)) SELECT key, path, kind, value FROM l""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plain value of nested texts made of orders and their line items; a tenth of the texts is cut off and so invalid."""
    item = F.struct(F.struct(F.col("l_partkey").alias("key"), F.array(F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long")).alias("path")).alias("part"), F.col("l_returnflag").alias("mode"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item")))).alias("i"))
    o = table(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    customer = F.struct(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "O").alias("open"), F.when(F.col("o_custkey") % 2 == 0, "a b").alias("note"))
    whole = F.struct(F.col("o_orderkey").alias("order"), customer.alias("customer"), F.coalesce(F.transform("i", lambda x: x["item"]), F.array()).alias("items"), F.struct(F.array().cast("array<int>").alias("list")).alias("none"))
    text = F.to_json(whole, {"ignoreNullFields": "false"})
    texts = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 10 == 3, F.left(text, F.length(text) - 1)).otherwise(text).alias("text"))
    return J.json_leaves(texts, "key", "text")
