"""Query understanding and parsing of text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import texts as S
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query

_EXTRA = [" compare the api and the db of the react app", " list all classes", " explain how auth works and why the ui is slow, then refactor the config", ""]
_ASKED_SQL = "q AS (SELECT conv_id, turn, lower(text) || CASE conv_id % 4 WHEN 0 THEN '" + _EXTRA[0] + "' WHEN 1 THEN '" + _EXTRA[1] + "' WHEN 2 THEN '" + _EXTRA[2] + "' ELSE '' END AS t FROM conversations WHERE role = 'user')"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(*[F.lit(x) for x in _EXTRA]), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lower("text"), extra).alias("t"))


#: Words that mark how complex a question is (fixed values).
INDICATORS = {"complex": ["compare", "analyze", "refactor", "optimize", "architecture"], "moderate": ["how", "explain", "why", "works"], "simple": ["list", "show", "find", "what"]}


def _hits_sql(words: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words)


@query(f"""WITH {_ASKED_SQL}, n AS (SELECT conv_id, turn, {_hits_sql(INDICATORS['complex'])} AS c, {_hits_sql(INDICATORS['moderate'])} AS m, {_hits_sql(INDICATORS['simple'])} AS s, length(t) - length(replace(t, ' and ', '')) AS joins FROM q)
SELECT conv_id, turn, CASE WHEN c >= 2 OR (c >= 1 AND joins > 0) THEN 'multi-part' WHEN c >= 1 THEN 'complex' WHEN m > s THEN 'moderate' ELSE 'simple' END AS complexity FROM n""")
def query_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lambda ws: T.total([F.contains("t", F.lit(w)).cast("int") for w in ws])
    n = _asked(spark, sf_dir).select("conv_id", "turn", hits(INDICATORS["complex"]).alias("c"), hits(INDICATORS["moderate"]).alias("m"), hits(INDICATORS["simple"]).alias("s"), F.contains("t", F.lit(" and ")).alias("joins"))
    kind = F.when((F.col("c") >= 2) | ((F.col("c") >= 1) & F.col("joins")), "multi-part").when(F.col("c") >= 1, "complex").when(F.col("m") > F.col("s"), "moderate").otherwise("simple")
    return n.select("conv_id", "turn", kind.alias("complexity"))


#: Acronyms and what they stand for (fixed values).
ACRONYMS = {"api": "application programming interface", "db": "database", "ui": "user interface", "auth": "authentication", "config": "configuration"}


def _expanded_sql() -> str:
    out = "' ' || t || ' '"
    for k, v in ACRONYMS.items():
        out = f"regexp_replace({out}, '([^A-Za-z0-9_]){k}([^A-Za-z0-9_])', '\\1{v}\\2', 'g')"
    return f"trim({out})"


@query(f"WITH {_ASKED_SQL} SELECT conv_id, turn, {_expanded_sql()} AS expanded FROM q")
def acronym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.concat(F.lit(" "), F.col("t"), F.lit(" "))
    for k, v in ACRONYMS.items():
        out = F.regexp_replace(out, rf"([^A-Za-z0-9_]){k}([^A-Za-z0-9_])", f"$1{v}$2")
    return _asked(spark, sf_dir).select("conv_id", "turn", F.trim(out).alias("expanded"))


#: Vocabularies of entities (fixed values).
ENTITIES = {"framework": "react|angular|vue|spring|django|flask", "component": "class|classes|function|service|controller|component", "concern": "auth|config|api|db|ui|cache"}


@query(f"""WITH {_ASKED_SQL} SELECT conv_id, turn, {', '.join(f"array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{p}'))), ' ') AS {k}" for k, p in ENTITIES.items())} FROM q""")
def entity_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(0)))), " ").alias(k) for k, p in ENTITIES.items()]
    return _asked(spark, sf_dir).select("conv_id", "turn", *found)


#: Action, pattern, result type and most results of a component (fixed values).
COMPONENTS = [("list", "list|show|find", "list", 20), ("explain", "explain|how|why", "explanation", 5), ("compare", "compare", "analysis", 10), ("refactor", "refactor|improve", "code", 15)]


@query(f"""WITH {_ASKED_SQL}, c AS ({' UNION ALL '.join(f"SELECT conv_id, turn, {k} AS step, '{a}' AS action, '{r}' AS result, {n} AS most FROM q WHERE regexp_matches(t, '{p}')" for k, (a, p, r, n) in enumerate(COMPONENTS))})
SELECT conv_id, turn, step, action, result, most FROM c UNION ALL SELECT conv_id, turn, 0, 'search', 'list', 20 FROM q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = q.conv_id AND c.turn = q.turn)""")
def query_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a question by pattern rules, a plain search where none matches."""
    part = lambda k, a, r, n: F.struct(F.lit(k).alias("step"), F.lit(a).alias("action"), F.lit(r).alias("result"), F.lit(n).alias("most"))
    found = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), part(k, a, r, n)) for k, (a, p, r, n) in enumerate(COMPONENTS)]))
    return _asked(spark, sf_dir).select("conv_id", "turn", F.inline(F.when(F.size(found) > 0, found).otherwise(F.array(part(0, "search", "list", 20)))))


_TAGS = [("service", "component_type = 'service'"), ("controller", "component_type = 'controller'"), ("complex", "complexity > 7"), ("important", "importance > 0.8"), ("documented", "extension = 'md'"), ("configuration", "extension IN ('json', 'yml')")]


@query(f"""WITH {CHUNKS_SQL} SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{t}' END" for t, c in _TAGS)}], lambda x: x IS NOT NULL), ' ') AS tags,
round(least(1.0::DOUBLE, CASE chunk_type WHEN 'class' THEN 0.6::DOUBLE WHEN 'interface' THEN 0.5::DOUBLE WHEN 'function' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN component_type IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN complexity > 7 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 6) AS derived_importance FROM chunks""")
def chunk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("chunk_type") == "class", 0.6).when(F.col("chunk_type") == "interface", 0.5).when(F.col("chunk_type") == "function", 0.4).otherwise(0.3)
    more = F.when(F.col("component_type").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("complexity") > 7, 0.1).otherwise(0.0)
    return chunks(spark, sf_dir).select("id", F.array_join(T.tagged([(F.expr(c), t) for t, c in _TAGS]), " ").alias("tags"), F.round(F.least(F.lit(1.0), base + more), 6).alias("derived_importance"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS hash, 'c' || o_custkey AS author, CAST(l_linenumber AS BIGINT) AS additions, CAST(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_suppkey END AS BIGINT) AS deletions, 'src/p' || l_partkey AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit logs written from orders as text and parsed again."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_suppkey").cast("string")), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string")))
    body = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    head = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("change | more"))
    log = o.join(body, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(head, F.lit("\n"), F.col("body")).alias("value"))
    commits, files = S.parse_log(log)
    return files.join(commits.select("hash", "author"), "hash").select("hash", "author", "additions", "deletions", "path")


@query("""SELECT 'npm' AS kind, CAST(p_partkey AS VARCHAR) AS path, 'lib' || p_size AS dependency, '^' || p_size || '.0' AS version FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'npm', CAST(p_partkey AS VARCHAR), 'dev', '1.0' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'pip', CAST(p_partkey AS VARCHAR), 'pkg' || p_size, '2.' || p_size FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'pip', CAST(p_partkey AS VARCHAR), 'plain', NULL FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 'maven', CAST(p_partkey AS VARCHAR), 'artifact-' || p_size, NULL FROM part WHERE p_partkey % 3 = 2""")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of manifests written from parts."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    npm = F.concat(F.lit('{"dependencies": {"lib'), n, F.lit('": "^'), n, F.lit('.0"}, "devDependencies": {"dev": "1.0"}}'))
    pip = F.concat(F.lit("# pinned\npkg"), n, F.lit("==2."), n, F.lit("\n\nplain  # any\n"))
    pom = F.concat(F.lit("<project><dependencies><dependency><groupId>g</groupId><artifactId>artifact-"), n, F.lit("</artifactId></dependency></dependencies></project>"))
    files = p.select(F.col("p_partkey").cast("string").alias("path"), F.when(k == 0, "package.json").when(k == 1, "requirements.txt").otherwise("pom.xml").alias("name"), F.when(k == 0, npm).when(k == 1, pip).otherwise(pom).alias("content"))
    return S.manifest_dependencies(files)


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'eslint' WHEN 1 THEN 'bandit' ELSE 'pylint' END AS tool, 'f' || user_id AS file, CAST(event_id AS INTEGER) AS line, event_type AS rule, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'low' END AS severity, 'm' AS message FROM events WHERE event_id % 4 <> 3""")
def tool_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of linter reports written from events; each fourth report is malformed."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    i, u, t = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    es = F.concat(F.lit('[{"filePath": "f'), u, F.lit('", "messages": [{"line": '), i, F.lit(', "ruleId": "'), t, F.lit('", "severity": 2, "message": "m"}]}]'))
    ba = F.concat(F.lit('{"results": [{"filename": "f'), u, F.lit('", "line_number": '), i, F.lit(', "test_id": "'), t, F.lit('", "issue_severity": "LOW", "issue_text": "m"}]}'))
    py = F.concat(F.lit('[{"path": "f'), u, F.lit('", "line": '), i, F.lit(', "symbol": "'), t, F.lit('", "type": "convention", "message": "m"}]'))
    text = F.when(k == 0, es).when(k == 1, ba).otherwise(py)
    reports = e.select(F.when(k == 0, "eslint").when(k == 1, "bandit").otherwise("pylint").alias("tool"), F.when(F.col("event_id") % 4 == 3, F.expr("'{ broken'")).otherwise(text).alias("stdout"))
    return S.tool_issues(reports)


@query(f"""WITH {CHUNKS_SQL} SELECT CASE WHEN regexp_matches(file_path, '\\.(json|ya?ml)$') THEN 'configuration' WHEN regexp_matches(file_path, '\\.(md|txt)$') THEN 'documentation' WHEN regexp_matches(file_path, '\\.(html|vue)$') THEN 'template' WHEN regexp_matches(file_path, '\\.css$') THEN 'style' ELSE 'source_code' END AS file_class, CAST(count(*) AS BIGINT) AS files FROM chunks GROUP BY 1""")
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.classify import file_class

    return chunks(spark, sf_dir).groupBy(file_class(F.col("file_path")).alias("file_class")).agg(F.count("*").alias("files"))
