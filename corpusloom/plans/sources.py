"""Declarations, sections, manifests and routes of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import chunking as C
from ..operators import declarations as D
from ..operators import manifests as M
from ..operators import routes as R
from ..sources import code
from ..sources.tables import table
from .registry import query

#: Language of each kind of generated file.
LANGUAGES = {"java": "java", "react": "tsx", "flask": "python", "streamlit": "python", "vue": "vue"}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return code.files(spark, sf_dir).withColumn("language", F.try_element_at(mapping, F.col("kind")))


@query()
def code_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declarations of all files with parent, lines, complexity and relations."""
    found = D.declarations(_files(spark, sf_dir), "file_id", "content", "language")
    return found.select("file_id", "kind", "name", "parent", "level", "start_line", "end_line", "complexity", "own_complexity", "cognitive", *[F.array_join(c, ", ").alias(c) for c in ("parameters", "extends", "implements", "annotations", "calls")])


@query()
def code_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inheritance, implementations and calls between declared names, with the files that have them."""
    found = D.relationships(D.declarations(_files(spark, sf_dir), "file_id", "content", "language"), "file_id")
    return found.groupBy("source", "target", "relation").agg(F.count("*").alias("files"))


@query()
def halstead_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, depth, and operator and operand measures of all files."""
    found = D.file_measures(_files(spark, sf_dir), "file_id", "content", "language")
    return found.withColumns({c: F.round(c, 6) for c in ("difficulty", "effort", "volume")})


@query()
def cleaned_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of each file without comments."""
    found = D.cleaned(_files(spark, sf_dir).select("file_id", "content", "language"), "content", "language")
    return found.select("file_id", F.length("content").alias("size"), F.md5("content").alias("digest"))


@query(f"""WITH {code.SQL}, v AS (SELECT file_id, content FROM files WHERE kind = 'vue'),
p AS (SELECT file_id, content, 'template' AS section, 'html' AS language, regexp_extract(content, '(?s)<template>.*</template>') AS whole, 0.8::DOUBLE AS importance FROM v UNION ALL SELECT file_id, content, 'script', 'javascript', regexp_extract(content, '(?s)<script>.*?</script>'), 0.9::DOUBLE FROM v
 UNION ALL SELECT file_id, content, 'style', 'css', regexp_extract(content, '(?s)<style>.*?</style>'), 0.5::DOUBLE FROM v),
x AS (SELECT *, CAST(len(string_split(left(content, CAST(strpos(content, whole) AS BIGINT) - 1), chr(10))) AS INTEGER) AS start_line, regexp_extract(whole, '(?s)^<[a-z]+>(.*)</[a-z]+>$', 1) AS inner_ FROM p)
SELECT file_id, section, language, start_line, CAST(start_line + len(string_split(whole, chr(10))) - 1 AS INTEGER) AS end_line, importance, md5(inner_) AS digest FROM x""")
def component_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template, script and style of each single-file component."""
    found = C.component_sections(code.files(spark, sf_dir).where("kind = 'vue'"), "file_id", "content")
    return found.select("file_id", "section", "language", "start_line", "end_line", "importance", F.md5("content").alias("digest"))


_CHUNK_SQL = " UNION ALL ".join(f"SELECT file_id, '{c}' AS chunk, unnest(regexp_extract_all(content, {code.quoted(p)}, {g})) AS name FROM files WHERE kind = 'streamlit'" for c, p, g, _ in C.STREAMLIT_CHUNKS)


@query(f"""WITH {code.SQL}, c AS ({_CHUNK_SQL}) SELECT file_id, chunk, name, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""")
def streamlit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, widgets, displays, layouts and cached functions of Streamlit sources."""
    found = C.streamlit_chunks(code.files(spark, sf_dir).where("kind = 'streamlit'"), "file_id", "content")
    return found.groupBy("file_id", "chunk", "name").agg(F.count("*").alias("n"))


#: A dependency of each part, and the least version of its constraint.
_PACKAGES = [("npm", "@angular/core"), ("npm", "angular"), ("npm", "vue"), ("pip", "Django"), ("maven", "spring-core")]
_RULES_SQL = ", ".join(f"('{f}', '{k}', '^(?:{p})$', {low or 0}, {high or 100}, {c}::DOUBLE)" for f, k, p, low, high, c in M.RULES)
_DEPENDENCY_SQL = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{{}}'" for i in range(5)) + " END"


@query(f"""WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS path, {_DEPENDENCY_SQL.format(*[k for k, _ in _PACKAGES])} AS kind, {_DEPENDENCY_SQL.format(*[d for _, d in _PACKAGES])} AS dependency, CASE p_size % 3 WHEN 0 THEN '^' || p_size % 5 || '.1' WHEN 1 THEN '>=' || p_size % 5 || '.0' END AS version,
 CASE p_size % 3 WHEN 2 THEN 0 ELSE p_size % 5 END AS low, CASE p_size % 3 WHEN 0 THEN p_size % 5 + 1 ELSE 1000 END AS high FROM part),
r(framework, kind, pattern, least, below, confidence) AS (VALUES {_RULES_SQL})
SELECT path, framework, dependency, version, confidence FROM d JOIN r ON r.kind = d.kind AND regexp_matches(dependency, pattern) AND low < below AND least < CASE WHEN version IS NOT NULL AND version[1] = '^' AND low = 0 THEN 0.2 ELSE high END""")
def framework_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frameworks of manifests written from parts: a dependency with a caret, a least version or none."""
    pick = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in _PACKAGES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    major = (F.col("p_size") % 5).cast("string")
    version = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("^"), major, F.lit(".1"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(">="), major, F.lit(".0")))
    return M.frameworks(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), pick(0).alias("kind"), pick(1).alias("dependency"), version.alias("version")))


@query("""SELECT p_partkey AS part, CAST(split_part(v, '.', 1) AS INTEGER) AS major, v AS version, row_number() OVER (PARTITION BY p_size ORDER BY CAST(split_part(v, '.', 1) AS INTEGER), CAST(split_part(v, '.', 2) AS INTEGER), p_partkey) AS place FROM (SELECT p_partkey, p_size, (p_partkey % 13) || '.' || (p_partkey % 11) AS v FROM part)""")
def ordered_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a size in order of their versions, which are no decimal numbers."""
    from pyspark.sql import Window

    v = F.concat((F.col("p_partkey") % 13).cast("string"), F.lit("."), (F.col("p_partkey") % 11).cast("string"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size", v.alias("version"))
    key = V.key(F.col("version"))
    place = F.row_number().over(Window.partitionBy("p_size").orderBy(key, "part")).cast("long")
    return p.select("part", key[0].alias("major"), "version", place.alias("place"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), t AS (SELECT k, k // 4 AS up, n FROM s),
r AS (SELECT k AS root, k, '' AS prefix, 1 AS depth FROM t WHERE up = k OR up NOT IN (SELECT k FROM s) UNION ALL SELECT r.root, t.k, r.prefix || '/m' || t.k, depth + 1 FROM r JOIN t ON t.up = r.k AND t.k <> r.k)
SELECT 'm' || root || '.urls' AS root, prefix || '/nation/' || n AS path, 'show_' || r.k AS handler, CAST(depth AS INTEGER) AS depth FROM r JOIN s USING (k)""")
def included_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of URL tables written from suppliers, each of which includes those of four others, to any depth."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    below = s.select(F.floor(F.col("k") / 4).alias("up"), "k").where("up <> k").groupBy("up").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("    path('m%d/', include('m%d.urls')),", F.col("k"), F.col("k")))), "\n").alias("lines"))
    text = F.concat(F.lit("urlpatterns = [\n    path('nation/"), F.col("n").cast("string"), F.lit("/', show_"), F.col("k").cast("string"), F.lit("),\n"), F.coalesce("lines", F.lit("")), F.lit("\n]\n"))
    files = s.join(below, F.col("up") == F.col("k"), "left").select(F.format_string("m%d/urls.py", F.col("k")).alias("file_path"), text.alias("content"))
    return R.included_routes(R.url_entries(files)).select("root", "path", "handler", F.size("modules").alias("depth"))


@query(f"""WITH {code.SQL}, f AS (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, bool_or(contains(content, 'Flask(') OR contains(content, '@RestController')) AS is_service, count(*) AS n_files FROM files GROUP BY 1), r AS (SELECT folder, n_files FROM f WHERE is_service),
up AS (SELECT folder, array_to_string(string_split(folder, '/')[1:n], '/') AS above FROM (SELECT folder, unnest(range(1, len(string_split(folder, '/')))) AS n FROM r))
SELECT folder, CAST(n_files AS BIGINT) AS n_files FROM r WHERE NOT EXISTS (SELECT 1 FROM up JOIN r a ON a.folder = up.above WHERE up.folder = r.folder)""")
def service_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that look like roots of services, without those at any depth below another."""
    service = F.contains("content", F.lit("Flask(")) | F.contains("content", F.lit("@RestController"))
    f = code.files(spark, sf_dir).groupBy(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.bool_or(service).alias("is_service"), F.count("*").alias("n_files"))
    return M.topmost(f.where("is_service").select("folder", "n_files"))
