"""Quality of projects of 25 source files: dimensions, validators, framework rules and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assessment as A
from ..sources import code
from ..sources.tables import CHUNKS_SQL, chunks
from .registry import query

PROJECT = 25
#: Framework of each kind of file; every fifth project is of one framework.
FRAMEWORKS = {"java": "spring-boot", "react": "react", "flask": "python", "vue": "angular"}
#: What stands in a text for a pattern.
PATTERNS = {"singleton": "getInstance", "observer": "subscribe", "repository": "Repository"}
#: Characters that a validation reads in a millisecond; stands for a measured time.
PACE = 4


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with what the assessment reads, project by project."""
    project = F.floor(F.col("file_id") / PROJECT).cast("long")
    content = F.col("content")
    first = lambda pattern: F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
    framework = F.when(project % 5 == 0, F.lit("spring-boot"))
    for kind, name in FRAMEWORKS.items():
        framework = framework.when(F.col("kind") == kind, F.lit(name))
    place = F.col("file_id") % 7
    role = F.when(place == 0, "controller").when(place == 1, "service").when((place == 2) & (project % 3 != 0), "repository").otherwise(F.col("kind"))
    meta = chunks(spark, sf_dir).select(F.col("chunk_idx").alias("file_id"), "importance", "complexity", "dependencies")
    more = F.when(F.col("file_id") % 17 == 3, F.array(F.lit("undefined-lib"))).otherwise(F.array().cast("array<string>"))
    found = [F.when(F.contains(content, F.lit(word)), F.lit(name)) for name, word in PATTERNS.items()]
    return code.files(spark, sf_dir).join(meta, "file_id").select(
        project.alias("project"),
        F.col("file_id").alias("id"),
        F.coalesce(first(r"class (\w+)"), first(r"def (\w+)")).alias("name"),
        role.alias("type"),
        framework.alias("framework"),
        "content",
        F.concat("dependencies", more).alias("dependencies"),
        F.array_compact(F.array(*found)).alias("patterns"),
        F.regexp_extract_all(content, F.lit(r"@(\w+)"), F.lit(1)).alias("annotations"),
        "importance",
        "complexity",
    )


_PARTS_SQL = f"""{code.SQL}, {CHUNKS_SQL}, parts AS (SELECT file_id // {PROJECT} AS project, file_id AS id, coalesce(nullif(regexp_extract(f.content, 'class (\\w+)', 1), ''), nullif(regexp_extract(f.content, 'def (\\w+)', 1), '')) AS name,
 CASE WHEN file_id % 7 = 0 THEN 'controller' WHEN file_id % 7 = 1 THEN 'service' WHEN file_id % 7 = 2 AND (file_id // {PROJECT}) % 3 <> 0 THEN 'repository' ELSE kind END AS type,
 CASE WHEN (file_id // {PROJECT}) % 5 = 0 THEN 'spring-boot' {' '.join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in FRAMEWORKS.items())} END AS framework, f.content,
 list_concat(dependencies, CASE WHEN file_id % 17 = 3 THEN ['undefined-lib'] ELSE CAST([] AS VARCHAR[]) END) AS dependencies,
 list_filter([{', '.join(f"CASE WHEN contains(f.content, '{w}') THEN '{k}' END" for k, w in PATTERNS.items())}], lambda x: x IS NOT NULL) AS patterns,
 regexp_extract_all(f.content, '@(\\w+)', 1) AS annotations, importance, complexity FROM files f JOIN chunks c ON c.chunk_idx = f.file_id)"""


def _has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {code.quoted(w)})" for w in words) + ")"


def _lacks(column: str, has: tuple[str, ...], lacks: tuple[str, ...]) -> str:
    return f"({_has(column, *has)} AND NOT {_has(column, *lacks)})"


def _n(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def _times(ch: str) -> str:
    return f"len(regexp_extract_all(content, '[{ch}]'))"


_DEPRECATED = [(("vector",), ("arraylist",)), (("hashtable",), ("hashmap",)), (("var ",), ("let ", "const "))]
_MODERN = [("@override", "lambda", "stream"), ("const ", "let ", "=>"), ("async def", "type hint", "dataclass")]
_UNRELIABLE = [((".",), ("null check", "optional")), (("new ", "open("), ("close", "with "))]

#: A project's counts, as a plain SQL user would write them.
_MEASURED_SQL = f"""{_PARTS_SQL}, low AS (SELECT *, lower(content) AS t FROM parts),
m AS (SELECT project, count(*) AS parts, sum(length(content)) AS size, {_n(_lacks('content', ('{',), ('}',)))} + {_n(_lacks('content', ('(',), (')',)))} + {_n(_lacks('content', ('[',), (']',)))} AS syntax_errors,
 {_n(f"{_times('{')} <> {_times('}')}")} + {_n(f"{_times('(')} <> {_times(')')}")} AS unlike,
 count(name) AS named, {_n("regexp_matches(name, '^[a-z][a-zA-Z0-9]*$')")} AS camel, {_n("regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')")} AS pascal, {_n("regexp_matches(name, '^[a-z][a-z0-9_]*$')")} AS snake,
 {_n("length(name) BETWEEN 3 AND 30 AND NOT regexp_matches(name, '^[a-z]+$')")} AS clear, {_n('len(annotations) > 0 OR len(patterns) > 0 OR framework IS NOT NULL')} AS compliant,
 bool_or(coalesce(contains(framework, 'spring'), false)) AS spring, bool_or(type = 'controller') AS controllers, bool_or(type = 'service') AS services, bool_or(type = 'repository') AS repositories,
 {_n("len(list_filter(dependencies, lambda d: contains(d, 'undefined') OR contains(d, 'null'))) > 0")} AS incomplete, {_n("len(list_filter(dependencies, lambda d: contains(d, 'undefined'))) > 0")} AS unresolved,
 {_n(_has('content', '/**', '"""', '///'))} AS documented, avg(importance) AS importance, {_n('importance < 0.3 AND len(dependencies) = 0')} AS unused, avg(complexity) AS complexity,
 {' + '.join(_n(_lacks('t', *x)) for x in _DEPRECATED)} AS deprecated, {' + '.join(_n(_has('t', *x)) for x in _MODERN)} AS modern, {_n(_has('t', 'try', 'catch', 'except', 'finally', 'throw', 'raise'))} AS handled,
 {' + '.join(_n(_lacks('t', *x)) for x in _UNRELIABLE)} AS unreliable, {_n(_has('t', 'password') + ' AND ' + _has('t', '=') + ' AND ' + _has('t', chr(34)))} + {_n(_has('t', 'sql') + ' AND ' + _has('t', '+'))} AS insecure FROM low GROUP BY project),
fw AS (SELECT project, max(n) / sum(n) AS one_framework FROM (SELECT project, framework, count(*) AS n FROM parts WHERE framework IS NOT NULL GROUP BY ALL) GROUP BY project),
pt AS (SELECT project, max(n) / sum(n) AS one_pattern FROM (SELECT project, pattern, count(*) AS n FROM (SELECT project, unnest(patterns) AS pattern FROM parts) GROUP BY ALL) GROUP BY project),
vs AS (SELECT project, size, 'syntax' AS validator, CAST(100 - 10 * unlike AS DOUBLE) AS score, 70 AS least FROM m UNION ALL SELECT project, size, 'structure', CASE WHEN controllers AND services AND repositories THEN 90.0 ELSE 70.0 END, 60 FROM m
 UNION ALL SELECT project, size, 'consistency', CASE WHEN named > 0 THEN 85e0 * (greatest(camel, pascal) / named) ELSE 85e0 END, 70 FROM m UNION ALL SELECT project, size, 'completeness', CAST(80 - 5 * unresolved AS DOUBLE), 60 FROM m UNION ALL SELECT project, size, 'security', CAST(95 - 15 * insecure AS DOUBLE), 70 FROM m),
v AS (SELECT project, validator, round(greatest(0, score), 4) AS score, score >= least AS passed, CAST(size AS DOUBLE) / {PACE} AS millis FROM vs),
br AS ({' UNION ALL '.join(f"SELECT project, id, '{r.rule}' AS rule, '{r.severity}' AS severity FROM parts WHERE contains(framework, '{r.framework}') AND contains(content, {code.quoted(r.has)}) AND NOT contains(content, {code.quoted(r.lacks)})" for r in A.FRAMEWORK_RULES)}),
pi AS (SELECT project, validator, 'validation_failure' AS type, 'high' AS severity, 0.9e0 AS confidence FROM v WHERE NOT passed UNION ALL SELECT project, validator, 'performance_degradation', 'medium', 0.8e0 FROM v WHERE millis > 5000)"""


def _validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.validations(A.measures(parts(spark, sf_dir), "project"), "project", F.col("size") / PACE)


@query(f"WITH {_MEASURED_SQL} SELECT project, id, rule, severity FROM br")
def framework_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that break a rule of their framework."""
    return A.broken_rules(parts(spark, sf_dir), "project")


@query(f"WITH {_MEASURED_SQL} SELECT project, validator, score, passed, millis FROM v")
def project_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five validators on each project."""
    return _validations(spark, sf_dir)


@query(f"WITH {_MEASURED_SQL} SELECT project, validator, type, severity, confidence FROM pi")
def processing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and slow validations; a validation's time is estimated from the text that it reads."""
    return A.processing_issues(_validations(spark, sf_dir), "project")


@query(f"""WITH {_MEASURED_SQL}, issues AS (SELECT project, severity FROM pi WHERE type = 'performance_degradation' UNION ALL SELECT project, severity FROM br),
cost AS (SELECT project, sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 7 WHEN 'medium' THEN 3 ELSE 0 END) AS cost FROM issues GROUP BY project),
d AS (SELECT project, (85 - least(30, 5 * syntax_errors) - CASE WHEN named > 0 AND greatest(camel, pascal, snake) / named < 0.8 THEN 10 ELSE 0 END) * (compliant / parts) AS accuracy,
 80 - CASE WHEN spring THEN 10 * (CAST(NOT controllers AS INT) + CAST(NOT services AS INT) + CAST(NOT repositories AS INT)) ELSE 0 END - 5 * incomplete - CASE WHEN documented / parts < 0.5 THEN 15 ELSE 0 END AS completeness,
 90 - CASE WHEN importance < 0.5 THEN 20 ELSE 0 END - least(15, 2 * unused) AS relevance, 85 - CASE WHEN coalesce(one_pattern, 1) < 0.8 THEN 15 ELSE 0 END - CASE WHEN coalesce(one_framework, 1) < 0.9 THEN 10 ELSE 0 END AS consistency,
 80 - CASE WHEN complexity > 7 THEN 20 ELSE 0 END - CASE WHEN named > 0 AND clear / named < 0.8 THEN 15 ELSE 0 END AS clarity, 95 - 5 * deprecated - CASE WHEN modern / parts < 0.8 THEN 10 ELSE 0 END AS timeliness,
 85 - CASE WHEN handled / parts < 0.7 THEN 15 ELSE 0 END - 3 * unreliable AS reliability FROM m LEFT JOIN fw USING (project) LEFT JOIN pt USING (project)),
b AS (SELECT project, {', '.join(f'CAST(greatest(0, least(100, {k})) AS DOUBLE) AS {k}' for k in A.WEIGHTS)} FROM d),
o AS (SELECT b.*, round(greatest(0, least(100, ({' + '.join(f'{k} * {w}' for k, w in A.WEIGHTS.items())}) - coalesce(cost, 0))), 4) AS overall FROM b LEFT JOIN cost USING (project))
SELECT project, {', '.join(f'round({k}, 4) AS {k}' for k in A.WEIGHTS)}, overall, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair' WHEN overall >= 40 THEN 'poor' ELSE 'critical' END AS level FROM o""")
def quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven dimensions, overall score and level of each project, less its slow validations and its broken rules."""
    p = parts(spark, sf_dir)
    slow = processing_issues(spark, sf_dir).where("type = 'performance_degradation'").select("project", "severity")
    broken = A.broken_rules(p, "project").select("project", "severity")
    return A.dimensions(A.measures(p, "project"), slow.unionByName(broken), "project")
