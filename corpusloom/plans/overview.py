"""Overviews, lookups and selections over chunks, files and logs, written once in SQL that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import code
from ..sources.tables import CHUNKS_SQL, chunks, table
from .both import X, col, derived, first_of, labels, lit, rounded, weighed
from .registry import ORACLE_SQL, QUERIES

SOURCES: dict[str, tuple[Callable, str]] = {"chunks": (chunks, CHUNKS_SQL), "files": (code.files, code.SQL)}


def _shared(name: str, doc: str, sql: str, planned: str | None = None) -> None:
    """Registers SQL in which {name} stands for a table or a derived one, and EACH(array) for a row of each of its elements.

    ``planned``, if given, is what Spark runs to get the same rows from less work.
    """
    used = [n for n in ("chunks", "files", "documents", "events", "conversations", "labels", "supplier", "part", "lineitem", "orders") if f"{{{n}}}" in sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql((planned or sql).replace("EACH(", "explode("), **{n: SOURCES[n][0](spark, sf_dir) if n in SOURCES else table(spark, sf_dir, n) for n in used})

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    own = ",\n".join(SOURCES[n][1] for n in used if n in SOURCES)
    text = sql.replace("EACH(", "unnest(").format(**{n: n for n in used})
    ORACLE_SQL[name] = (f"WITH {own}" + (", " + text.removeprefix("WITH ") if text.startswith("WITH ") else " " + text)) if own else text


_shared(
    "chunks_of_each_type",
    "The first 20 chunks of each type and the first 5 of each file, in order of insertion.",
    """SELECT id, chunk_type, file_path, type_rank FROM (
SELECT id, chunk_type, file_path, row_number() OVER (PARTITION BY chunk_type ORDER BY chunk_idx) AS type_rank, row_number() OVER (PARTITION BY file_path ORDER BY chunk_idx) AS file_rank FROM {chunks}) WHERE type_rank <= 20 AND file_rank <= 5""",
)

_shared(
    "scope_filter",
    "Chunks that fit the scope of a question: classes, functions or files.",
    """SELECT id, CASE WHEN chunk_type = 'class' OR class_name IS NOT NULL THEN true ELSE false END AS in_class_scope,
CASE WHEN chunk_type = 'function' OR function_name IS NOT NULL THEN true ELSE false END AS in_function_scope, CASE WHEN chunk_type = 'file' THEN true ELSE false END AS in_file_scope
FROM {chunks} WHERE chunk_type <> 'block' AND (language = 'en' OR importance > 0.6e0)""",
)

_shared(
    "frameworks_of_languages",
    "Frameworks with chunks of each language and of each file extension.",
    """SELECT language, framework, extension, count(*) AS n_chunks FROM {chunks} GROUP BY language, framework, extension""",
)

_shared(
    "code_chunks_first_wins",
    "Classes, functions and Java files, each chunk once, from the first of these sources that has it.",
    """WITH u AS (SELECT id, 1 AS source_order, 'class' AS found_as FROM {chunks} WHERE chunk_type = 'class'
UNION ALL SELECT id, 2, 'function' FROM {chunks} WHERE chunk_type = 'function' UNION ALL SELECT id, 3, 'java' FROM {chunks} WHERE extension = 'java')
SELECT id, found_as FROM (SELECT id, found_as, row_number() OVER (PARTITION BY id ORDER BY source_order) AS n FROM u) WHERE n = 1""",
)

_shared(
    "codebase_stats",
    "Chunks of each type, each number at most 1000, and how many classes and functions have a name of their own.",
    """SELECT count(*) AS n_chunks, least(1000, count(CASE WHEN chunk_type = 'class' THEN 1 END)) AS n_classes, least(1000, count(CASE WHEN chunk_type = 'function' THEN 1 END)) AS n_functions,
least(1000, count(CASE WHEN chunk_type = 'file' THEN 1 END)) AS n_files, count(DISTINCT class_name) AS class_names, count(DISTINCT function_name) AS function_names, count(DISTINCT file_path) AS paths FROM {chunks}""",
)

_shared(
    "codebase_summary",
    "Totals and the five languages with the most lines.",
    """WITH l AS (SELECT language, count(*) AS n_files, CAST(sum(end_line) AS BIGINT) AS n_lines FROM {chunks} GROUP BY language)
SELECT language, n_files, n_lines, total_files, total_lines, round(n_lines * 100e0 / total_lines, 6) AS percent FROM (
SELECT language, n_files, n_lines, CAST(sum(n_files) OVER () AS BIGINT) AS total_files, CAST(sum(n_lines) OVER () AS BIGINT) AS total_lines, row_number() OVER (ORDER BY n_lines DESC, language) AS n FROM l) WHERE n <= 5""",
)

_shared(
    "root_directories",
    "Files of each top folder and of the folders below it, with the purpose that the name tells.",
    """SELECT root, sub, n_files, CASE WHEN root IN ('src', 'lib', 'app') THEN 'source' WHEN contains(root, 'test') THEN 'tests' WHEN contains(root, 'doc') THEN 'documentation' WHEN root IN ('services', 'dashboards') THEN 'application' ELSE 'other' END AS purpose
FROM (SELECT split_part(file_path, '/', 1) AS root, split_part(file_path, '/', 2) AS sub, count(*) AS n_files FROM {files} GROUP BY split_part(file_path, '/', 1), split_part(file_path, '/', 2))""",
)

_shared(
    "test_structure",
    "Test files and the first test framework by precedence, for each kind of file.",
    """SELECT kind, count(CASE WHEN contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') THEN 1 END) AS n_test_files, count(CASE WHEN contains(content, 'unit') THEN 1 END) AS n_unit, count(CASE WHEN contains(content, 'integration') THEN 1 END) AS n_integration,
CASE WHEN bool_or(contains(content, '@Test')) THEN 'junit' WHEN bool_or(contains(content, 'describe(')) THEN 'jest' WHEN bool_or(contains(content, 'def test_')) THEN 'pytest' ELSE 'none' END AS test_framework FROM {files} GROUP BY kind""",
)

_shared(
    "key_file_types",
    "The five most frequent extensions.",
    "SELECT extension, n FROM (SELECT extension, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, extension) AS r FROM {chunks} GROUP BY extension) WHERE r <= 5",
)

_shared(
    "primary_languages",
    "The most frequent language of each framework.",
    """SELECT framework, language, n FROM (SELECT framework, language, count(*) AS n, row_number() OVER (PARTITION BY framework ORDER BY count(*) DESC, language) AS r FROM {chunks} GROUP BY framework, language) WHERE r = 1""",
)

_shared(
    "service_architecture",
    "Number and mean size of services, coupling, cohesion, deployable and testable shares; a framework is a service, a class its API.",
    """WITH s AS (SELECT framework, CAST(sum(end_line) AS BIGINT) AS size, count(DISTINCT class_name) AS exposed, count(DISTINCT function_name) AS consumed, count(DISTINCT component_type) AS parts FROM {chunks} WHERE framework IS NOT NULL GROUP BY framework)
SELECT count(*) AS services, round(avg(size), 6) AS mean_size, round(CASE WHEN count(*) > 1 THEN sum(CASE WHEN consumed > 3 THEN 1e0 ELSE 0e0 END) / (count(*) * (count(*) - 1)) ELSE 0e0 END, 6) AS coupling,
round(avg(CASE WHEN exposed BETWEEN 1 AND 3 THEN 1e0 ELSE 0e0 END), 6) AS cohesion, round(avg(CASE WHEN parts > 1 THEN 1e0 ELSE 0e0 END), 6) AS deployable, round(avg(CASE WHEN consumed <= 3 THEN 1e0 ELSE 0e0 END), 6) AS testable FROM s""",
)

_shared(
    "code_metrics",
    "Mean lines and complexity, classes of complexity, documented, covered and compliant shares of each framework.",
    """SELECT framework, count(*) AS n, round(avg(end_line - start_line + 1), 6) AS mean_lines, round(avg(complexity), 6) AS mean_complexity, count(CASE WHEN complexity > 7 THEN 1 END) AS n_high, count(CASE WHEN complexity BETWEEN 4 AND 7 THEN 1 END) AS n_medium,
count(CASE WHEN complexity < 4 THEN 1 END) AS n_low, round(avg(CASE WHEN contains(content, '/*') OR contains(content, '#') THEN 100e0 ELSE 0e0 END), 6) AS documented, round(avg(CASE WHEN contains(file_path, 'test') THEN 100e0 ELSE 0e0 END), 6) AS covered,
round(avg(CASE WHEN importance >= 0.5e0 THEN 100e0 ELSE 0e0 END), 6) AS compliant FROM {chunks} GROUP BY framework""",
)

_shared(
    "practice_shares",
    "Shares of files of each kind with documentation, error handling, modern constructs and their framework's conventions.",
    """SELECT kind, round(avg(CASE WHEN contains(content, '/**') OR contains(content, '//') OR contains(content, '# ') THEN 1e0 ELSE 0e0 END), 6) AS documented, round(avg(CASE WHEN contains(content, 'try') AND (contains(content, 'catch') OR contains(content, 'except')) THEN 1e0 ELSE 0e0 END), 6) AS handles_errors,
round(avg((CASE WHEN contains(content, 'async') OR contains(content, 'await') THEN 1e0 ELSE 0e0 END) + (CASE WHEN contains(content, '=>') THEN 1e0 ELSE 0e0 END) + (CASE WHEN contains(content, 'const ') THEN 1e0 ELSE 0e0 END)), 6) AS modern,
round(avg(CASE WHEN contains(content, '@RestController') OR contains(content, 'useState') OR contains(content, '@app.') OR contains(content, 'st.') OR contains(content, '<template>') THEN 1e0 ELSE 0e0 END), 6) AS compliant FROM {files} GROUP BY kind""",
)

#: (kind of file, indicator, weight): what tells a framework in a file's text.
INDICATORS = [
    ("spring-boot", "@RestController", 0.4), ("spring-boot", "@Autowired", 0.3), ("spring-boot", "@GetMapping", 0.3), ("react", "from 'react'", 0.5), ("react", "useState", 0.3), ("react", "useEffect", 0.2), ("flask", "from flask", 0.6),
    ("flask", "@app.route", 0.4), ("fastapi", "@app.get", 1.0), ("streamlit", "import streamlit", 0.6), ("streamlit", "st.session_state", 0.4), ("vue", "<template>", 0.6), ("vue", "v-if", 0.4), ("angular", "@Component(", 0.5),
    ("angular", "@Injectable(", 0.5),
]
_RULES = ", ".join(f"({k}, '{f}', {code.quoted(i)}, CAST({w} AS DOUBLE))" for k, (f, i, w) in enumerate(INDICATORS))

_shared(
    "framework_scores",
    "Score of each framework in each file by its indicators, and which of them the file is of: the best, if it reaches .5.",
    f"""WITH hits AS (SELECT file_id, framework, min(ord) AS ord, sum(weight) AS score, count(*) AS n_hits FROM {{files}} JOIN (VALUES {_RULES}) AS r(ord, framework, indicator, weight) ON contains(content, indicator) GROUP BY file_id, framework)
SELECT file_id, framework, round(score, 6) AS score, n_hits, row_number() OVER (PARTITION BY file_id ORDER BY round(score, 6) DESC, ord) = 1 AND round(score, 6) >= 0.5e0 AS is_framework FROM hits""",
)


def _hits(files: DataFrame) -> DataFrame:
    """(file_id, framework, ord, score, whole, n_hits) of each file, from one look at its text: no join and no shuffle."""

    def scores(text):  # the text is a variable here, so that what makes it is worked out once for all indicators
        rows = []
        for framework in dict.fromkeys(f for f, _, _ in INDICATORS):
            own = [(F.contains(text, F.lit(i)), k, w) for k, (f, i, w) in enumerate(INDICATORS) if f == framework]
            score = sum((F.when(h, w).otherwise(0.0) for h, _, w in own[1:]), F.when(own[0][0], own[0][2]).otherwise(0.0))
            first = F.least(*[F.when(h, k) for h, k, _ in own], F.lit(len(INDICATORS)))
            n = sum((h.cast("bigint") for h, _, _ in own[1:]), own[0][0].cast("bigint"))
            rows.append(F.struct(F.round(score, 6).alias("score"), (-first).alias("ord"), F.lit(framework).alias("framework"), n.alias("n_hits"), score.alias("whole")))
        return F.array_sort(F.filter(F.array(*rows), lambda r: r["n_hits"] > 0), lambda x, y: F.when(F.struct(x["score"], x["ord"]) > F.struct(y["score"], y["ord"]), -1).otherwise(1))

    found = files.select("file_id", F.posexplode(F.transform(F.array("content"), scores)[0]).alias("place", "r"))
    return found.select("file_id", "place", "r.*")


def framework_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each framework in each file by its indicators, and which of them the file is of: the best, if it reaches .5."""
    found = _hits(code.files(spark, sf_dir))
    return found.select("file_id", "framework", "score", "n_hits", ((F.col("place") == 0) & (F.col("score") >= 0.5)).alias("is_framework"))


QUERIES["framework_scores"] = framework_scores

_shared(
    "framework_confidence",
    "Confidence in each framework over all files: primary, secondary or neither, and the mean.",
    f"""WITH hits AS (SELECT file_id, framework, sum(weight) AS score FROM {{files}} JOIN (VALUES {_RULES}) AS r(ord, framework, indicator, weight) ON contains(content, indicator) GROUP BY file_id, framework),
c AS (SELECT framework, count(*) AS n_files, round(avg(round(least(score, 1e0), 6)), 6) AS confidence FROM hits GROUP BY framework)
SELECT framework, n_files, confidence, CASE WHEN r = 1 THEN 'primary' WHEN r <= 3 THEN 'secondary' ELSE 'other' END AS standing, round(mean_confidence, 6) AS mean_confidence FROM (SELECT *, row_number() OVER (ORDER BY n_files DESC, framework) AS r, avg(confidence) OVER () AS mean_confidence FROM c)""",
)


def framework_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in each framework over all files: primary, secondary or neither, and the mean; only the frameworks' totals meet in one task."""
    c = _hits(code.files(spark, sf_dir)).groupBy("framework").agg(F.count("*").alias("n_files"), F.round(F.avg(F.round(F.least("whole", F.lit(1.0)), 6)), 6).alias("confidence"))
    place = F.row_number().over(Window.orderBy(F.desc("n_files"), "framework"))
    c = c.withColumns({"r": place, "mean_confidence": F.round(F.avg("confidence").over(Window.partitionBy()), 6)})
    return c.select("framework", "n_files", "confidence", F.when(F.col("r") == 1, "primary").when(F.col("r") <= 3, "secondary").otherwise("other").alias("standing"), "mean_confidence")


QUERIES["framework_confidence"] = framework_confidence

_shared(
    "step_confidence",
    "Confidence of a chain of steps, later steps weighing more; a conversation is a chain, its turns are steps.",
    """WITH s AS (SELECT conv_id, 1e0 / (1 + length(text) % 7) AS confidence, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations})
SELECT conv_id, max(n) AS n_steps, round(sum(confidence * i / n) / max(n), 6) AS confidence FROM s GROUP BY conv_id""",
)

_shared(
    "running_statistics",
    "Mean and number of updates of each kind after each day, as an index keeps them.",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total FROM {events} GROUP BY event_type, CAST(ts AS DATE))
SELECT event_type, CAST(day AS STRING) AS day, CAST(sum(n) OVER w AS BIGINT) AS n_updates, round(sum(total) OVER w / sum(n) OVER w, 4) AS mean_value FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)

_shared(
    "answer_confidence",
    "Mean importance of a framework's chunks, raised by their number, at most 1; with type coverage as compatibility.",
    """SELECT framework, round(least(1e0, avg(importance) * (1 + ln(count(*)) / 10)), 6) AS confidence, round(count(DISTINCT chunk_type) * 100e0 / 5, 6) AS compatibility, round(avg(importance) - min(importance), 6) AS improvement, count(CASE WHEN complexity > 8 THEN 1 END) AS n_violations FROM {chunks} GROUP BY framework""",
)

_shared(
    "type_groups",
    "Groups of at least two chunks of a type in a framework, with their first chunk.",
    "SELECT framework, chunk_type, count(*) AS n, min(chunk_idx) AS first_chunk, max(importance) AS top_importance FROM {chunks} GROUP BY framework, chunk_type HAVING count(*) > 1",
)

_shared(
    "component_limits",
    "Result limit and time limit of each question's component by its output and kind.",
    """WITH c AS (SELECT conv_id, turn, length(text) % 6 AS o, (length(text) + turn) % 6 AS k, 1 + length(text) % 10 AS priority FROM {conversations} WHERE role = 'user'),
b AS (SELECT *, CASE o WHEN 0 THEN 20 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 15 END AS base, CASE k WHEN 0 THEN 10000 WHEN 1 THEN 15000 WHEN 2 THEN 20000 WHEN 3 THEN 25000 WHEN 4 THEN 8000 ELSE 12000 END AS wait FROM c)
SELECT conv_id, turn, CAST(CASE WHEN priority >= 8 THEN ceil(base * 1.5e0) WHEN priority <= 3 THEN ceil(base * 0.7e0) ELSE base END AS BIGINT) AS max_results, CAST(CASE o WHEN 4 THEN wait * 2e0 WHEN 2 THEN wait * 1.5e0 ELSE wait END AS BIGINT) AS timeout_ms,
CASE WHEN priority <= 3 THEN 5 WHEN priority <= 6 THEN 10 WHEN priority <= 8 THEN 15 ELSE 20 END AS max_chunks FROM b""",
)

_shared(
    "key_components",
    "The 20 most important chunks above .5.",
    "SELECT id, importance, r FROM (SELECT id, importance, row_number() OVER (ORDER BY importance DESC, chunk_idx) AS r FROM {chunks} WHERE importance > 0.5e0) WHERE r <= 20",
)

_shared(
    "recent_updates",
    "The 20 latest chunks.",
    "SELECT id, CAST(modified AS STRING) AS modified, r FROM (SELECT id, modified, row_number() OVER (ORDER BY modified DESC, chunk_idx) AS r FROM {chunks}) WHERE r <= 20",
)

_shared(
    "prioritised_issues",
    "Issues of documents by severity, the most severe first, numbered in each source.",
    """WITH i AS (SELECT doc_id, source, CASE WHEN text IS NULL OR length(text) = 0 THEN 'critical' WHEN length(text) > 10000 THEN 'high' WHEN length(text) < 40 THEN 'medium' ELSE 'low' END AS severity FROM {documents})
SELECT doc_id, severity, row_number() OVER (PARTITION BY source ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, doc_id) AS place FROM i WHERE severity <> 'low'""",
)

_shared(
    "model_choice",
    "The model with the best weighted cost, speed and quality; event types stand for models, their values for costs.",
    """WITH m AS (SELECT event_type AS model, round(avg(value), 6) AS cost, count(*) AS requests FROM {events} GROUP BY event_type),
s AS (SELECT model, 3 * (1 / (cost + 1)) + 2 * (requests / 1000e0) + 1 * CASE WHEN cost > 50 THEN 3 WHEN cost > 10 THEN 2 ELSE 1 END AS score FROM m)
SELECT model, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, model) = 1 AS is_chosen FROM s""",
)

_shared(
    "set_operations",
    "Chunks that pass both of two filters, and those that pass the first only.",
    """SELECT id, 'both' AS found FROM (SELECT id FROM {chunks} WHERE language = 'en' INTERSECT SELECT id FROM {chunks} WHERE complexity > 5)
UNION ALL SELECT id, 'first' FROM (SELECT id FROM {chunks} WHERE language = 'en' EXCEPT SELECT id FROM {chunks} WHERE complexity > 5)""",
)

_shared(
    "override_merge",
    "Settings of each framework, where a custom one replaces the base.",
    """WITH base AS (SELECT framework, max(complexity) AS setting FROM {chunks} WHERE framework IS NOT NULL GROUP BY framework), custom AS (SELECT framework, min(complexity) AS setting FROM {chunks} WHERE framework IS NOT NULL AND importance > 0.9e0 GROUP BY framework)
SELECT coalesce(c.framework, b.framework) AS framework, coalesce(c.setting, b.setting) AS setting, c.framework IS NOT NULL AS is_custom FROM base b FULL JOIN custom c ON b.framework = c.framework""",
)

_shared(
    "merged_steps",
    "Steps of a conversation that may run side by side (same turn parity) merged: longest duration, all inputs.",
    """SELECT conv_id, turn % 2 AS lane, count(*) AS n_steps, max(length(text)) AS duration, count(DISTINCT role) AS n_inputs, min(turn) AS starts_at FROM {conversations} GROUP BY conv_id, turn % 2""",
)

_shared(
    "personalised_ranking",
    "The ten best chunks of each of a set of users (ids divisible by 20): importance and what their clicks prefer.",
    """WITH u AS (SELECT user_id, concat('src', CAST(event_id % 5 AS STRING)) AS framework, least(1e0, 0.5e0 + 0.1e0 * count(*)) AS preference FROM {events} WHERE user_id % 20 = 0 AND event_type IN ('click', 'purchase') GROUP BY user_id, concat('src', CAST(event_id % 5 AS STRING))),
s AS (SELECT user_id, chunk_idx, id, round(importance + preference * 0.1e0 + (1 - abs((complexity - 5) / 5e0)) * 0.05e0, 6) AS score FROM {chunks} JOIN u USING (framework))
SELECT user_id, id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, chunk_idx) AS r FROM s) WHERE r <= 10""",
    # users of one framework and one preference, of which there are few, have the same ten best chunks in it
    """WITH u AS (SELECT user_id, concat('src', CAST(event_id % 5 AS STRING)) AS framework, least(1e0, 0.5e0 + 0.1e0 * count(*)) AS preference FROM {events} WHERE user_id % 20 = 0 AND event_type IN ('click', 'purchase') GROUP BY user_id, concat('src', CAST(event_id % 5 AS STRING))),
p AS (SELECT DISTINCT framework, preference FROM u),
s AS (SELECT framework, preference, chunk_idx, id, round(importance + preference * 0.1e0 + (1 - abs((complexity - 5) / 5e0)) * 0.05e0, 6) AS score FROM {chunks} JOIN p USING (framework)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY framework, preference ORDER BY score DESC, chunk_idx) AS place FROM s) WHERE place <= 10)
SELECT user_id, id, score, r FROM (SELECT user_id, id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, chunk_idx) AS r FROM u JOIN t USING (framework, preference)) WHERE r <= 10""",
)

_shared(
    "class_edges",
    "Edges from every class to known classes that it extends or implements or that its file imports.",
    """WITH h AS (SELECT file_id, content, EACH(regexp_extract_all(content, '(class [A-Za-z0-9_]+[^:;(){{}}]*)', 1)) AS head FROM {files}),
c AS (SELECT file_id, content, head, regexp_extract(head, 'class ([A-Za-z0-9_]+)', 1) AS name FROM h),
t AS (SELECT file_id, name, 'extends' AS kind, regexp_extract(head, 'extends ([A-Za-z0-9_]+)', 1) AS target, 0.9e0 AS weight FROM c
UNION SELECT file_id, name, 'implements', EACH(regexp_extract_all(regexp_extract(head, 'implements ([A-Za-z0-9_, ]+)', 1), '([A-Za-z0-9_]+)', 1)), 0.8e0 FROM c
UNION SELECT file_id, name, 'imports', EACH(regexp_extract_all(content, 'from ''[.]/([A-Za-z0-9_]+)', 1)), 0.5e0 FROM c),
known AS (SELECT name, min(file_id) AS target_file FROM c GROUP BY name)
SELECT t.file_id, t.name, t.kind, t.target, known.target_file, t.weight FROM t JOIN known ON known.name = t.target""",
)

_shared(
    "navigation_targets",
    "Where each class and file name leads: the last one that has the name, and the first for lookups by name.",
    """WITH k AS (SELECT file_id, EACH(regexp_extract_all(content, 'class ([A-Za-z0-9_]+)', 1)) AS name FROM {files} UNION ALL SELECT file_id, file_path FROM {files})
SELECT name, max(file_id) AS last_file, min(file_id) AS first_file, count(*) AS n FROM k GROUP BY name""",
)

_shared(
    "applicable_tools",
    "Analysis tools that apply to each file by extension and framework.",
    """SELECT file_id, tool, severity_scale FROM {files} JOIN (VALUES ('eslint', '.tsx', 'react', 2), ('checkstyle', '.java', 'java', 3), ('pmd', '.java', 'java', 5), ('sonar', '.java', '', 5), ('sonar', '.tsx', '', 5), ('pylint', '.py', '', 4), ('bandit', '.py', 'flask', 3)) AS t(tool, ext, needs, severity_scale)
ON regexp_extract(file_path, '([.][a-z]+)$', 1) = ext AND (needs = '' OR needs = kind)""",
)

_shared(
    "layer_clusters",
    "Files of each layer, feature folder and framework, with how many share all three.",
    """SELECT layer, feature, kind, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY layer) AS BIGINT) AS n_layer, CAST(sum(count(*)) OVER (PARTITION BY kind) AS BIGINT) AS n_framework FROM (
SELECT CASE WHEN contains(lower(file_path), 'controller') OR contains(lower(file_path), 'views') THEN 'presentation' WHEN contains(file_path, 'services') THEN 'business' WHEN contains(content, 'Repository') THEN 'data' ELSE 'other' END AS layer, split_part(file_path, '/', 2) AS feature, kind FROM {files}) GROUP BY layer, feature, kind""",
)

_shared(
    "json_export",
    "Events whose properties are written as JSON objects, and the longest text; json_properties reads them.",
    """SELECT event_type, count(*) AS n, count(CASE WHEN contains(props, '{{') THEN 1 END) AS n_json, max(length(props)) AS longest FROM {events} GROUP BY event_type""",
)

_shared(
    "graph_lookups",
    "Neighbours of each supplier's parts in both directions: what it supplies, who else supplies it.",
    """WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}), p AS (SELECT l_partkey, count(*) AS n_suppliers FROM e GROUP BY l_partkey)
SELECT l_suppkey, count(*) AS n_out, CAST(sum(n_suppliers - 1) AS BIGINT) AS n_shared, max(n_suppliers) AS most_shared FROM e JOIN p USING (l_partkey) GROUP BY l_suppkey""",
)

# ---------------------------------------------------------------- signals of single chunks
ACTIVE = ("src1", "src2")
TYPE, FRAMEWORK = col("chunk_type"), col("framework")


def _chunks(name: str, doc: str, columns: dict[str, X]) -> None:
    derived(name, doc, chunks, CHUNKS_SQL, "chunks", {"id": col("id"), **columns})


_present = lambda x: X(lambda: x.col.isNotNull(), f"({x.sql} IS NOT NULL)")
_chunks(
    "alignment_signals",
    "How a chunk fits the active frameworks, the question's component and scope, and how fresh and trusted it is.",
    {
        "framework_fit": first_of([(0.5, ~_present(FRAMEWORK)), (1.0, FRAMEWORK.contains(*ACTIVE))], 0.3),
        "type_fit": first_of([(1.0, TYPE == "class"), (0.8, TYPE.contains("function"))], 0.5),
        "file_scope": first_of([(1.0, TYPE.contains("file"))], 0.6),
        "class_scope": first_of([(1.0, TYPE.contains("class"))], 0.4),
        "function_scope": first_of([(1.0, TYPE.contains("function"))], 0.4),
        "query_fit": weighed(0, [(0.3, col("content").lower().contains("the system")), (0.1, col("content").lower().contains("class")), (0.1, col("content").lower().contains("data")), (0.2, col("content").lower().contains("function", "class"))], 1),
        "authority": rounded(col("importance") * 0.7 + first_of([(0.3, _present(col("component_type")))], 0.0)),
    },
)

_chunks(
    "relevance_explanations",
    "Why a chunk is shown and in which context.",
    {
        "reasons": labels([("matches query keywords in name", col("class_name").lower().contains("class1")), ("matches specified framework", FRAMEWORK.contains(*ACTIVE)), ("high importance component", col("importance") > 0.8), ("general content relevance", lit(True))]),
        "context": first_of([("direct", col("content").lower().contains("the system")), ("framework", FRAMEWORK.contains(*ACTIVE)), ("pattern", TYPE == "class")], "related"),
        "percent": rounded(col("importance") * 100, 1),
    },
)

#: Words that a question's action, noun and synonyms are told by (fixed values).
ACTIONS = "find|search|explain|analyze|show|get|locate|describe"
NOUNS = "class|function|method|component|service|controller|model|interface|api|database|table"
SYNONYMS = {
    "find": "search|locate|get|retrieve|discover|identify", "function": "method|procedure|routine|operation|behavior", "class": "object|type|entity|model|component", "database": "db|datastore|persistence|storage|repository",
    "user": "customer|client|person|account|profile", "create": "make|build|generate|add|construct|develop", "remove": "delete|destroy|eliminate|drop|purge", "update": "modify|change|edit|alter|revise",
    "analyze": "examine|review|assess|evaluate|inspect", "optimize": "improve|enhance|boost|accelerate|streamline", "error": "bug|issue|problem|exception|failure", "performance": "speed|efficiency|throughput|latency|optimization",
}
FRAMEWORK_TERMS = {"component": "react component", "hook": "react hook", "state": "react state", "props": "react props", "context": "react context", "reducer": "react reducer"}
ALTERNATIVES = {"find": ("search for", "locate", "identify"), "how": ("in what way", "by what means"), "show": ("display", "present", "demonstrate"), "explain": ("describe", "clarify", "detail"), "analyze": ("examine", "review", "assess")}


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", "lower(text) AS q")


def _replaced(x: X, word: str, by: str) -> X:
    from pyspark.sql import functions as F

    return X(lambda: F.regexp_replace(x.col, rf"\b{word}\b", by), f"regexp_replace({x.sql}, {code.quoted(chr(92) + 'b' + word + chr(92) + 'b')}, {code.quoted(by)}, 'g')")


Q = col("q")
_rewritten = Q
for _term, _by in FRAMEWORK_TERMS.items():
    _rewritten = _replaced(_rewritten, _term, _by)
derived(
    "question_expansions",
    "Subject, synonyms, rewrites with a framework's terms and first alternative of each question.",
    _questions,
    "qs AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user')",
    "qs",
    {
        "conv_id": col("conv_id"),
        "turn": col("turn"),
        "subject": Q.first(rf"(?:^|\s)(?:{ACTIONS})\s+(\S+(?:\s+\S+){{0,2}})", 1),
        "noun": Q.first(rf"\b(?:{NOUNS})\b", 0),
        "synonyms": labels([(v, Q.rlike(rf"(?:^|\s){k}(?:\s|$)")) for k, v in SYNONYMS.items()]),
        "with_framework": _rewritten,
        "alternative": first_of([(_replaced(Q, k, v[0]), Q.contains(k)) for k, v in ALTERNATIVES.items()], Q),
    },
)

OVERVIEW_WORDS = ("overview", "explain the code", "entire source", "whole project", "codebase", "architecture", "structure", "how does this work", "what does this do", "general explanation", "summary")
ARCHITECTURE_WORDS = ("architecture", "design pattern", "component", "service", "module", "dependency", "relationship", "flow", "structure")
OVERVIEW_PHRASES = ("give overview", "explain the code", "how does this work", "what does this project do", "describe the codebase", "structure of the code", "architecture overview")
ENDPOINT_PHRASES = (
    "all endpoints", "list endpoints", "show endpoints", "api endpoints", "all routes", "list routes", "show routes", "available apis", "rest endpoints", "http endpoints", "web apis", "api documentation",
    "endpoints available", "what apis", "available endpoints", "show me apis", "list apis", "get endpoints",
)
FILE_TYPES = {
    "java": r"\.java|java\s*file", "javascript": r"\.js|javascript", "typescript": r"\.ts|typescript", "python": r"\.py|python", "html": r"\.html|html", "css": r"\.css|css", "json": r"\.json|json", "xml": r"\.xml|xml",
    "yaml": r"\.ya?ml|yaml",
}
COMPONENTS = {
    "controller": "controller", "service": "service", "repository": "repository", "entity": "entity|model", "component": "component", "middleware": "middleware", "router": "router|route", "config": "config|configuration",
}
LEVELS = {
    "advanced": ("architecture", "design pattern", "optimization", "performance", "security", "scalability"), "complex": ("integration", "workflow", "pipeline", "relationship", "dependency"),
    "moderate": ("implement", "create", "build", "configure", "setup"), "simple": ("find", "show", "list", "what", "where"),
}
_is_overview, _is_architecture = Q.contains(*OVERVIEW_WORDS), Q.contains(*ARCHITECTURE_WORDS)
_whole = Q.contains("entire", "whole", "all", "codebase")
_level = first_of([(k, Q.contains(*v)) for k, v in LEVELS.items()], "moderate")
_kind = first_of([("overview", _is_overview), ("architectural", _is_architecture)], "specific")
derived(
    "question_classes",
    "Kind, scope, complexity, file types and components of a question, what it calls for, and how sure an answer is.",
    _questions,
    "qs AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user')",
    "qs",
    {
        "conv_id": col("conv_id"),
        "turn": col("turn"),
        "kind": _kind,
        "answer_scope": first_of([("codebase", _whole)], "component"),
        "search_scope": first_of([("project", Q.contains("project", "entire", "all")), ("module", Q.contains("module", "package")), ("component", Q.contains("component", "class")), ("file", Q.contains("file"))], "module"),
        "level": _level,
        "file_types": labels([(k, Q.rlike(p)) for k, p in FILE_TYPES.items()]),
        "components": labels([(k, Q.rlike(p)) for k, p in COMPONENTS.items()]),
        "needs_overview": _is_overview | _is_architecture | _whole | Q.contains(*OVERVIEW_PHRASES),
        "needs_endpoints": Q.contains(*ENDPOINT_PHRASES),
        "confidence": weighed(0.5, [(0.3, _kind == "overview"), (0.4, Q.contains(*ENDPOINT_PHRASES)), (0.1, _level == "simple")], 1),
        "max_chunks": first_of([(5, _level == "simple"), (10, _level == "moderate"), (15, _level == "complex")], 20),
    },
)

_shared(
    "architecture_patterns",
    "Architectural patterns of each kind of file: confidence from how many of their parts exist, and whether it reaches the threshold.",
    """WITH p AS (SELECT kind, max(CASE WHEN contains(content, 'Controller') THEN 1 ELSE 0 END) AS c, max(CASE WHEN contains(content, 'Model') OR contains(content, 'model') THEN 1 ELSE 0 END) AS m, max(CASE WHEN contains(content, 'View') OR contains(content, 'views') THEN 1 ELSE 0 END) AS v,
max(CASE WHEN contains(content, 'Service') THEN 1 ELSE 0 END) AS s, max(CASE WHEN contains(content, 'Repository') THEN 1 ELSE 0 END) AS r FROM {files} GROUP BY kind),
u AS (SELECT kind, 'MVC' AS pattern, round((c + m + v) / 3e0, 6) AS confidence, 0.6e0 AS threshold FROM p UNION ALL SELECT kind, 'layered', round((c + s + r) / 3e0, 6), 0.6e0 FROM p UNION ALL SELECT kind, 'repository', CAST(r AS DOUBLE), 0.7e0 FROM p)
SELECT kind, pattern, confidence, confidence >= threshold AS is_shown FROM u""",
)

_shared(
    "spring_layers",
    "All controllers, services and repositories named in Java files, with the files of each layer.",
    """SELECT layer, count(DISTINCT file_id) AS n_files, min(file_id) AS first_file, count(DISTINCT name) AS n_names, count(*) AS n FROM (
SELECT file_id, 'controller' AS layer, EACH(regexp_extract_all(content, 'class ([A-Za-z0-9_]+Controller)', 1)) AS name FROM {files} WHERE kind = 'java' UNION ALL
SELECT file_id, 'service', EACH(regexp_extract_all(content, 'private ([A-Za-z0-9_]+Service)', 1)) FROM {files} WHERE kind = 'java' UNION ALL SELECT file_id, 'repository', EACH(regexp_extract_all(content, 'private ([A-Za-z0-9_]+Repository)', 1)) FROM {files} WHERE kind = 'java') GROUP BY layer""",
)

_shared(
    "service_calls",
    "Which files call a route that another file exposes: equal first segments of the consumer's import and the provider's route, first provider.",
    """WITH provider AS (SELECT regexp_extract(content, '@app.route[(]"/([a-z]+)/', 1) AS segment, min(file_id) AS provided_by FROM {files} WHERE kind = 'flask' GROUP BY regexp_extract(content, '@app.route[(]"/([a-z]+)/', 1)),
consumer AS (SELECT file_id, regexp_extract(content, '@([a-z]+)/', 1) AS segment FROM {files} WHERE kind = 'react')
SELECT file_id, provided_by, segment, 'http' AS protocol FROM consumer JOIN provider USING (segment) WHERE segment <> ''""",
)

_shared(
    "endpoint_groups",
    "All endpoints of Java and Flask files in order within their base path, with the document beside them.",
    """WITH e AS (SELECT file_id, 'GET' AS method, EACH(regexp_extract_all(content, '@GetMapping[(]"([^"]+)"', 1)) AS path FROM {files} WHERE kind = 'java' UNION ALL SELECT file_id, 'POST', EACH(regexp_extract_all(content, '@PostMapping[(]"([^"]+)"', 1)) FROM {files} WHERE kind = 'java'
UNION ALL SELECT file_id, 'ANY', EACH(regexp_extract_all(content, '@app.route[(]"([^"]+)"', 1)) FROM {files} WHERE kind = 'flask' UNION ALL SELECT file_id, 'GET', EACH(regexp_extract_all(content, '@app.get[(]"([^"]+)"', 1)) FROM {files} WHERE kind = 'flask')
SELECT e.file_id, method, path, lang, source, row_number() OVER (PARTITION BY regexp_extract(path, '^/([^/]*)', 1) ORDER BY path, method, e.file_id) AS place FROM e LEFT JOIN {documents} d ON d.doc_id = e.file_id""",
)
