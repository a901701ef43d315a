"""Classification of files, endpoints and services by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Framework, pattern, group of the verb (0: ``verb``), group of the path, verb (fixed values).
ROUTES = [
    ("express", r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]", 1, 2, None),
    ("fastapi", r"@(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]", 1, 2, None),
    ("flask", r"@\w+\.route\(\s*['\"]([^'\"]+)['\"](?:,\s*methods=\[['\"](\w+)['\"]\])?", 2, 1, "GET"),
    ("spring-boot", r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*\"([^\"]+)\"", 1, 2, None),
    ("gin", r"\b\w+\.(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)\"", 1, 2, None),
]


def normal_path(path: Column) -> Column:
    """``<int:id>`` and ``{id}`` as ``:id``, anchors dropped, one leading slash."""
    plain = F.regexp_replace(F.regexp_replace(path, r"<(?:\w+:)?(\w+)>", ":$1"), r"\{(\w+)\}", ":$1")
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(plain, r"[\^$]", ""), r"^/+", ""))


def endpoints(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, framework, method, path) of all routes that the patterns find; ``@`` routes are not Express."""
    source = F.col(text)
    parts = []
    for framework, pattern, verb, path, default in ROUTES:
        guarded = (r"(?<!@)" if framework == "express" else "") + pattern
        verbs, paths = F.regexp_extract_all(source, F.lit(guarded), F.lit(verb)), F.regexp_extract_all(source, F.lit(guarded), F.lit(path))
        parts.append(F.transform(F.arrays_zip(verbs.alias("v"), paths.alias("p")), _row(framework, default)))
    return files.select(key, F.inline(F.concat(*parts)))


def _row(framework: str, default: str | None):
    def build(x: Column) -> Column:
        verb = F.upper(x["v"])
        if default:
            verb = F.when(F.coalesce(F.length(verb), F.lit(0)) > 0, verb).otherwise(default)
        return F.struct(F.lit(framework).alias("framework"), verb.alias("method"), normal_path(x["p"]).alias("path"))

    return build


#: Secondary class of a file by its path, first match wins (fixed values).
FILE_CLASSES = [
    ("test", r"(^|/)tests?/|[._-](test|spec)\.|Test\.java$"),
    ("configuration", r"\.(json|ya?ml|toml|ini|properties|xml)$"),
    ("documentation", r"\.(md|rst|txt|adoc)$"),
    ("template", r"\.(html|vue|svelte|hbs)$"),
    ("style", r"\.(css|scss|less)$"),
    ("source_code", r"\.(py|js|jsx|ts|tsx|java|go|rb|rs|php|cs|c|cpp)$"),
]


def file_class(path: Column) -> Column:
    out = None
    for label, pattern in FILE_CLASSES:
        out = F.when(path.rlike(pattern), label) if out is None else out.when(path.rlike(pattern), label)
    return out.otherwise("other")
