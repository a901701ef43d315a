"""Readers and parsers of text sources: file trees, ignore lists, commit logs, manifests, tool reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex

#: Folders that scans skip (fixed values).
IGNORED = ["node_modules", ".git", "dist", "build", "out", "target", "__pycache__", ".venv", "vendor"]
#: Extensions of text files (fixed values).
TEXT_EXTENSIONS = "py js jsx ts tsx java vue svelte go rs rb php cs c cpp h hpp html css scss json yml yaml xml md txt sql sh properties toml gradle kt swift".split()


def text_files(spark: SparkSession, folder: str, ignore: list[str] | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, name, size, modified, content) of the text files under a folder; ignored, large and binary ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    skipped = "|".join(f"/{n.replace('.', chr(92) + '.')}/" for n in IGNORED)
    patterns = [F.col("path").rlike(glob_to_regex("**/" + p.strip("/"))) for p in ignore or []]
    keep = (F.col("length") <= most_bytes) & ~F.col("path").rlike(skipped) & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(TEXT_EXTENSIONS)
    for p in patterns:
        keep = keep & ~p
    return files.where(keep).select(path.alias("path"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Lines of an ignore file without blanks and comments; the file is one small file."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    return [r["v"] for r in lines.collect()]


def parse_log(log: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(commits, files) of records ``hash|author|date|message`` followed by lines of additions, deletions and path; ``-`` counts as 0."""
    lines = F.split(text, "\n")
    head = F.split(lines[0], r"\|", 4)
    commits = log.select(head[0].alias("hash"), head[1].alias("author"), F.to_timestamp(head[2]).alias("date"), head[3].alias("message"))
    rows = log.select(head[0].alias("hash"), F.explode(F.slice(lines, 2, 1 << 30)).alias("line")).where(F.col("line") != "")
    p = F.split("line", "\t")
    number = lambda c: F.coalesce(F.try_to_number(c, F.lit("999999999")).cast("long"), F.lit(0)).cast("long")
    files = rows.where(F.size(p) >= 3).select("hash", number(p[0]).alias("additions"), number(p[1]).alias("deletions"), p[2].alias("path"))
    return commits, files


def manifest_dependencies(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(path, kind, dependency, version) of package.json, requirements.txt and pom.xml files."""
    package = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    pairs = "array<struct<dependency:string,version:string>>"
    entries = lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("dependency"), e["value"].alias("version")))
    js = F.concat(entries(package["dependencies"]), entries(package["devDependencies"]))
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    py = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_.\-]+)", 1).alias("dependency"), F.nullif(F.regexp_extract(x, r"[=<>~!]=\s*([^\s,;]+)", 1), F.lit("")).alias("version")))
    artifact = F.regexp_extract_all(content, F.lit(r"(?s)<dependency>.*?<artifactId>([^<]+)</artifactId>.*?</dependency>"), F.lit(1))
    java = F.transform(artifact, lambda x: F.struct(x.alias("dependency"), F.lit(None).cast("string").alias("version")))
    kind = F.when(F.col(name) == "package.json", "npm").when(F.col(name) == "requirements.txt", "pip").when(F.col(name) == "pom.xml", "maven")
    found = F.when(F.col(name) == "package.json", js.cast(pairs)).when(F.col(name) == "requirements.txt", py.cast(pairs)).when(F.col(name) == "pom.xml", java.cast(pairs))
    return files.select("path", kind.alias("kind"), F.inline(found))


#: Severity of a tool's own words (fixed values).
SEVERITIES = {"blocker": "critical", "critical": "critical", "error": "high", "major": "high", "high": "high", "warning": "medium", "minor": "low", "medium": "medium", "info": "info", "low": "low", "convention": "low", "2": "high", "1": "medium"}


def severity(word: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, F.lower(word)), F.lit("medium"))


def tool_issues(reports: DataFrame, text: str = "stdout") -> DataFrame:
    """(tool, file, line, rule, severity, message) of JSON reports of eslint, bandit and pylint; malformed reports give no rows."""
    issue = "struct<file:string,line:int,rule:string,severity:string,message:string>"
    es = F.from_json(text, "array<struct<filePath:string,messages:array<struct<line:int,ruleId:string,severity:string,message:string>>>>")
    es = F.flatten(F.transform(es, lambda f: F.transform(f["messages"], lambda m: F.struct(f["filePath"].alias("file"), m["line"].alias("line"), m["ruleId"].alias("rule"), m["severity"].alias("severity"), m["message"].alias("message")))))
    ba = F.from_json(text, "results array<struct<filename:string,line_number:int,test_id:string,issue_severity:string,issue_text:string>>")["results"]
    ba = F.transform(ba, lambda m: F.struct(m["filename"].alias("file"), m["line_number"].alias("line"), m["test_id"].alias("rule"), m["issue_severity"].alias("severity"), m["issue_text"].alias("message")))
    py = F.from_json(text, 'array<struct<path:string,line:int,symbol:string,type:string,message:string>>')
    py = F.transform(py, lambda m: F.struct(m["path"].alias("file"), m["line"].alias("line"), m["symbol"].alias("rule"), m["type"].alias("severity"), m["message"].alias("message")))
    kind = f"array<{issue}>"
    found = F.when(F.col("tool") == "eslint", es.cast(kind)).when(F.col("tool") == "bandit", ba.cast(kind)).when(F.col("tool") == "pylint", py.cast(kind))
    return reports.select("tool", F.inline(found)).select("tool", "file", "line", "rule", severity(F.col("severity")).alias("severity"), "message")


def openapi(endpoints: list[dict]) -> str:
    """An OpenAPI text of a few endpoints (method, path)."""
    paths: dict = {}
    for e in endpoints:
        name = "/".join("{" + p[1:] + "}" if p.startswith(":") else p for p in e["path"].split("/"))
        paths.setdefault(name, {})[e["method"].lower()] = {"responses": {"200": {"description": "OK"}}}
    return json.dumps({"openapi": "3.0.0", "info": {"title": "API", "version": "1.0.0"}, "paths": paths}, sort_keys=True)
