"""Structured texts: JSON of any depth as rows, and configuration or documents with their structure marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import Rounds

#: Kinds of values that have values inside.
_NESTED = ("OBJECT", "ARRAY")
#: Levels that are opened before values are written.
LEVELS = 6


def _kind(name: Column) -> Column:
    """OBJECT, ARRAY, or the type of a plain value, of a variant's schema; NULL for JSON's null."""
    return F.when(name.startswith("OBJECT"), "OBJECT").when(name.startswith("ARRAY"), "ARRAY").when(name == "VOID", "NULL").when(name.isin("BIGINT", "DOUBLE") | name.startswith("DECIMAL"), "NUMBER").otherwise(name)


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value) of every plain value of a JSON text, whatever its depth.

    Paths are ``$``, then ``.name`` for a field (``."name"`` where it is no plain
    word) and ``[i]`` for an element.  ``kind`` is STRING, NUMBER, BOOLEAN or
    NULL (its value is null); EMPTY for an object or array without values; and
    INVALID, at ``$``, for a text that is no JSON or names a field twice.  A null
    text has no row.  Values are opened ``LEVELS`` levels at a time, all texts at
    once, until none has a value inside; a plain value goes through the levels
    below it as it is, and kinds are told only once, of what the last one leaves.
    """
    rounds = Rounds(df.sparkSession)
    parsed = df.where(F.col(text).isNotNull()).select(key, F.lit("$").alias("path"), F.try_parse_json(text).alias("v"))
    level, out, n = parsed, None, 0
    while True:
        for _ in range(LEVELS):
            inner = df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select("pos", F.col("key").alias("name"), F.col("value").alias("inner"))
            step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("name").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit('."'), "name", F.lit('"')))
            end = F.col("pos").isNull()
            level = level.lateralJoin(inner).select(key, F.when(end, F.col("path")).otherwise(F.concat("path", step)).alias("path"), F.when(end, F.col("v")).otherwise(F.col("inner")).alias("v"), end.alias("ended"))
        kind = F.coalesce(_kind(F.col("schema")), F.lit("INVALID"))
        nested = F.col("kind").isin(*_NESTED)
        told = level.withColumn("schema", F.schema_of_variant("v")).withColumn("kind", kind).withColumn("open", nested & ~F.col("ended"))
        value = F.when(~nested & ~F.col("kind").isin("NULL", "INVALID"), F.variant_get("v", "$", "string"))
        found = rounds.keep(f"found-{n}", told.select(key, "path", F.when(nested, "EMPTY").otherwise(F.col("kind")).alias("kind"), value.alias("value"), F.when(F.col("open"), F.col("v")).alias("v"), "open"))
        part = found.where("NOT open").select(key, "path", "kind", "value")
        out = part if out is None else out.unionByName(part)
        level = found.where("open").select(key, "path", "v")
        n += 1
        if level.isEmpty():
            break
    rounds.close(*(f"found-{i}" for i in range(n)))
    return out


def canonical_json(text: Column) -> Column:
    """The text with fields in order and no white space; a text that is no JSON stays."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def marked_yaml(text: Column) -> Column:
    """Lines that open a section, which end with a colon and are no comment, are marked."""
    return F.regexp_replace(text, r"(?m)^((?![ \t]*#).*\S?:)[ \t]*$", "$1 # Configuration section")


def grouped_properties(text: Column) -> Column:
    """Properties by what stands before their first dot, groups in order of their first line, each under a heading; comments and blank lines go."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("#"))
    prefix = lambda x: F.substring_index(x, ".", 1)
    groups = F.array_distinct(F.transform(lines, prefix))
    block = lambda g: F.concat(F.lit("# "), F.upper(g), F.lit(" Configuration\n"), F.array_join(F.filter(lines, lambda x: prefix(x) == g), "\n"), F.lit("\n\n"))
    return F.array_join(F.transform(groups, block), "")


def marked_xml(text: Column) -> Column:
    """Every opening element is marked; comments, declarations and closing elements are not."""
    return F.regexp_replace(text, r"(<[A-Za-z_][^>]*>)", "$1 <!-- Configuration element -->")


def marked_html(text: Column) -> Column:
    """Headings and sections stand on lines of their own and are marked."""
    return F.regexp_replace(text, r"(?i)(<(?:h[1-6]|div|section|article|nav|header|footer)\b[^>]*>)", "\n$1 <!-- Template section -->\n")


def marked_markdown(text: Column) -> Column:
    """Each header line is followed by a line that names its section."""
    return F.regexp_replace(text, r"(?m)^(#{1,6})[ \t]+(\S.*)$", "$1 $2\n<!-- Section: $2 -->\n")


def structured(text: Column, extension: Column) -> Column:
    """The text with the structure of its kind of file marked; other kinds stay."""
    kinds = [(("json",), canonical_json), (("yml", "yaml"), marked_yaml), (("properties",), grouped_properties), (("xml",), marked_xml), (("html", "htm"), marked_html), (("md",), marked_markdown)]
    out = text
    for names, mark in kinds:
        out = F.when(extension.isin(*names), mark(text)).otherwise(out)
    return out
