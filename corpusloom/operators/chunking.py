"""Row generators that cut files and documents into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_windows(df: DataFrame, key: str, text: str, lines: int = 50) -> DataFrame:
    """(key, start_line, end_line, content) for each ``lines`` lines."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    g = rows.groupBy(key, F.floor(F.col("pos") / lines).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return g.select(key, (F.col("l")[0]["pos"] + 1).cast("long").alias("start_line"), (F.element_at("l", -1)["pos"] + 1).cast("long").alias("end_line"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def packed_lines(text: Column, most: int) -> Column:
    """Greedy packing: lines are gathered until the next would exceed ``most`` characters; array<string>."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc, line):
        full = F.concat(acc["open"], F.lit("\n"), line)
        keep = acc["open"].isNull()
        flush = ~keep & (F.length(full) > most)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(keep | flush, line).otherwise(full).alias("open"),
        )

    return F.aggregate(F.split(text, "\n"), zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def sections(df: DataFrame, key: str, text: str, header: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """(key, section, level, title, content) of a text with header lines; text before the first header is left out."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.col("line").rlike(header)
    rows = rows.withColumn("header", is_header).withColumn("section", F.sum(is_header.cast("int")).over(order)).where("section > 0")
    g = rows.groupBy(key, "section").agg(F.max(F.when(F.col("header"), F.col("line"))).alias("head"), F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("pos", "line")))).alias("l"))
    return g.select(key, "section", F.length(F.regexp_extract("head", header, 1)).alias("level"), F.regexp_extract("head", header, 2).alias("title"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def with_context(chunks: DataFrame, group: str, order: str, content: str, overlap: int = 50) -> DataFrame:
    """Adds context: the last ``overlap`` characters of the chunk before, empty for the first."""
    before = F.lag(content).over(Window.partitionBy(group).orderBy(order))
    return chunks.withColumn("context", F.coalesce(F.right(before, F.lit(overlap)), F.lit("")))


# Blocks of code: balanced braces and indentation are no regular languages, so
# they are cut by pandas UDFs over whole files.

_DECLARATIONS = {
    "javascript": [("class", re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)")), ("interface", re.compile(r"\binterface\s+([A-Za-z_$][\w$]*)")), ("function", re.compile(r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(")), ("function", re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"))],
    "java": [("class", re.compile(r"\bclass\s+(\w+)")), ("interface", re.compile(r"\binterface\s+(\w+)")), ("enum", re.compile(r"\benum\s+(\w+)")), ("function", re.compile(r"\b(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\], ]+\s+(\w+)\s*\([^)]*\)\s*(?:throws [\w, ]+)?\{"))],
    "python": [("class", re.compile(r"^[ \t]*class\s+(\w+)", re.M)), ("function", re.compile(r"^[ \t]*(?:async\s+)?def\s+(\w+)", re.M))],
}


def brace_block(text: str, start: int, fallback: int = 1000) -> str:
    """From ``start`` to the brace that closes the first one; a fixed length if it never closes."""
    depth = 0
    for i in range(start, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth <= 0:
                return text[start : i + 1]
    return text[start : start + fallback]


def indent_block(text: str, start: int) -> str:
    """A header line and the deeper or blank lines that follow."""
    begin = text.rfind("\n", 0, start) + 1
    lines = text[begin:].split("\n")
    width = len(lines[0]) - len(lines[0].lstrip())
    out = [lines[0]]
    for line in lines[1:]:
        if line.strip() and len(line) - len(line.lstrip()) <= width:
            break
        out.append(line)
    while len(out) > 1 and not out[-1].strip():
        out.pop()
    return "\n".join(out)


def code_blocks(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, kind, name, start_line, end_line, content, complexity) of declarations in python, java and javascript files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, lang in zip(pdf[key], pdf[text], pdf[language], strict=True):
                t = t or ""
                kind_of = {"typescript": "javascript", "vue": "javascript", "svelte": "javascript"}.get(lang, lang)
                for kind, pattern in _DECLARATIONS.get(kind_of, []):
                    for m in pattern.finditer(t):
                        block = indent_block(t, m.start(1)) if kind_of == "python" else brace_block(t, m.start())
                        first = 1 + t.count("\n", 0, m.start(1))
                        branches = len(re.findall(r"\b(?:if|elif|for|while|case|catch|except)\b|&&|\|\|", block))
                        out.append((k, kind, m[1], first, first + block.count("\n"), block, 1 + branches))
            yield pd.DataFrame(out, columns=[key, "kind", "name", "start_line", "end_line", "content", "complexity"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text, language).mapInPandas(run, f"`{key}` {kind}, kind string, name string, start_line int, end_line int, content string, complexity int")


#: Tags of the sections of a page.
SECTION_TAGS = ["header", "nav", "main", "section", "article", "aside", "footer"]


def tag_sections(html: Column, tags: list[str] = SECTION_TAGS) -> Column:
    """array<struct<tag, content>>: all sections in their order, from a tag to the next that closes it; empty ones are left out.

    A section within another is part of the outer one.  A page without such tags
    is split at blank lines into parts section_0, section_1, ...
    """
    pattern = F.lit(rf"(?is)<({'|'.join(tags)})\b[^>]*>(.*?)</\1>")
    names, contents = F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2))
    found = F.zip_with(names, contents, lambda t, c: F.struct(F.lower(t).alias("tag"), c.alias("content")))
    parts = F.transform(F.split(html, r"\n\s*\n"), lambda c, i: F.struct(F.concat(F.lit("section_"), i.cast("string")).alias("tag"), c.alias("content")))
    return F.when(F.size(names) > 0, F.filter(found, lambda x: F.length(x["content"]) > 0)).otherwise(F.filter(parts, lambda x: x["content"].rlike(r"\S")))


def placed(content: Column, matches: Column) -> Column:
    """array<struct<text, line>> of matches in their order: each is looked for behind the one before, lines count from 1."""
    zero = F.struct(F.array().cast("array<struct<text:string,line:int>>").alias("done"), F.lit(1).alias("at"))

    def step(acc, m):
        at = F.call_function("locate", m, content, acc["at"])
        before = F.left(content, at - 1)
        line = (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")
        return F.struct(F.concat(acc["done"], F.array(F.struct(m.alias("text"), line.alias("line")))).alias("done"), (at + F.length(m)).alias("at"))

    return F.aggregate(matches, zero, step, lambda acc: acc["done"])


#: Sections of single-file components: what marks them, and their importance (fixed values).
COMPONENT_SECTIONS = [("template", r"(?is)<template\b[^>]*>.*</template>", 0.8), ("script", r"(?is)<script\b[^>]*>.*?</script>", 0.9), ("style", r"(?is)<style\b[^>]*>.*?</style>", 0.5)]


def component_sections(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, section, language, content, start_line, end_line, importance) of every section of Vue and Svelte components.

    A template runs from the first to the last of its tags, so that templates
    within it are part of it.  A component without one, but with a script or a
    style, has as its template what is left beside these, if that is not blank;
    its lines are null.  ``language`` is the section's lang, else that of its kind.
    """
    text = F.col(content)
    found = []
    for name, pattern, importance in COMPONENT_SECTIONS:
        rows = placed(text, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        default = {"template": "html", "script": "javascript", "style": "css"}[name]

        def section(x):
            tag = F.regexp_extract(x["text"], r"(?s)^<[^>]*>", 0)
            inner = F.regexp_replace(F.regexp_replace(x["text"], r"(?s)^<[^>]*>", ""), rf"(?is)</{name}>$", "")
            lang = F.coalesce(F.nullif(F.regexp_extract(tag, r"\blang\s*=\s*['\"]?(\w+)", 1), F.lit("")), F.lit(default))
            lines = F.length(x["text"]) - F.length(F.replace(x["text"], F.lit("\n"), F.lit("")))
            return F.struct(F.lit(name).alias("section"), lang.alias("language"), inner.alias("content"), x["line"].alias("start_line"), (x["line"] + lines).cast("int").alias("end_line"), F.lit(importance).alias("importance"))

        found.append(F.transform(rows, section))
    rest = text
    for _, pattern, _ in COMPONENT_SECTIONS[1:]:
        rest = F.regexp_replace(rest, pattern, "")
    none = F.lit(None).cast("int")
    other = F.struct(F.lit("template").alias("section"), F.lit("html").alias("language"), F.trim(rest).alias("content"), none.alias("start_line"), none.alias("end_line"), F.lit(COMPONENT_SECTIONS[0][2]).alias("importance"))
    parts = F.concat(*found)
    whole = F.when((F.size(found[0]) == 0) & (F.size(parts) > 0) & rest.rlike(r"\S"), F.concat(parts, F.array(other))).otherwise(parts)
    return df.select(key, F.inline(whole))


#: Parts of Streamlit pages: what marks them, which group names them, and their importance (fixed values).
STREAMLIT_CHUNKS = [
    ("page", r"def\s+(\w+_page|\w+_view|\w+_tab)\s*\([^)]*\)\s*:", 1, 0.9),
    ("widget", r"st\.(button|selectbox|slider|text_input|file_uploader|multiselect|radio|checkbox|date_input|time_input|number_input|text_area|color_picker)\s*\([^)]*\)", 1, 0.7),
    ("display", r"st\.(dataframe|table|metric|json|code|plotly_chart|pyplot|altair_chart|vega_lite_chart|line_chart|area_chart|bar_chart|map)\s*\([^)]*\)", 1, 0.6),
    ("layout", r"st\.(sidebar|columns|container|expander|form|empty|placeholder)\s*\([^)]*\)", 1, 0.5),
    ("cached", r"@st\.(?:cache_data|cache_resource|cache|experimental_memo|experimental_singleton)(?:\([^)]*\))?\s*\n\s*def\s+(\w+)", 1, 0.8),
]


def streamlit_chunks(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, chunk, name, content, start_line, importance): pages, widgets, displays, layouts and cached functions of Streamlit sources; all matches."""
    found = []
    for chunk, pattern, group, importance in STREAMLIT_CHUNKS:
        rows = placed(F.col(content), F.regexp_extract_all(content, F.lit(pattern), F.lit(0)))

        def part(x):
            return F.struct(F.lit(chunk).alias("chunk"), F.regexp_extract(x["text"], pattern, group).alias("name"), x["text"].alias("content"), x["line"].alias("start_line"), F.lit(importance).alias("importance"))

        found.append(F.transform(rows, part))
    return df.select(key, F.inline(F.concat(*found)))
