"""Declarations of source files: their blocks, nesting, complexity and relations.

Comments and strings are masked before anything is matched, so that a brace in a
string closes no block and a word in a comment declares nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexer as L

#: Bytes of the files that a worker gets at a time.
BATCH_BYTES = 4 << 20

_NAME = r"[A-Za-z_$][\w$]*"
#: kind, pattern with the groups name and, where it has them, parameters, result, extends and implements
_PATTERNS = {
    "javascript": [
        ("class", re.compile(rf"\bclass\s+(?P<name>{_NAME})(?:\s*<[^>{{]*>)?(?:\s+extends\s+(?P<extends>[\w$.]+)(?:<[^>{{]*>)?)?(?:\s+implements\s+(?P<implements>[^{{]+))?\s*\{{")),
        ("interface", re.compile(rf"\binterface\s+(?P<name>{_NAME})(?:\s*<[^>{{]*>)?(?:\s+extends\s+(?P<extends>[^{{]+))?\s*\{{")),
        ("enum", re.compile(rf"\benum\s+(?P<name>{_NAME})\s*\{{")),
        ("function", re.compile(rf"\bfunction\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^>(]*>)?\((?P<parameters>[^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*:\s*(?P<result>[^{{=;]+))?\s*\{{")),
        ("function", re.compile(rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\((?P<parameters>[^()]*(?:\([^()]*\)[^()]*)*)\)|{_NAME})(?:\s*:\s*(?P<result>[^=;{{]+))?\s*=>")),
        ("method", re.compile(rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return|with|constructor\b\s*;)\b)(?P<name>{_NAME})\s*(?:<[^>(]*>)?\((?P<parameters>[^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*:\s*(?P<result>[^{{=;]+))?\s*\{{")),
    ],
    "java": [
        ("class", re.compile(r"\b(?:class|record)\s+(?P<name>\w+)(?:\s*<[^>{]*>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<extends>[\w.]+)(?:<[^>{]*>)?)?(?:\s+implements\s+(?P<implements>[^{]+))?\s*\{")),
        ("interface", re.compile(r"(?<!@)\binterface\s+(?P<name>\w+)(?:\s*<[^>{]*>)?(?:\s+extends\s+(?P<extends>[^{]+))?\s*\{")),
        ("enum", re.compile(r"\benum\s+(?P<name>\w+)(?:\s+implements\s+(?P<implements>[^{]+))?\s*\{")),
        ("method", re.compile(r"(?m)(?:^|(?<=[{};]))[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s+)?(?!(?:return|new|else|throw|if|for|while|switch|catch|try|synchronized)\b)(?P<result>[\w.]+(?:<[^;{}()]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*\((?P<parameters>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w.,\s]+)?\{")),
    ],
    "python": [
        ("class", re.compile(r"(?m)^[ \t]*class\s+(?P<name>\w+)\s*(?:\((?P<extends>[^)]*)\))?\s*:")),
        ("function", re.compile(r"(?m)^[ \t]*(?:async\s+)?def\s+(?P<name>\w+)\s*\((?P<parameters>(?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)\s*(?:->\s*(?P<result>[^\n]+?))?\s*:")),
    ],
}
#: Words and signs that add a way through a function (fixed values), and those that put what is inside one level deeper.
_BRANCH = re.compile(r"\b(?:if|elif|while|for|switch|case|catch|except|and|or)\b|&&|\|\||\?(?![.?:])")
_WORDS = {"javascript": {"if", "while", "for", "switch", "catch", "&&", "||", "?"}, "java": {"if", "while", "for", "switch", "catch", "&&", "||", "?"}, "python": {"if", "elif", "while", "for", "except", "and", "or"}}
_OPERATOR = re.compile(r"===|!==|\*\*|<<|>>>?|[=!<>]=|&&|\|\||\?\?|//|[-+*/%<>&|^](?!=)")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_CALL = re.compile(rf"(?<![\w$.])((?:{_NAME}\.)*)({_NAME})\s*\(")
_NO_CALL = frozenset("async if for while switch catch return function def class elif except with and or not in lambda print super new throw await typeof assert yield del raise synchronized".split())
_IMPORTS = {
    "javascript": re.compile(r"(?m)\bimport\s+(?:[^'\"();]*?\bfrom\s*)?(['\"])(?P<module>[^'\"\n]+)\1|\brequire\s*\(\s*(['\"])(?P<other>[^'\"\n]+)\3"),
    "java": re.compile(r"(?m)^\s*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;"),
    "python": re.compile(r"(?m)^\s*(?:from\s+(?P<module>[\w.]+)\s+import\b|import\s+(?P<other>[\w., \t]+))"),
}
_ANNOTATION = re.compile(r"@([A-Za-z_][\w.]*)")

DECLARATIONS = "kind string, name string, parent string, level int, start_line int, end_line int, begin int, end int, parameters array<string>, result string, extends array<string>, implements array<string>, annotations array<string>, calls array<string>, complexity int, own_complexity int, cognitive int"


def _listed(text: str | None) -> list[str]:
    """The parts of a list between commas outside of brackets."""
    out, depth, part = [], 0, ""
    for c in text or "":
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [" ".join(x.split()) for x in [*out, part] if x.strip()]


def _annotations(lines: list[str], line: int) -> list[str]:
    """Annotations and decorators in the lines right above a declaration, in their order."""
    found: list[str] = []
    i = line - 1
    while i >= 0 and (text := lines[i].strip()) and (text.startswith("@") or text.endswith((")", ",", "("))):
        if text.startswith("@"):
            found = _ANNOTATION.findall(text.split("(")[0]) + found
        i -= 1
    return found


def file_declarations(text: str, language: str) -> list[tuple]:
    """The rows of one file, in the order of their begin."""
    base = L.LANGUAGES[language]
    kind = L.kinds(text, language)
    code = L.code_only(text, kind)
    end_of = (L.indent_ends if base == "python" else L.brace_ends)(text, kind)
    found = {}
    for what, pattern in _PATTERNS[base]:
        for m in pattern.finditer(code):
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            arrow = m[0].endswith("=>")
            if arrow and not code[m.end() :].lstrip().startswith("{"):
                stop = re.compile(r"[;\n]").search(code, m.end())
                end = stop.start() if stop else len(code)
            else:
                end = end_of(begin if base == "python" else m.end() if arrow else m.end() - 1)
            found.setdefault(m.start("name"), (begin, end, what, m))
    spans = sorted(found.values(), key=lambda x: (x[0], -x[1]))
    lines, breaks = code.split("\n"), np.flatnonzero(L._characters(text) == 10)
    branches = [(m.start(), m[0]) for m in _BRANCH.finditer(code) if m[0] in _WORDS[base]]
    calls = [(m.start(), m[2]) for m in _CALL.finditer(code) if m[2] not in _NO_CALL]
    named = {m.start("name") for *_, m in spans}
    depth = None if base == "python" else L.closing(text, kind)[2]
    rows, stack = [], []
    for i, (begin, end, what, m) in enumerate(spans):
        arrow = m[0].endswith("=>")
        while stack and spans[stack[-1]][1] <= begin:
            stack.pop()
        parent = spans[stack[-1]] if stack else None
        inner = [(b, e) for b, e, k, _ in spans[i + 1 :] if b < end and e <= end and k not in ("class", "interface", "enum")]
        mine = [(at, w) for at, w in branches if begin <= at < end]
        own = [(at, w) for at, w in mine if not any(b <= at < e for b, e in inner)]
        if depth is None:
            width = len(lines[np.searchsorted(breaks, begin)]) - len(lines[np.searchsorted(breaks, begin)].lstrip())
            deep = lambda at, w=width: max(1, (len(x := lines[np.searchsorted(breaks, at)]) - len(x.lstrip()) - w) // 4)
        else:
            brace = code.find("{", m.end()) if arrow and end > m.end() else m.end() - 1
            floor = int(depth[brace]) if 0 <= brace < end else int(depth[begin])
            deep = lambda at, f=floor: max(1, int(depth[at]) - f + 1)
        first = int(np.searchsorted(breaks, begin))
        last = int(np.searchsorted(breaks, max(begin, end - 1)))
        if what == "method" and base == "javascript" and (parent is None or parent[2] != "class"):
            continue  # a call with a block, or a function that another pattern has found
        if what == "function" and base == "python" and parent is not None and parent[2] == "class":
            what = "method"
        g = m.groupdict()
        rows.append((
            what, g["name"], parent[3]["name"] if parent else None, len(stack), first + 1, last + 1, begin, end, _listed(g.get("parameters")), " ".join(g["result"].split()) if g.get("result") else None,
            [x for x in _listed(g.get("extends")) if "=" not in x], _listed(g.get("implements")), _annotations(lines, first), sorted({n for at, n in calls if begin <= at < end and at not in named and n != g["name"]}), 1 + len(mine), 1 + len(own), sum(deep(at) for at, _ in own),
        ))
        stack.append(i)
    return rows


def _in_batches(files: DataFrame, run, schema: str) -> DataFrame:
    """``files`` through ``run``, about ``BATCH_BYTES`` at a time from here on in this session; a worker holds a batch several times over."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return files.mapInPandas(run, schema)


def declarations(files: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """A row for each class, interface, enum, function and method of files in Java, JavaScript, TypeScript, Python, Vue and Svelte.

    ``parent`` and ``level`` tell the innermost declaration around it and how
    many there are; lines count from 1, ``begin`` and ``end`` characters from 0.
    ``complexity`` is 1 and one for each branch of the block, ``own_complexity``
    leaves those of functions inside out, and ``cognitive`` weighs these by their
    depth.  A block that never closes ends after 1,000 characters.  ``calls`` are
    the names called in the block.  Null texts and other languages have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *row) for k, t, lang in zip(pdf[key], pdf[text], pdf[language], strict=True) if isinstance(t, str) and lang in L.LANGUAGES for row in file_declarations(t, lang)]
            yield pd.DataFrame(out, columns=[key, *(c.split()[0] for c in DECLARATIONS.split(", "))])

    return _in_batches(files.select(key, text, language), run, f"`{key}` {dict(files.dtypes)[key]}, {DECLARATIONS}")


def cleaned(files: DataFrame, text: str, language: str) -> DataFrame:
    """``files`` with the text without comments; other languages and null stay as they are."""
    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{text: [L.without_comments(t, lang) if isinstance(t, str) and lang in L.LANGUAGES else t for t, lang in zip(pdf[text], pdf[language], strict=True)]})

    return _in_batches(files, run, schema)


def _measured(text: str, language: str) -> tuple:
    base = L.LANGUAGES[language]
    kind = L.kinds(text, language)
    code = L.code_only(text, kind)
    branches = [m.start() for m in _BRANCH.finditer(code) if m[0] in _WORDS[base]]
    operators = _OPERATOR.findall(code)
    operands = [w for w in _WORD.findall(code) if w not in _NO_CALL]
    kinds = len(set(operators)), len(set(operands))
    difficulty = kinds[0] / 2 * len(operands) / kinds[1] if kinds[0] and kinds[1] else 0.0
    length = len(operators) + len(operands)
    deepest = int(L.closing(text, kind)[2].max(initial=0)) if base != "python" else max((len(x) - len(x.lstrip())) // 4 for x in code.split("\n") if x.strip()) if code.strip() else 0
    return 1 + len(branches), deepest, sum(kinds), length, difficulty, difficulty * length, length * math.log2(max(sum(kinds), 1)), int((kind == L.COMMENT).sum())


def file_measures(files: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, cyclomatic, deepest, vocabulary, length, difficulty, effort, volume, comment_chars) of each file: branches, deepest block, and what different and all operators and operands give."""
    names = "cyclomatic int, deepest int, vocabulary int, length int, difficulty double, effort double, volume double, comment_chars int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *_measured(t, lang)) for k, t, lang in zip(pdf[key], pdf[text], pdf[language], strict=True) if isinstance(t, str) and lang in L.LANGUAGES]
            yield pd.DataFrame(out, columns=[key, *(c.split()[0] for c in names.split(", "))])

    return _in_batches(files.select(key, text, language), run, f"`{key}` {dict(files.dtypes)[key]}, {names}")


def imports(files: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, module) of each import statement in code; a module that a file imports twice is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, lang in zip(pdf[key], pdf[text], pdf[language], strict=True):
                if isinstance(t, str) and lang in L.LANGUAGES:
                    kind = L.kinds(t, lang)
                    for m in _IMPORTS[L.LANGUAGES[lang]].finditer(t):
                        if kind[m.end() - len(m[0].lstrip())] == L.CODE:
                            out += [(k, x.strip().split(" ")[0]) for x in (m["module"] or (m["other"] if "other" in m.re.groupindex else "") or "").split(",") if x.strip()]
            yield pd.DataFrame(out, columns=[key, "module"])

    return _in_batches(files.select(key, text, language), run, f"`{key}` {dict(files.dtypes)[key]}, module string").distinct()


def relationships(found: DataFrame, key: str) -> DataFrame:
    """(key, source, target, relation) of declarations: extends, implements, and calls of names that some file declares."""
    name = lambda c: F.substring_index(F.regexp_replace(c, "<.*", ""), ".", -1)
    up = lambda c: found.select(key, F.col("name").alias("source"), F.explode(c).alias("target")).select(key, "source", name(F.col("target")).alias("target"), F.lit(c).alias("relation"))
    calls = found.where(F.col("kind").isin("function", "method")).select(key, F.col("name").alias("source"), F.explode("calls").alias("target"))
    known = found.where(F.col("kind").isin("function", "method", "class")).select(F.col("name").alias("target")).distinct()
    return up("extends").unionByName(up("implements")).unionByName(calls.join(known, "target").select(key, "source", "target", F.lit("calls").alias("relation"))).distinct()
