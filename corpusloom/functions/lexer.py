"""What each character of a source text is: code, comment or string; and the blocks that follow from it.

A text is scanned once from mark to mark (quotes, comment signs, braces of
templates), between which the regular expression engine leaps; all else works on
the resulting array with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

CODE, COMMENT, STRING = 0, 1, 2
LANGUAGES = {"java": "java", "kotlin": "java", "javascript": "javascript", "typescript": "javascript", "jsx": "javascript", "tsx": "javascript", "vue": "javascript", "svelte": "javascript", "python": "python"}

_MARKS = {
    "java": re.compile(r"//|/\*|\"\"\"|[\"']"),
    "javascript": re.compile(r"//|/\*|[\"'`/{}]"),
    "python": re.compile(r"#|\"\"\"|'''|[\"']"),
}
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*(?:{q}|(?=\n)|\\?\Z)", re.S) for q in "\"'"}
_LONG = {q: re.compile(rf"{q}(?:\\.|(?!{q})[\s\S])*(?:{q}|\\?\Z)", re.S) for q in ('"""', "'''")}
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(?:`|\$\{|\\?\Z)", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: A slash after one of these begins a regular expression, after anything else it divides.
_BEFORE_REGEX = re.compile(r"(?:[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|new|delete|void|throw)|\A)\s*\Z")


#: Languages of components, in whose markup scripts and styles stand; a comment of the markup has neither.
_COMPONENTS = ("vue", "svelte")
_MARKUP = re.compile(r"(?i)<!--[\s\S]*?(?:-->|\Z)|<(script|style)\b[^>]*>")
_STYLE_COMMENT = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)")


def _parts(text: str, language: str) -> Iterator[tuple[int, int, int]]:
    """(begin, end, kind) of comments and strings; one that does not end runs to the end of the text, a quoted one to that of its line."""
    at, inner = 0, []
    while m := _MARKS[language].search(text, at):
        begin, mark = m.start(), m[0]
        at = m.end()
        if mark in ("//", "#"):
            at = text.find("\n", begin)
            at = len(text) if at < 0 else at
            yield begin, at, COMMENT
        elif mark == "/*":
            at = text.find("*/", at)
            at = len(text) if at < 0 else at + 2
            yield begin, at, COMMENT
        elif mark in _LONG or mark in _QUOTED:
            at = (_LONG.get(mark) or _QUOTED[mark]).match(text, begin).end()
            yield begin, at, STRING
        elif mark == "/":
            if (r := _REGEX.match(text, begin)) and _BEFORE_REGEX.search(text[max(0, begin - 40) : begin]):
                at = r.end()
                yield begin, at, STRING
        elif mark == "{":
            if inner:
                inner[-1] += 1
        elif mark == "`" or inner:
            if mark == "}" and inner[-1]:
                inner[-1] -= 1
                continue
            if mark == "}":
                inner.pop()
            end = _TEMPLATE.match(text, at).end()
            if text[at:end].endswith("${"):
                inner.append(0)
            at = end
            yield begin, end, STRING


def _component_parts(text: str) -> Iterator[tuple[int, int, int]]:
    """``_parts`` of a component: code is what its scripts have, markup and styles are strings, but for their comments."""
    at = 0
    while m := _MARKUP.search(text, at):
        yield at, m.end(), STRING
        at = m.end()
        if m[1] is None:
            yield m.start(), at, COMMENT
            continue
        closed = re.compile(rf"(?i)</{m[1]}\b").search(text, at)
        end = closed.start() if closed else len(text)
        if m[1].lower() == "script":
            yield from ((at + b, at + e, kind) for b, e, kind in _parts(text[at:end], "javascript"))
        else:
            yield at, end, STRING
            yield from ((at + c.start(), at + c.end(), COMMENT) for c in _STYLE_COMMENT.finditer(text[at:end]))
        at = end
    yield at, len(text), STRING


def kinds(text: str, language: str) -> np.ndarray:
    """The kind of each character of a text in one of ``LANGUAGES``."""
    out = np.zeros(len(text), np.int8)
    for begin, end, kind in _component_parts(text) if language in _COMPONENTS else _parts(text, LANGUAGES[language]):
        out[begin:end] = kind
    return out


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _masked(text: str, gone: np.ndarray) -> str:
    points = _characters(text).copy()
    points[gone & (points != 10)] = 32
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def code_only(text: str, kind: np.ndarray) -> str:
    """The text with blanks for comments and strings; lines and places stay."""
    return _masked(text, kind != CODE)


def without_comments(text: str, language: str) -> str:
    """The text without comments, and without documentation strings in Python, and without what this leaves of their lines."""
    kind = kinds(text, language)
    gone = kind == COMMENT
    if LANGUAGES[language] == "python":
        for m in re.finditer(r"(?m)^[ \t]*[rRuUbBfF]*(\"\"\"|''')", text):
            b = m.start(1)
            if kind[b] == STRING and (b == 0 or kind[b - 1] != STRING) and (not text[:b].strip() or text[: m.start()].rstrip()[-1:] in (":", "") or text[: m.start()].rstrip().endswith(('"""', "'''"))):
                end = _LONG[m[1]].match(text, b).end()
                gone[m.start() : end] = True
    touched = {i for i in np.cumsum(_characters(text) == 10)[gone].tolist()} if gone.any() else set()
    points = _characters(text)
    newline = points == 10
    kept = points[~gone | newline].tobytes().decode("utf-32-le", "surrogatepass")
    lines = kept.split("\n")
    return "\n".join(x.rstrip() for i, x in enumerate(lines) if x.strip() or i not in touched).strip()


def closing(text: str, kind: np.ndarray, pair: str = "{}") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of opening signs in code, of the sign that closes each or -1, signs open after each character)."""
    points = _characters(text)
    step = np.where(kind == CODE, (points == ord(pair[0])).astype(np.int64) - (points == ord(pair[1])), 0)
    depth = np.cumsum(step)
    at = np.flatnonzero(step)
    if not len(at):
        return at, at, depth
    level = depth[at] + (step[at] < 0)
    order = np.lexsort((at, level))
    opens, nxt = step[at][order] > 0, np.append(order[1:], 0)
    closed = opens & np.append(level[order][1:] == level[order][:-1], False) & (step[at][nxt] < 0)
    ends = np.full(len(at), -1)
    ends[order[closed]] = at[nxt[closed]]
    return at[step[at] > 0], ends[step[at] > 0], depth


def brace_ends(text: str, kind: np.ndarray, fallback: int = 1000) -> Callable[[int], int]:
    """The end of the block whose first brace in code stands at or behind a place: behind the brace that closes it, else ``fallback`` further on."""
    opens, ends, _ = closing(text, kind)

    def end(begin: int) -> int:
        i = np.searchsorted(opens, begin)
        return int(ends[i]) + 1 if i < len(opens) and ends[i] >= 0 else min(len(text), begin + fallback)

    return end


def indent_ends(text: str, kind: np.ndarray) -> Callable[[int], int]:
    """The end of a statement's block in Python: before the next statement that is not deeper.

    A line within brackets or a string begins no statement, nor does one that
    has nothing but a comment.
    """
    points = _characters(text)
    inside = np.zeros(len(text) + 1, np.int64)
    for pair in ("()", "[]", "{}"):
        inside[1:] += closing(text, kind, pair)[2]
    first = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    blank = (points == 32) | (points == 9)
    begins, widths = [], []
    solid = np.append(np.flatnonzero(~blank), len(text))
    for b, s in zip(first.tolist(), solid[np.searchsorted(solid, first)].tolist(), strict=True):
        if s < len(text) and points[s] not in (10, 13) and kind[s] != COMMENT and inside[b] <= 0 and not (b and kind[b - 1] == STRING and kind[b] == STRING):
            begins.append(b)
            widths.append(s - b)
    begins_, widths_ = np.array(begins, np.int64), np.array(widths, np.int64)
    bare = _masked(text, kind == COMMENT)

    def end(begin: int) -> int:
        i = np.searchsorted(begins_, begin, side="right") - 1
        later = np.flatnonzero(widths_[i + 1 :] <= widths_[i])
        stop = int(begins_[i + 1 + later[0]]) if len(later) else len(text)
        return begin + len(bare[begin:stop].rstrip())

    return end
