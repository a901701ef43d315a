"""Text functions as column builders: tokenizers, keyword lists, similarities, hashes, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the BM25 tokenizer (fixed values).
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with var let const if else return true false null undefined".split()

#: Stop words of query keywords (fixed values).
QUERY_STOP_WORDS = "the a an and or but in on at to for of with by how what where when why is are was were be been have has had do does did will would could should can may might".split()

#: Words that the decomposer leaves out as well (fixed values).
PRONOUNS = "this that these those i you he she it we they me him her us them".split()

#: Synonyms of query terms (fixed values).
SYNONYMS = {
    "function": ["method", "procedure", "routine"],
    "method": ["function", "procedure", "routine"],
    "class": ["object", "type", "entity"],
    "variable": ["var", "property", "field"],
    "parameter": ["param", "argument", "arg"],
    "return": ["result", "output", "response"],
    "create": ["make", "build", "generate", "new"],
    "delete": ["remove", "destroy", "drop"],
    "update": ["modify", "change", "edit"],
    "get": ["fetch", "retrieve", "obtain"],
    "set": ["assign", "store", "save"],
    "check": ["validate", "verify", "test"],
    "handle": ["process", "manage", "deal"],
    "error": ["exception", "failure", "issue"],
    "config": ["configuration", "settings", "options"],
}


def bm25_tokens(text: Column, split_camel: bool = False) -> Column:
    """Lower-case words of two letters or more, without stop words and numbers.

    Camel case is not split by default, because letters are lowered first.
    """
    if split_camel:
        text = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[_\-.]", " "), r"[^\w\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$"))


def hybrid_tokens(text: Column) -> Column:
    """Lower-case words; dots and hyphens stay."""
    # the class without them is several times faster than one with them
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s](?<![.\-])", " "), r"\s+"), lambda t: F.length(t) > 1)


def query_keywords(text: Column, stop_words: list[str] = QUERY_STOP_WORDS, most: int = 10) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(stop_words))
    return F.slice(words, 1, most)


def phrases(text: Column, most: int = 50) -> Column:
    """Runs of two and of three tokens, interleaved by position."""
    t = hybrid_tokens(text)
    run = lambda t, i, k: F.concat_ws(" ", *[F.get(t, i + j) for j in range(k)])
    pairs = lambda t: F.flatten(F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.when(i + 2 < F.size(t), F.array(run(t, i, 2), run(t, i, 3))).otherwise(F.array(run(t, i, 2)))))
    return once(t, lambda t: F.when(F.size(t) >= 2, F.slice(pairs(t), 1, most)).otherwise(F.array().cast("array<string>")))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def synonyms(words: Column, table: dict[str, list[str]] | None = None) -> Column:
    """Words with their synonyms, distinct, in order."""
    mapping = F.create_map(*[x for k, v in (table or SYNONYMS).items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(mapping, w), F.array().cast("array<string>"))))))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets given as arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def term_density(text: Column, terms: Column) -> Column:
    words = hybrid_tokens(text)
    return once(words, lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.array_contains(terms, x))) / F.size(w)).otherwise(0.0))


def humanized(name: Column) -> Column:
    return F.initcap(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), r"[_\-/]+", " ")))


def identifier(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9]", "_")


def int32_hash(text: Column) -> Column:
    """h = 31 h + code, as a signed 32-bit number."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wide = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide)


def glob_to_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+^$(){}|[]\\" else c), i + 1
    return f"^{out}$"


#: Extension to language (fixed values).
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "vue": "vue", "svelte": "svelte", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c",
    "html": "html", "css": "css", "json": "json", "yml": "yaml", "yaml": "yaml", "xml": "xml", "md": "markdown", "sql": "sql", "sh": "shell",
}


def language_of(extension: Column, default: str = "text") -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, F.lower(extension)), F.lit(default))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


#: Branching words of the complexity counts (fixed values).
BRANCHES = "if else while for switch case catch try".split()


def branch_complexity(text: Column) -> Column:
    """1 and one for each branching word and each logical operator."""
    words = [F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])")) for w in BRANCHES]
    return (1 + total(words) + F.regexp_count(text, F.lit(r"&&")) + F.regexp_count(text, F.lit(r"\|\|"))).cast("long")


def human_bytes(n: Column) -> Column:
    units = ["Bytes", "KB", "MB", "GB"]
    level = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), level), 2)
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(F.format_string("%.2f", value), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in units]), level + 1)))


def tagged(pairs: list[tuple[Column, str]]) -> Column:
    """The labels whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def length_score(n: Column) -> Column:
    """Piecewise linear preference for chunks of 500 to 2000 characters."""
    return F.when(n < 100, 0.3).when(n < 500, 0.6 + (n - 100) / 400 * 0.2).when(n <= 2000, 0.8 + (n - 500) / 1500 * 0.2).when(n <= 5000, 1.0 - (n - 2000) / 3000 * 0.3).otherwise(0.7)


def complexity_score(c: Column) -> Column:
    return F.when(c.between(3, 7), 1.0).when(c < 3, 0.7).when(c > 10, 0.4).otherwise(0.8)


def complexity_class(c: Column) -> Column:
    return F.when(c <= 3, "simple").when(c <= 7, "moderate").otherwise("complex")
