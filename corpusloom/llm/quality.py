"""Operator 9: quality rules with cross-document line frequency.

Lines are normalised (letters lowered, digits as 0, white space joined) and
hashed; each host's distinct documents are counted for every line.  A line that
more than ``max(LEAST, SHARE * documents of the host)`` documents of its host
hold is removed, and a document that keeps less than ``REST`` of its words is
rejected as depleted.  The rules of a single document come before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, chunks, encoded, mix, runs, signed, span_hashes
from .shared import documents, small_batches, written

LEAST = 20
SHARE = 0.05
REST = 0.5
SYMBOLS = b"#*$%&|<>"

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_WEIGHT = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:bigint,words:int>>"


def repeats(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its text, is not the first) for each key."""
    order = np.argsort(mix(keys ^ (of.astype(np.uint64) * _U(0x9E3779B97F4A7C15))), kind="stable")
    k, o = keys[order], of[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    later = np.zeros(len(keys), bool)
    twice = np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def measured(texts: list[bytes]) -> dict[str, object]:
    w = Words(texts)
    n = len(texts)
    per_byte = lambda flag: np.add.reduceat(flag, w.offset[:-1]) if n else np.zeros(0, int)  # noqa: E731  every text has at least the closing newline
    is_lead = (w.raw & 0xC0) != 0x80
    in_word = np.zeros(len(w.raw) + 1, np.int8)
    in_word[w.start] += 1
    in_word[w.end] -= 1
    chars = per_byte((is_lead & (np.cumsum(in_word[:-1]) > 0)).astype(np.int64))
    symbols = per_byte(_SYMBOL[w.raw].astype(np.int64))

    # words of three-word windows that occur twice or more
    grams, at, of = w.grams(3)
    twice, _ = repeats(grams, of)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    for j in range(3):
        cover[at[twice] + j] = 1
    total = np.concatenate([[0], np.cumsum(cover)])
    repeated = total[w.first[1:]] - total[w.first[:-1]]

    # lines: [begin, end) in bytes, ends at the newline that closes it
    end = np.flatnonzero(w.raw == 10)
    begin = np.concatenate([[0], end[:-1] + 1])
    line_of = np.searchsorted(w.offset, begin, side="right") - 1
    first_word, next_word = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    words_in = next_word - first_word
    has = words_in > 0
    begin, end, line_of, words_in, first_word, next_word = (x[has] for x in (begin, end, line_of, words_in, first_word, next_word))
    exact = span_hashes(_WEIGHT[w.raw], begin, end)
    _, later = repeats(exact, line_of)
    dup = np.bincount(line_of[later], minlength=n)
    folded = span_hashes(_WEIGHT[_FOLD[w.raw]], w.start, w.end)
    loose = span_hashes(folded, first_word, next_word)
    return {"n_words": w.count, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated, "line_of": line_of, "line": signed(loose), "words": words_in}


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = encoded(pdf["text"])
        for a, z in chunks(texts):
            m = measured(texts[a:z])
            cut = np.searchsorted(m["line_of"], np.arange(z - a + 1))
            lines = []
            for i in range(z - a):
                s = slice(cut[i], cut[i + 1])
                lines.append([{"h": h, "words": k} for h, k in zip(m["line"][s].tolist(), m["words"][s].tolist(), strict=True)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:z].to_numpy(), "host": pdf["host"].iloc[a:z].to_numpy()} | {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"lines": lines})


def assess(docs: DataFrame, host: str = "source", least: int = LEAST, share: float = SHARE, rest: float = REST) -> DataFrame:
    """Measures and verdict of every document.

    A null or empty text has no words and fails the base rules.  Documents of a
    null host form a host of their own.  Repeated rows and repeated ids are
    separate documents.  Whole texts are measured, however long.  A line is
    common if its count is above the limit, not at it.  Further columns of
    ``docs`` are ignored; an empty table gives an empty result.  Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_common_lines, n_rest_words, kept.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    measures = rows.mapInPandas(_measure, f"doc_id long, host string, {_MEASURES}")
    table = written(measures.withColumn("row", F.monotonically_increasing_id()), "quality-lines")

    lines = table.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    per_doc = table.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = per_doc.groupBy("host", "h").agg(F.count("*").alias("docs"))
    sizes = table.groupBy("host").agg(F.count("*").alias("host_docs"))
    common = counts.where(F.col("docs") > least).join(sizes, "host").where(F.col("docs") > F.lit(share) * F.col("host_docs")).select("host", "h")
    removed = lines.join(common, ["host", "h"]).groupBy("row").agg(F.sum("words").alias("gone"), F.count("*").alias("n_common_lines"))

    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    out = table.drop("lines", "host").join(removed, "row", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & (left >= F.lit(rest) * F.col("n_words"))).alias("kept"), F.coalesce("n_common_lines", F.lit(0)).cast("long").alias("n_common_lines"), left.cast("long").alias("n_rest_words"))


def cleaned(docs: DataFrame, host: str = "source", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Texts without the lines that are too common on their host: doc_id, text.  Null texts stay null."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    table = written(rows.withColumn("row", F.monotonically_increasing_id()), "quality-texts")
    folded = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")
    lines = table.select("row", "host", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("h", F.xxhash64(folded(F.col("line"))))
    counts = lines.where(F.trim("line") != "").select("row", "host", "h").distinct().groupBy("host", "h").agg(F.count("*").alias("docs"))
    sizes = table.groupBy("host").agg(F.count("*").alias("host_docs"))
    common = counts.where(F.col("docs") > least).join(sizes, "host").where(F.col("docs") > F.lit(share) * F.col("host_docs")).select("host", "h")
    kept = lines.join(common, ["host", "h"], "left_anti").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    out = table.join(kept, "row", "left")
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce(F.concat_ws("\n", F.transform("l", lambda x: x["line"])), F.lit(""))).alias("text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir))
