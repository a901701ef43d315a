"""Operator 12: benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items are the sequences of one suffix
automaton.  The words of each document are streamed through it; after each word
it knows the longest run that ends there and that some item holds.  Where such a
run reaches ``WINDOW`` words, or where a shorter item ends as a whole, the run's
words are hit, and the state that stands for the window gives the items.

A word pair that stands together in no item ends every match of more than one
word.  Texts are first cut at such pairs with numpy, and only pieces of as many
words as the shortest window are streamed, which changes no match.

An automaton holds at most ``SHARD_WORDS`` words of items.  More items make
further automata, which the documents pass one after another; a longer item is
cut into pieces that share ``WINDOW - 1`` words.  So what is broadcast at once
and what the driver holds are bounded, and work is linear in the documents for
each automaton.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import MARKS, Words, chunks, encoded
from .shared import documents, small_batches, written

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of items in one automaton: at most twice as many states and three times as many transitions.
SHARD_WORDS = 100_000
#: Automata that documents pass before what they have found is written.
PASSES = 4
#: Spans of at least so many words are removed, and all spans of a document of which they cover more than this share.
LEAST_WORDS = WINDOW
MOST_SHARE = 0.5

RESULTS = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "span_begin": "array<bigint>", "span_end": "array<bigint>", "span_match": "array<bigint>"}


class Automaton:
    """Suffix automaton of several sequences of word hashes, with the items of each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in items)]))
        self.width = width = max(len(self.words), 1)
        coded = [(item, np.searchsorted(self.words, h)) for item, h in items]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(c[:-1] * width + c[1:] for _, c in coded)]))
        self.shortest = min((min(len(c), window) for _, c in coded), default=window)
        self.moves: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        out: list[list[int]] = [[]]
        for _, c in coded:
            last = 0
            for code in c.tolist():
                last = self._extend(last, code, out)
        self._windows(coded)

    def _copy(self, p: int, q: int, code: int, out: list[list[int]]) -> int:
        """A state for the runs of ``q`` that are as long as those of ``p`` and the code behind them."""
        twin = len(self.link)
        out.append(list(out[q]))
        for c in out[q]:
            self.moves[twin * self.width + c] = self.moves[q * self.width + c]
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p != -1 and self.moves.get(p * self.width + code) == q:
            self.moves[p * self.width + code] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, code: int, out: list[list[int]]) -> int:
        q = self.moves.get(last * self.width + code)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, code, out)
        state = len(self.link)
        out.append([])
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and p * self.width + code not in self.moves:
            self.moves[p * self.width + code] = state
            out[p].append(code)
            p = self.link[p]
        if p != -1:
            q = self.moves[p * self.width + code]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, code, out)
        return state

    def _windows(self, coded: list[tuple[str, np.ndarray]]) -> None:
        """The items of each state: by windows that end in it, and those that it is as a whole."""
        found: dict[int, dict[str, None]] = {}
        whole: dict[int, dict[str, None]] = {}
        for item, c in coded:
            at = length = 0
            for code in c.tolist():
                at, length = self.moves[at * self.width + code], min(length + 1, self.window)
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                if length == self.window:
                    found.setdefault(at, {})[item] = None
            if 0 < len(c) < self.window:
                whole.setdefault(at, {})[item] = None
        self.items = {s: tuple(v) for s, v in found.items()}
        self.whole = {s: tuple(v) for s, v in whole.items()}
        n = len(self.link)
        self.of_window, self.of_whole = [-1] * n, [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.of_window[s] = s if self.length[up] < self.window else self.of_window[up]
            self.of_whole[s] = s if s in self.whole else self.of_whole[up]

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
        """(position, length of the window, longest match, items) of each window that ends at a position."""
        moves, width, link, lengths = self.moves, self.width, self.link, self.length
        at = length = 0
        for i, code in enumerate(codes):
            to = moves.get(at * width + code)
            while to is None and at:
                at = link[at]
                length = lengths[at]
                to = moves.get(at * width + code)
            if to is None:
                continue
            at, length = to, length + 1
            if length >= self.window:
                yield i, self.window, length, self.items[self.of_window[at]]
            if self.whole:
                w = self.of_whole[at if length == lengths[at] else link[at]]
                while w > 0:
                    yield i, lengths[w], length, self.whole[w]
                    w = self.of_whole[link[w]]

    def spans(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[dict[str, None]]]:
        """(hit words, longest match at each word, items of each text)."""
        hit, longest, items = np.zeros(len(words.hash) + 1, np.int32), np.zeros(len(words.hash), np.int64), [{} for _ in words.count]
        if not len(self.words) or not len(words.hash):
            return hit[:-1] > 0, longest, items
        code = np.minimum(np.searchsorted(self.words, words.hash), len(self.words) - 1)
        known = self.words[code] == words.hash
        owner = words.owner()
        joined = np.zeros(len(code), bool)
        if len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1] & (owner[1:] == owner[:-1]))
            pair = code[both] * self.width + code[both + 1]
            joined[both + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        first = np.flatnonzero(known & ~joined)
        stops = np.append(np.flatnonzero(~joined), len(code))
        last = stops[np.searchsorted(stops, first, side="right")]
        long = last - first >= self.shortest
        for b, e in zip(first[long].tolist(), last[long].tolist(), strict=True):
            of = items[owner[b]]
            for i, size, length, which in self.stream(code[b:e].tolist()):
                hit[b + i + 1 - size] += 1
                hit[b + i + 1] -= 1
                longest[b + i] = max(longest[b + i], length)
                of.update(dict.fromkeys(which))
        return np.cumsum(hit[:-1]) > 0, longest, items


def _pieces(items: DataFrame, window: int) -> Iterator[tuple[str, np.ndarray]]:
    """(item, word hashes), one item or piece of an item of at most ``SHARD_WORDS`` words at a time."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["text"])
            for b, e in chunks(texts):
                words = Words(texts[b:e], lower=True, gaps=MARKS)
                out = [(pdf["item"].iloc[b + i], words.hash[at : min(at + SHARD_WORDS, z)].view(np.int64)) for i, (a, z) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)) for at in range(a, max(z - window + 1, a + (z > a)), SHARD_WORDS - window + 1)]
                if out:
                    yield pd.DataFrame(out, columns=["item", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    for item, words in named.mapInPandas(cut, "item string, words array<bigint>").toLocalIterator():
        yield item, np.array(words, np.int64).view(np.uint64)


def automata(items: DataFrame, window: int = WINDOW) -> Iterator[Automaton]:
    """Automata of all items (item_id, text), each of at most ``SHARD_WORDS`` words.

    A missing item_id is the empty string; rows of one item_id are one item.  An
    item whose text is null or has no word has no window.
    """
    shard: list[tuple[str, np.ndarray]] = []
    total = 0
    for item, words in _pieces(items, window):
        if shard and total + len(words) > SHARD_WORDS:
            yield Automaton(shard, window)
            shard, total = [], 0
        shard.append((item, words))
        total += len(words)
    if shard:
        yield Automaton(shard, window)


def _found(pdf: pd.DataFrame, texts: list[bytes], b: int, e: int, automaton: Automaton) -> pd.DataFrame:
    words = Words(texts[b:e], lower=True, gaps=MARKS)
    hit, longest, items = automaton.spans(words)
    fresh = np.zeros(len(hit) + 1, bool)
    fresh[words.first] = True
    begins = np.flatnonzero(hit & (fresh[:-1] | ~np.concatenate([[False], hit])[:-1]))
    ends = np.flatnonzero(hit & (fresh[1:] | ~np.append(hit, False)[1:])) + 1
    out = {k: [] for k in RESULTS}
    rows = pdf.iloc[b:e]
    for i, (f, z) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        lo, hi = np.searchsorted(begins, [f, z])
        found = list(zip((begins[lo:hi] - f).tolist(), (ends[lo:hi] - f).tolist(), [int(longest[x:y].max()) for x, y in zip(begins[lo:hi], ends[lo:hi], strict=True)], strict=True))
        if "items" in rows:
            items[i].update(dict.fromkeys(rows["items"].iloc[i]))
            found = _merged([*found, *zip(rows["span_begin"].iloc[i], rows["span_end"].iloc[i], rows["span_match"].iloc[i], strict=True)])
        for k, v in zip(RESULTS, (z - f, sum(y - x for x, y, _ in found), sorted(items[i]), *([s[j] for s in found] for j in range(3))), strict=True):
            out[k].append(v)
    return rows.assign(**{k: pd.Series(v, index=rows.index, dtype="int64" if k[:2] == "n_" else object) for k, v in out.items()})


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for b, e, m in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1:] = [max(out[-1][1], e), max(out[-1][2], m)]
        else:
            out.append([int(b), int(e), int(m)])
    return [tuple(x) for x in out]


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: bool = True) -> DataFrame:
    """Columns of ``docs``, the text only if asked for, with n_words, n_hit, items and the spans of hit words (columns of these names are replaced).

    Spans are three arrays: ``span_begin`` and ``span_end`` (words from 0, end
    not included) and ``span_match``, the longest run of words that ends in the
    span and that an item holds; they are apart and ascend.  ``items`` are the
    different item ids, as strings in ascending order.  A null text has no word.
    Repeated rows give repeated results; without documents the result is empty,
    without items nothing is hit.  Texts of any length are streamed whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select([f"`{c}`" for c in docs.columns if c not in RESULTS])
    shards = chain(automata(items, window), [None])
    automaton, n = next(shards) or Automaton([], window), 0
    while automaton:
        after = next(shards, None)
        if n and n % PASSES == 0:
            out = written(out, "matches")
        out, n = _passed(out, spark.sparkContext.broadcast(automaton), text or after is not None), n + 1
        automaton = after
    return out


def _passed(docs: DataFrame, automaton, text: bool) -> DataFrame:
    own = [c for c in docs.columns if c not in RESULTS and (text or c != "text")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in own), *(f"{c} {t}" for c, t in RESULTS.items())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["text"])
            for b, e in chunks(texts):
                yield _found(pdf, texts, b, e, automaton.value)[[*own, *RESULTS]]

    return docs.mapInPandas(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, most_share: float = MOST_SHARE) -> DataFrame:
    """``matches`` with ``rejected`` and ``kept_text``, the text without the spans that exceed the limits.

    A span of at least ``least_words`` words is removed, from its first word's
    first to its last word's last character; in a document of whose words spans
    cover more than ``most_share`` every span is, and it is ``rejected``.  A null
    text stays null.
    """
    out = matches(docs, items, window).withColumn("rejected", F.col("n_hit") > F.col("n_words") * F.lit(float(most_share)))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in out.dtypes if c != "kept_text"), "kept_text string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for text, begin, end, all_ in zip(pdf["text"], pdf["span_begin"], pdf["span_end"], pdf["rejected"], strict=True):
                gone = [(b, e) for b, e in zip(begin, end, strict=True) if all_ or e - b >= least_words]
                if gone:
                    data = encoded([text])[0]
                    words, at, parts = Words([data], gaps=MARKS), 0, []
                    for b, e in gone:
                        parts.append(data[at : words.start[b]])
                        at = words.end[e - 1]
                    text = b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")
                kept.append(text)
            yield pdf.assign(kept_text=kept)

    return out.select([f"`{c}`" for c in out.columns if c != "kept_text"]).mapInPandas(run, schema)


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document; documents without a hit have the digest of the empty string."""
    found = matches(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
g AS (SELECT DISTINCT item, size, array_to_string(ws[at_:at_ + size - 1], ' ') AS gram FROM (SELECT item, ws, least(len(ws), {WINDOW}) AS size, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS at_ FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT size FROM g),
w AS (SELECT r, size, at_, array_to_string(ws[at_:at_ + size - 1], ' ') AS gram FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS at_ FROM d, s)),
m AS (SELECT r, at_, size, item FROM w JOIN g USING (size, gram)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(at_, at_ + size)) AS p FROM (SELECT DISTINCT r, at_, size FROM m)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""
