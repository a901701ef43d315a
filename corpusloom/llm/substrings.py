"""Operator 6: substring de-duplication with repeated-phrase automata.

A passage repeats if a run of ``WINDOW`` words also starts in a document with a
smaller id.

*Confirm.*  Each window's smallest hash of ``PHRASE`` words in a row is its
phrase, so equal windows have equal phrases.  Windows in a row with the same
phrase form one place, its words one span.  Places of the same phrase and span
form a class, of which the smallest id is known.  A phrase recurs if its classes
lie in several documents.  For each class of a recurring phrase, one document of
its smallest id is read again: it confirms the words of the phrase, and where
other classes have the phrase too, gives the hashes of the class's windows, so
that windows are compared between classes, not between occurrences.

*Compile and stream.*  The confirmed phrases are sent to the documents that may
hold them.  A task compiles those of about a megabyte of documents, a shard,
into an Aho-Corasick automaton and streams the shard's documents through it.  The
positions that the automaton reports are the only ones at which anything is
removed: around each, the span is read and, if it is one of a class that the
document repeats, its words go, or those of its windows that repeat.

A document takes part in its own row only: rows of one id with different texts
are judged apart.  Work for each place is constant, so a passage that many
documents share costs no more than its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, chunks, encoded, runs, signed, span_hashes
from .shared import documents, small_batches, written

WINDOW = 50
PHRASE = 8
#: Bytes of text that share one automaton.
SHARD_BYTES = 1 << 20

#: What the caller's table may not bring along: columns of these names are replaced or left out.
OWN = ("n_words", "n_removed", "kept_sha256", "kept_text", "op6_key", "op6_places")
VERDICT = "struct<phrase:binary,sh:bigint,whole:boolean,bad:array<bigint>>"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - done :]) if width > done else out


class Places:
    """Places of several texts: text ``of``, phrase and span hash, first word ``begin`` and ``end`` of the span, and first word ``lead`` of the phrase."""

    def __init__(self, w: Words, window: int):
        at, self.of = runs(w.first, window)
        n = len(w.hash)
        phrase = span_hashes(w.hash, np.arange(max(n - PHRASE + 1, 0)), np.arange(PHRASE, max(n + 1, PHRASE)))
        width = window - PHRASE + 1
        least = _sliding_min(phrase, width)[at] if len(at) else np.zeros(0, np.uint64)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (self.of[1:] != self.of[:-1])
        first = np.flatnonzero(fresh)
        self.of, self.begin = self.of[first], at[first]
        self.end = at[np.append(first[1:], len(at)) - 1] + window if len(at) else at
        own = least[first]
        self.lead = np.full(len(first), -1)
        for i in range(width):
            self.lead[(self.lead < 0) & (phrase[self.begin + i] == own)] = i
        self.lead += self.begin
        self.ph, self.sh = signed(own), signed(span_hashes(w.hash, self.begin, self.end))

    def windows(self, w: Words, which: list[int], window: int) -> list[np.ndarray]:
        """Hashes of all windows of some places, in order."""
        which = np.array(which, np.int64)
        n = self.end[which] - self.begin[which] - window + 1
        cut = np.cumsum(n)
        start = np.arange(cut[-1] if len(cut) else 0) + np.repeat(self.begin[which] - (cut - n), n)
        return np.split(signed(span_hashes(w.hash, start, start + window)), cut[:-1]) if len(which) else []


def _emit_places(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys = pdf["doc_id"].to_numpy(np.int64), pdf["op6_key"].to_numpy(np.int64)
            texts = encoded(pdf["text"])
            for i, j in chunks(texts):
                p = Places(Words(texts[i:j]), window)
                yield pd.DataFrame({"ph": p.ph, "sh": p.sh, "op6_key": keys[i:j][p.of], "doc_id": ids[i:j][p.of]})

    return run


def _rows(column: pd.Series) -> list[list[dict]]:
    return [[] if v is None else [x.asDict() if hasattr(x, "asDict") else x for x in v] for v in column]


def _confirm(window: int):
    """Phrase and, where ``several`` says so, window hashes of the classes that a document stands for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, wanted = encoded(pdf["text"]), _rows(pdf["op6_places"])
            for i, j in chunks(texts, SHARD_BYTES):
                w = Words(texts[i:j])
                p = Places(w, window)
                open_ = [{(x["ph"], x["sh"]): x for x in rows} for rows in wanted[i:j]]
                found, at, compared = [], [], []
                for n, (of, ph, sh) in enumerate(zip(p.of.tolist(), p.ph.tolist(), p.sh.tolist(), strict=True)):
                    if (x := open_[of].pop((ph, sh), None)) is not None:
                        if x["several"]:
                            compared.append(len(found))
                        found.append(x)
                        at.append(n)
                raw = w.raw
                phrase = [b" ".join(raw[a:z].tobytes().split()) for a, z in zip(w.start[p.lead[at]].tolist(), w.end[p.lead[at] + PHRASE - 1].tolist(), strict=True)] if at else []
                hashes: list = [None] * len(found)
                for n, h in zip(compared, p.windows(w, [at[n] for n in compared], window), strict=True):
                    hashes[n] = np.unique(h)
                yield pd.DataFrame({"ph": np.array([x["ph"] for x in found], np.int64), "sh": np.array([x["sh"] for x in found], np.int64), "low": np.array([x["low"] for x in found], np.int64), "phrase": phrase, "windows": hashes})

    return run


class Shard:
    """Documents that are streamed through one automaton of confirmed phrases."""

    def __init__(self, texts: list[bytes], phrases: list[bytes]):
        self.words = [t.split() for t in texts]
        self.number = {p: n for n, p in enumerate(dict.fromkeys(phrases))}
        self.machine = ahocorasick.Automaton()
        for p, n in self.number.items():
            self.machine.add_word(f" {p.decode('latin-1')} ", n)
        if self.number:
            self.machine.make_automaton()

    def located(self, first: np.ndarray) -> np.ndarray:
        """For each word of all documents the number of the phrase that begins there, or -1."""
        out = np.full(int(first[-1]), -1, np.int64)
        if not self.number:
            return out
        for words, base in zip(self.words, first[:-1].tolist(), strict=True):
            hits = list(self.machine.iter(f" {b' '.join(words).decode('latin-1')} "))
            if hits:
                spaces = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # place of the space behind each word
                end, number = np.array(hits, np.int64).T
                out[base + np.searchsorted(spaces, end) - (PHRASE - 1)] = number
        return out


def _remove(window: int, with_text: bool, kept_columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, wanted = encoded(pdf["text"]), _rows(pdf["op6_places"])
            for i, j in chunks(texts, SHARD_BYTES):
                shard = Shard(texts[i:j], [x["phrase"] for rows in wanted[i:j] for x in rows])
                w = Words(texts[i:j])
                p = Places(w, window)
                number = shard.located(w.first)[p.lead] if len(p.lead) else p.lead
                verdict = [{(shard.number[x["phrase"]], x["sh"]): x for x in rows} for rows in wanted[i:j]]
                mark = np.zeros(len(w.hash) + 1, np.int64)
                single, bad = [], []
                for n in np.flatnonzero(number >= 0).tolist():
                    x = verdict[p.of[n]].get((int(number[n]), int(p.sh[n])))
                    if x is None:
                        continue
                    if x["whole"]:
                        mark[p.begin[n]] += 1
                        mark[p.end[n]] -= 1
                    else:
                        single.append(n)
                        bad.append(x["bad"])
                for n, b, h in zip(single, bad, p.windows(w, single, window), strict=True):
                    start = p.begin[n] + np.flatnonzero(np.isin(h, b))
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + window, -1)
                gone = np.cumsum(mark[:-1]) > 0
                lost = np.concatenate([[0], np.cumsum(gone)])[w.first]
                n_removed, sha, text = np.diff(lost), [], []
                for k, words in enumerate(shard.words):
                    if n_removed[k]:
                        words = [x for x, f in zip(words, gone[w.first[k] : w.first[k + 1]].tolist(), strict=True) if not f]
                    joined = b" ".join(words)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    text.append(joined.decode("utf-8", "replace") if n_removed[k] else None)
                part = pdf[kept_columns].iloc[i:j].assign(n_words=w.count, n_removed=n_removed, kept_sha256=sha)
                yield part.assign(kept_text=text) if with_text else part

    return run


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """n_words, n_removed, kept_sha256 (and kept_text, null where nothing was removed) for each row.

    Null and empty texts have no words, and texts of fewer than ``window`` words
    lose none.  A window goes only if it also starts under a smaller id: of equal
    texts the one of the smallest id stays whole, and rows of the same id take
    nothing from each other, be their texts equal or not.  Rows with a null id
    are kept whole and take no part.  Very long texts are handled whole, each as
    a shard of its own.  An empty table gives an empty result.  Other columns of
    ``docs`` are returned, except those named in ``OWN``.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in OWN])
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    # a row is known by its id and its text
    known = docs.where("doc_id IS NOT NULL").withColumn("op6_key", F.xxhash64("doc_id", "text"))
    found = known.select("op6_key", "doc_id", "text").mapInPandas(_emit_places(window), "ph long, sh long, op6_key long, doc_id long")
    classes = found.groupBy("ph", "sh").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by("op6_key", "doc_id").alias("op6_key"))
    phrases = classes.groupBy("ph").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("n")).where("first < last")
    recurring = written(classes.join(phrases.select("ph", (F.col("n") > 1).alias("several")), "ph"), "recurring-phrases")

    sources = recurring.groupBy("op6_key").agg(F.collect_list(F.struct("ph", "sh", "low", "several")).alias("op6_places"))
    # all columns, as in the last join below, so that Spark deals the texts out by key once for both
    passages = known.join(sources, "op6_key").mapInPandas(_confirm(window), "ph long, sh long, low long, phrase binary, windows array<bigint>")
    windows = passages.where("windows IS NOT NULL").select("ph", "sh", "low", F.explode("windows").alias("wh"))
    first = windows.groupBy("ph", "wh").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last").select("ph", "wh", "first")
    bad = windows.join(first, ["ph", "wh"]).where("low > first").groupBy("ph", "sh").agg(F.collect_set("wh").alias("bad"))
    # the third key makes Spark deal both sides of the join below out anew, so that it can split the places of a hot class
    both = F.col("ph").bitwiseXOR(F.col("sh")).alias("both")
    judged = passages.select("ph", "sh", "low", "phrase").join(bad, ["ph", "sh"], "left").select("ph", "sh", both, "low", "phrase", "bad")
    marks = found.select("ph", "sh", both, "op6_key", "doc_id").join(judged, ["ph", "sh", "both"]).where("doc_id > low OR bad IS NOT NULL")
    marks = marks.select("op6_key", F.struct("phrase", "sh", (F.col("doc_id") > F.col("low")).alias("whole"), F.when(F.col("doc_id") <= F.col("low"), F.col("bad")).alias("bad")).alias("x"))
    marks = marks.groupBy("op6_key").agg(F.collect_list("x").cast(f"array<{VERDICT}>").alias("op6_places"))

    nothing = F.lit(None).cast(f"array<{VERDICT}>").alias("op6_places")
    full = known.join(marks, "op6_key", "left").select(*docs.columns, "op6_places")
    full = full.unionByName(docs.where("doc_id IS NULL").select(*docs.columns, nothing))
    kept = [c for c in docs.columns if with_text or c != "text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in kept), "n_words long, n_removed long, kept_sha256 string", *(["kept_text string"] if with_text else [])])
    return full.mapInPandas(_remove(window, with_text, kept), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))
