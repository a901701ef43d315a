"""Operator 10: language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed against it: the longest run of letters that occurs in
the sample is a phrase, and the next phrase begins behind it.  A language whose
sample holds long matches needs few phrases; phrases are normalised by the
letters read and by the log of the sample's size, and the fewest wins.

The automata have at most ``2 * SAMPLE_CHARS`` states and ``3 * SAMPLE_CHARS``
transitions a language, whatever its alphabet.  Most states have one transition,
which is stored as such; the others are rows of a table while a language's table
fits in ``DENSE_BYTES``, else all are a sorted list of transitions.  Both forms
give the same phrases and take a few MB a language.  Every letter of the samples
has its own code, and every labelled language is learned.

Inside a task many pieces of text are parsed in step with numpy.  A piece is
first parsed as if a phrase began at its first letter; then the phrase that the
piece before it left open is carried on into it until both parses begin a phrase
at the same letter, from where they agree.  So the phrases of a text are those of
one parse from its first to its last letter, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import crc_remainder, documents, small_batches

#: Bound of the labelled text of each language, in characters, and of the documents that it is taken from.
SAMPLE_CHARS = 24_000
SAMPLE_DOCS = 48
#: Lengths of documents that are sampled first; others only where a language has too few.
SAMPLE_LENGTHS = (300, 6_000)
#: The table of one language's automaton takes no more than this; beyond it transitions are a list.
DENSE_BYTES = 16 << 20
#: Letters of a piece that is parsed in step with others.
PIECE = 400
BATCH_CHARS = 3_000_000
UNKNOWN = "und"


def _alphabet(samples: dict[str, str]) -> np.ndarray:
    """Code of each character: 0 is white space or anything that is no letter, 1 a letter of no sample."""
    codes = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint32, 0x110000)
    letters = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
    for i, c in enumerate(letters):
        codes[ord(c)] = i + 2
    for i, c in enumerate(letters):
        if len(c.upper()) == 1 and c.upper() != c:
            codes[ord(c.upper())] = i + 2
    return codes.astype(np.min_scalar_type(len(letters) + 1))


def coded(text: str, codes: np.ndarray) -> np.ndarray:
    """The text's codes, each run of non-letters as one 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = codes[points]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def automaton(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Transitions (state, code, next state) of the suffix automaton of ``sequence``, sorted, and its number of states."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in sequence.tolist():
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = state
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    moves = np.array([(s, c, to) for s, out in enumerate(nexts) for c, to in sorted(out.items())], np.int64).reshape(-1, 3)
    return moves[:, 0], moves[:, 1], moves[:, 2], len(nexts)


class Dense:
    """States with one transition keep it; the others have rows in a table.  -1 where there is none, as behind state ``n``."""

    def __init__(self, state: np.ndarray, code: np.ndarray, to: np.ndarray, n: int, width: int):
        self.width = width
        out = np.bincount(state, minlength=n + 1)
        one = out[state] == 1
        self.code, self.to, self.row = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        self.code[state[one]], self.to[state[one]] = code[one], to[one]
        several = np.flatnonzero(out > 1)
        self.row[several] = (np.arange(len(several)) + 1) * width
        self.table = np.full((len(several) + 1) * width, -1, np.int32)
        self.table[self.row[state[~one]] + code[~one]] = to[~one]

    @staticmethod
    def size(state: np.ndarray, n: int, width: int) -> int:
        return 4 * width * int((np.bincount(state, minlength=n) > 1).sum() + 1)

    def step(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.where(self.code[at] == code, self.to[at], self.table[self.row[at] + code])


class Listed:
    """Transitions in ascending order, found by bisection; -1 where there is none."""

    def __init__(self, state: np.ndarray, code: np.ndarray, to: np.ndarray, n: int, width: int):
        self.width = width
        self.keys = np.append(state * width + code, np.iinfo(np.int64).max)
        self.to = np.append(to, -1).astype(np.int32)

    def step(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        keys = at.astype(np.int64) * self.width + code
        i = np.searchsorted(self.keys, keys)
        return np.where(self.keys[i] == keys, self.to[i], np.int32(-1))


class Pieces:
    """Texts as codes, cut into pieces of at most ``PIECE``."""

    def __init__(self, sequences: list[np.ndarray], kind: np.dtype):
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        n = (self.sizes + PIECE - 1) // PIECE
        self.flat = np.concatenate([*sequences, np.zeros(1, kind)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        owner = np.repeat(np.arange(len(sequences)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        self.begin = self.starts[:-1][owner] + nth * PIECE
        self.length = np.minimum(self.sizes[owner] - nth * PIECE, PIECE)
        self.order = np.argsort(-self.length, kind="stable")
        self.later = np.flatnonzero(nth > 0)

    def phrases(self, table: Dense | Listed, nowhere: int) -> np.ndarray:
        """Where phrases begin: one flag for each code of ``flat``."""
        begins = np.zeros(len(self.flat), bool)
        end = np.full(len(self.begin), nowhere, np.int32)
        codes = np.arange(table.width)
        start = table.step(np.zeros(table.width, np.int32), codes)
        start[start < 0] = nowhere  # a code that no sample has is a phrase of its own

        # each piece by itself, the longest first
        length, begin = self.length[self.order], self.begin[self.order]
        at = np.full(len(begin), nowhere, np.int32)
        for step, m in enumerate(np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")):  # m pieces are longer than the step
            c = self.flat[begin[:m] + step]
            to = table.step(at[:m], c)
            lost = np.flatnonzero(to < 0)
            begins[begin[lost] + step] = True
            to[lost] = start[c[lost]]
            at[:m] = to
        end[self.order] = at
        # phrases that run on from the piece before
        used = np.full(len(end), nowhere, np.int32)
        while len(live := self.later[end[self.later - 1] != used[self.later]]):
            at = used[live] = end[live - 1]
            place, last = self.begin[live], self.begin[live] + self.length[live] - 1
            while len(live):
                c = self.flat[place]
                to = table.step(at, c)
                lost = to < 0
                to = np.where(lost, start[c], to)
                met = lost & begins[place]  # from here on both parses agree
                begins[place] = lost
                over = (place == last) & ~met
                if over.any():
                    end[live[over]] = to[over]
                go = np.flatnonzero(~(met | over))
                live, at, place, last = live[go], to[go], place[go] + 1, last[go]
        return begins


class Model:
    """Languages, alphabet and one automaton each; small enough to broadcast."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.codes = _alphabet(samples)
        self.width = int(self.codes.max()) + 1
        sequences = [coded(samples[lang], self.codes) for lang in self.languages]
        moves = [automaton(s) for s in sequences]
        self.nowhere = [m[3] for m in moves]
        self.tables = [(Dense if Dense.size(m[0], m[3], self.width) <= DENSE_BYTES else Listed)(*m, self.width) for m in moves]
        self.norm = [float(np.log2(max(len(s), 2))) for s in sequences]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases needed in each language, codes read) of each text."""
        pieces = Pieces([coded(t, self.codes) for t in texts], self.codes.dtype)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, (table, nowhere) in enumerate(zip(self.tables, self.nowhere, strict=True)):
            counts[:, k] = np.diff(np.searchsorted(np.flatnonzero(pieces.phrases(table, nowhere)), pieces.starts))
        return counts, pieces.sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lettered = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in texts], bool)
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(lettered)
        if len(at) and self.languages:
            counts, sizes = self.phrases([texts[i] for i in at])
            rate = counts * np.array(self.norm) / np.maximum(sizes, 1)[:, None]
            best = rate.argmin(axis=1)
            share = np.exp2(-(rate - rate.min(axis=1, keepdims=True)) * 4)
            for i, b, s in zip(at, best, (1 / share.sum(axis=1)), strict=True):
                out[i], score[i] = self.languages[b], s
        return out, score


def learn(docs: DataFrame) -> Model:
    """A model of every non-null lang of the given rows, from their texts.

    At most ``SAMPLE_DOCS`` documents of each language, those with the smallest
    hashes, and the first ``SAMPLE_CHARS`` characters of each come to the
    driver, which joins them up to ``SAMPLE_CHARS``.  Rows without text or lang
    are left out; equal texts of a language are used once; documents of equal
    hashes have equal texts.  Without any such row the model knows no language.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    fits = F.length("text").between(*SAMPLE_LENGTHS)
    ranked = rows.select(F.col("lang").cast("string").alias("lang"), F.substring("text", 1, SAMPLE_CHARS).alias("text"), fits.alias("fits"), F.xxhash64("text").alias("h"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("fits"), "h")))
    samples: dict[str, str] = {}
    seen: set[tuple[str, str]] = set()
    for lang, _, text in ranked.where(F.col("n") <= SAMPLE_DOCS).select("lang", "n", "text").orderBy("lang", "n").toLocalIterator():
        if (lang, text) not in seen and len(samples.get(lang, "")) < SAMPLE_CHARS:
            seen.add((lang, text))
            samples[lang] = samples.get(lang, "") + "\n" + text
    return Model({k: v[:SAMPLE_CHARS] for k, v in samples.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (columns of these names are replaced).

    ``und`` with score 0 if the text is null, empty or has no letter, or if the
    model knows no language.  Of languages that need equally many phrases the
    first in order of their names is taken.  Repeated rows give repeated
    results, an empty table an empty one; texts of any length are parsed whole.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*own).dtypes), "lang_pred string", "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            begin = total = 0
            sizes = [len(t) if isinstance(t, str) else 0 for t in pdf["text"]]
            for i in range(len(sizes) + 1):
                if i == len(sizes) or total and total + sizes[i] > BATCH_CHARS:
                    part = pdf.iloc[begin:i]
                    lang, score = shared.value.predict(list(part["text"]))
                    yield part.assign(lang_pred=lang, score=score)
                    begin, total = i, 0
                total += sizes[i] if i < len(sizes) else 0

    return docs.select(*own).mapInPandas(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", 4) == 2
    model = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
