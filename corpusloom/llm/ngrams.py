"""Operator 4: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Three groupings count the corpus, each over shards dealt out by hash:

1.  words: sorted hashes with counts; a word's id is its rank;
2.  word pairs (ids, also from a text's start and to its end): sorted keys with
    counts.  Pairs are dealt out by their first word, those of very frequent
    first words by the whole pair, so that no shard is much larger than others;
3.  for each word, how many pairs begin with it (once, twice, more often) and
    how many different words it follows.

Each shard is written as plain arrays to the shared folder.  Scoring tasks map
the files into memory and look tokens up by binary search, so that the model
may be larger than memory.  Folders that cannot be mapped are fetched, one file
at a time, into an unnamed local file.
"""

from __future__ import annotations

import mmap
import os
import sys
import tempfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, chunks, encoded, mix
from .shared import crc_remainder, documents, new_path, size_of_text, small_batches

#: Bytes of input for each shard, and fewest shards.
SHARD_BYTES = 12 << 20
LEAST_SHARDS = 12
#: Entries that a task gathers before it hands them on.
FLUSH = 1_500_000
#: Texts scored at once, in bytes.
SCORE_BYTES = 1 << 20

#: Files that a worker keeps mapped; others are mapped again when they are needed.
MOST_MAPS = 512
#: Largest count of a pair in the main arrays; a count that reaches it stands in an array of its own.
MOST = (1 << 32) - 1

_U = np.uint64


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _save(folder: str, name: str, *columns: np.ndarray) -> None:
    """Writes columns one behind the other; a repeated task writes the same file again."""
    local = _local(folder)
    data = [np.array([len(columns[0])], np.int64).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)]
    if local:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.writelines(data)
        os.replace(part, f"{local}/{name}")
    else:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base)
        with system.open_output_stream(f"{base}/{name}") as f:
            for d in data:
                f.write(d)


def _mapped(folder: str, name: str, *kinds) -> list[np.ndarray]:
    """The columns of a file, mapped into memory."""
    local = _local(folder)
    if local:
        f = open(f"{local}/{name}", "rb")
    else:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        f = tempfile.TemporaryFile()
        with system.open_input_stream(f"{base}/{name}") as source:
            while block := source.read(8 << 20):
                f.write(block)
        f.flush()
    with f:  # the map needs the file no longer, and no descriptor of it
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [], 8
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class Files:
    """Files of a model as they are asked for; no more than ``MOST_MAPS`` of them stay mapped, those used last."""

    def __init__(self, folder: str):
        self.folder = folder
        self.kept: OrderedDict[str, list[np.ndarray]] = OrderedDict()

    def get(self, name: str, *kinds) -> list[np.ndarray]:
        if name not in self.kept:
            self.kept[name] = _mapped(self.folder, name, *kinds)
        self.kept.move_to_end(name)
        while len(self.kept) > MOST_MAPS:
            self.kept.popitem(last=False)
        return self.kept[name]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with their values summed."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(fresh)
    return (keys[at], *(np.add.reduceat(v[order].astype(np.int64), at) if len(at) else v.astype(np.int64) for v in values))


class Gathered:
    """Keys with counts that a task has seen, handed on in shards."""

    def __init__(self, shards: int, shard_of, key=np.uint64):
        self.shards, self.shard_of, self.key = shards, shard_of, key
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def rows(self) -> pd.DataFrame:
        if self.parts:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        else:
            keys, counts = np.zeros(0, self.key), np.zeros(0, np.int64)
        self.parts, self.size = [], 0
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        own = [order[cut[i] : cut[i + 1]] for i in range(self.shards)]
        live = [i for i in range(self.shards) if len(own[i])]
        return pd.DataFrame({"shard": np.array(live, np.int32), "keys": [keys[own[i]].tobytes() for i in live], "counts": [counts[own[i]].astype(np.uint32).tobytes() for i in live]})


BLOBS = "shard int, keys binary, counts binary"


def _joined(pdf: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), kind)


class Layout:
    """Where the model lies and what the driver knows of it: numbers only, and the bounded list of hot words."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.sizes = [0] * shards  # words of each shard
        self.tokens = self.docs = self.pairs = 0
        self.hot = np.zeros(0, np.int64)
        self.discount = self.low_discount = (0.5, 1.0, 1.5)
        self.low_left = 0.0
        self.most = MOST

    @property
    def words(self) -> int:
        return sum(self.sizes)

    @property
    def total(self) -> int:
        """Tokens of the training texts, ends included."""
        return self.tokens + self.docs

    @property
    def distinct(self) -> int:
        return self.words + (1 if self.docs else 0)

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _U(32)) * _U(self.shards) >> _U(32)).astype(np.int64)

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        lead = keys >> _U(32)
        seed = np.where(np.isin(lead.astype(np.int64), self.hot), keys, lead)
        return (mix(seed) % _U(self.shards)).astype(np.int64)


class Reader:
    """The mapped files of a model."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.base = np.concatenate([[0], np.cumsum(layout.sizes)])
        self.files = Files(layout.folder)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        known, back = np.unique(hashes, return_inverse=True)
        shard = self.layout.word_shard(known)
        cut = np.searchsorted(shard, np.arange(self.layout.shards + 1))
        out, count = np.full(len(known), -1, np.int64), np.zeros(len(known), np.int64)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            a, z = cut[i], cut[i + 1]
            if self.layout.sizes[i]:
                file = self.files.get(f"words-{i}", np.uint64, np.int64)
                at = np.minimum(np.searchsorted(file[0], known[a:z]), len(file[0]) - 1)
                hit = file[0][at] == known[a:z]
                out[a:z] = np.where(hit, at + self.base[i], -1)
                count[a:z] = np.where(hit, file[1][at], 0)
        return out[back], count[back]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        shard = self.layout.pair_shard(keys)
        order = np.lexsort((keys, shard))
        cut = np.searchsorted(shard[order], np.arange(self.layout.shards + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[i] : cut[i + 1]]
            file = self.files.get(f"pairs-{i}", np.uint64, np.uint32)
            if len(file[0]):
                at = np.minimum(np.searchsorted(file[0], keys[own]), len(file[0]) - 1)
                out[own] = np.where(file[0][at] == keys[own], file[1][at], 0)
                more = own[out[own] == self.layout.most]
                if len(more):
                    large = self.files.get(f"large-{i}", np.uint64, np.int64)
                    out[more] = large[1][np.searchsorted(large[0], keys[more])]
        return out

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """Pairs that begin with each id once, twice, more often; different words before it (4 columns)."""
        known, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(known), 4), np.int64)
        bounds = np.concatenate([self.base[:-1], [self.base[-1] + 2]])
        cut = np.searchsorted(known, bounds)  # ids ascend
        for i in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[i], cut[i + 1])
            file = self.files.get(f"stats-{i}", *[np.uint32] * 4)
            at = known[own] - bounds[i]
            for c in range(4):
                out[own, c] = file[c][at]
        return out[back]


@lru_cache(maxsize=1)
def _reader(folder: str, data: bytes) -> Reader:
    import pickle

    return Reader(pickle.loads(data))


def _open(layout: Layout) -> Reader:
    import pickle

    return _reader(layout.folder, pickle.dumps(layout))


def _pairs_of(w: Words, reader: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token (words, then the end of each text): previous id, own id, count, text, whether it is an end."""
    ids, counts = reader.ids(w.hash)
    n = len(w.count)
    layout = reader.layout
    end, start = layout.words, layout.words + 1
    ends = w.first[1:] + np.arange(n)
    at = np.arange(len(w.hash)) + w.owner()
    own = np.full(len(w.hash) + n, end, np.int64)
    own[at] = ids
    count = np.full(len(own), layout.docs, np.int64)
    count[at] = counts
    previous = np.concatenate([[start], own[:-1]])
    previous[np.concatenate([[0], ends[:-1] + 1])[:n]] = start
    text = np.repeat(np.arange(n), w.count + 1)
    is_end = np.zeros(len(own), bool)
    is_end[ends] = True
    return previous, own, count, text, is_end


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of things seen 1, 2, 3 and 4 times; each lies between 0 and its count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if n1 <= 0 or n2 <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 > 0 else 1.5
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def _less(count: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    d = np.array([0.0, *discount])
    return np.maximum(count - d[np.minimum(count, 3)], 0.0)


def fit(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Layout:
    """Counts a model over the text of ``docs``; null texts are empty and still have an end.

    Repeated rows count each time, whatever their ids; whole texts are counted,
    however long.  An empty table gives a model that knows no word.  More than
    2**32 - 2 different words are an error; counts have no limit.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = max(LEAST_SHARDS, -(-size_of_text(docs) // shard_bytes))
    layout = Layout(new_path(spark, "ngrams"), shards)
    texts = docs.select("text")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n_docs = Gathered(shards, layout.word_shard), 0
        for pdf in batches:
            raw = encoded(pdf["text"])
            n_docs += len(raw)
            for a, z in chunks(raw):
                g.add(*np.unique(Words(raw[a:z], lower=True).hash, return_counts=True))
                if g.size > FLUSH:
                    yield g.rows()
        yield g.rows()
        yield pd.DataFrame({"shard": np.array([-1], np.int32), "keys": [b""], "counts": [np.array([n_docs], np.uint32).tobytes()]})

    def keep_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        if shard < 0:
            return pd.DataFrame({"shard": [shard], "n": [0], "total": [int(_joined(pdf, "counts", np.uint32).sum(dtype=np.int64))], "top": [[]]})
        keys, counts = _summed(_joined(pdf, "keys", np.uint64), _joined(pdf, "counts", np.uint32))
        _save(layout.folder, f"words-{shard}", keys, counts)
        top = np.argsort(-counts, kind="stable")[:8]
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())], "top": [[{"at": int(i), "c": int(counts[i])} for i in top]]})

    # texts of a task make one row a shard; the groups are the shards
    found = texts.mapInPandas(words, BLOBS).groupBy("shard").applyInPandas(keep_words, "shard int, n long, total long, top array<struct<at:long,c:long>>").collect()
    top = []
    for r in found:
        if r["shard"] < 0:
            layout.docs = r["total"]
        else:
            layout.sizes[r["shard"]] = r["n"]
            layout.tokens += r["total"]
            top += [(r["shard"], t["at"], t["c"]) for t in r["top"]]
    if layout.words + 2 > 1 << 32:
        raise ValueError(f"{layout.words} different words: ids of words must fit in 32 bits")
    base = np.concatenate([[0], np.cumsum(layout.sizes)])
    # at most 4 * shards words can be this frequent, and eight are looked at in each shard
    hot = [base[s] + at for s, at, c in top if c * 4 * shards > layout.tokens]
    layout.hot = np.array([*hot, layout.words + 1], np.int64)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _open(layout)
        g = Gathered(shards, layout.pair_shard)
        for pdf in batches:
            raw = encoded(pdf["text"])
            for a, z in chunks(raw):
                previous, own, _, _, _ = _pairs_of(Words(raw[a:z], lower=True), reader)
                g.add(*np.unique(previous.astype(np.uint64) << _U(32) | own.astype(np.uint64), return_counts=True))
                if g.size > FLUSH:
                    yield g.rows()
        yield g.rows()

    bounds = np.concatenate([base[:-1], [base[-1] + 2]])  # the last shard also has the ids of end and start

    def keep_pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(_joined(pdf, "keys", np.uint64), _joined(pdf, "counts", np.uint32))
        large = counts >= layout.most
        _save(layout.folder, f"pairs-{int(key[0])}", keys, np.minimum(counts, layout.most).astype(np.uint32))
        _save(layout.folder, f"large-{int(key[0])}", keys[large], counts[large])
        lead, follow = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
        kind = np.minimum(counts, 3) - 1
        ids = np.concatenate([lead * 4 + kind, follow * 4 + 3])
        ids, n = np.unique(ids, return_counts=True)
        cut = np.searchsorted(ids, bounds * 4)
        live = [i for i in range(shards) if cut[i + 1] > cut[i]]
        seen = [int((counts == c).sum()) for c in (1, 2, 3, 4)]
        return pd.DataFrame({"shard": np.array([*live, -1], np.int32), "keys": [*((ids[cut[i] : cut[i + 1]] - bounds[i] * 4).astype(np.uint32).tobytes() for i in live), b""], "counts": [*(n[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in live), np.array([*seen, len(keys)], np.uint64).tobytes()]})

    def keep_stats(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        if shard < 0:
            return pd.DataFrame({"shard": [shard], "n": [np.frombuffer(b"".join(pdf["counts"]), np.uint64).reshape(-1, 5).sum(axis=0).astype(np.int64).tolist()]})
        size = int(bounds[shard + 1] - bounds[shard])
        table = np.bincount(_joined(pdf, "keys", np.uint32), weights=_joined(pdf, "counts", np.uint32), minlength=size * 4).astype(np.uint32).reshape(size, 4)
        _save(layout.folder, f"stats-{shard}", *table.T)
        after = table[:, 3]
        return pd.DataFrame({"shard": [shard], "n": [[int((after == c).sum()) for c in (1, 2, 3, 4)] + [int((after > 0).sum())]]})

    every = spark.createDataFrame([(i, b"", b"") for i in range(shards)], BLOBS)  # so that each shard has its file
    counted = texts.mapInPandas(pairs, BLOBS).unionByName(every).groupBy("shard").applyInPandas(keep_pairs, BLOBS)
    low = np.zeros(5, np.int64)
    for r in counted.unionByName(every).groupBy("shard").applyInPandas(keep_stats, "shard int, n array<long>").collect():
        if r["shard"] < 0:
            layout.discount, layout.pairs = _discounts(r["n"][:4]), r["n"][4]
        else:
            low += np.array(r["n"])
    layout.low_discount = d = _discounts(low[:4])
    layout.low_left = (d[0] * low[0] + d[1] * low[1] + d[2] * (low[4] - low[0] - low[1])) / max(layout.pairs, 1)
    return layout


def probabilities(layout: Layout, reader: Reader, previous: np.ndarray, own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The model's probability of each token behind the previous one; ``seen``: how often the previous one is followed by something."""
    end_after = reader.stats(np.maximum(own, 0))
    after = np.where(own >= 0, end_after[:, 3], 0)
    low = _less(after, layout.low_discount) / max(layout.pairs, 1) + layout.low_left / (layout.distinct + 1)
    if not layout.pairs:
        low = np.full(len(own), 1.0 / (layout.distinct + 1))
    known = (previous >= 0) & (seen > 0)
    both = known & (own >= 0)
    count = np.zeros(len(own), np.int64)
    count[both] = reader.pair_counts(previous[both].astype(np.uint64) << _U(32) | own[both].astype(np.uint64))
    begins = reader.stats(np.maximum(previous, 0))
    back = begins[:, :3] @ np.array(layout.discount)
    total = np.maximum(seen, 1)
    return np.where(known, _less(count, layout.discount) / total + back / total * low, low)


def score(docs: DataFrame, layout: Layout) -> DataFrame:
    """Columns of ``docs`` but text, with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    A null or empty text has one token, its end.  Equal texts have equal scores,
    so repeated rows give repeated results; an empty table gives an empty one.
    Columns of the names above are replaced, others returned as they are.  The
    perplexity of a token that is less likely than 1e-300 is shown as 1e300.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*own).dtypes), "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _open(layout)
        for pdf in batches:
            raw = encoded(pdf["text"])
            for a, z in chunks(raw, SCORE_BYTES):
                previous, ids, count, text, _ = _pairs_of(Words(raw[a:z], lower=True), reader)
                start = layout.words + 1
                seen = np.concatenate([[layout.docs], count[:-1]])
                seen[previous == start] = layout.docs
                p = probabilities(layout, reader, previous, ids, seen)
                n = np.bincount(text, minlength=z - a)
                total = np.bincount(text, weights=np.log10(p), minlength=z - a)
                yield pdf[own].iloc[a:z].assign(
                    n_tokens=n,
                    n_known=np.bincount(text, weights=count > 0, minlength=z - a).astype(np.int64),
                    train_tokens=layout.total,
                    base_score=np.bincount(text, weights=np.log10((count + 1) / (layout.total + layout.distinct + 1)), minlength=z - a),
                    score=total,
                    perplexity=np.power(10.0, np.minimum(-total / n, 300.0)),
                )

    return docs.select(*own, "text").mapInPandas(run, schema)


def in_training(doc_id: object, modulus: int = 7, remainder: int = 2) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus != remainder


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_remainder("doc_id", 7) == 2
    layout = fit(docs.where(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), layout)
