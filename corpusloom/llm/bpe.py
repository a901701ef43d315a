"""Operator 5: byte-level BPE encoding and decoding by speculation and verification.

The pieces of a text (words with their leading space, and the like) are looked
up in a bounded memory of each worker.  New pieces are encoded together:

*speculate*: a compact trie is walked for all of them in step,
which proposes the longest token at each place;
*verify*: the proposal is the BPE encoding exactly if each token encodes to
itself and each two neighbours encode to themselves when joined.  Neighbours are
looked up in a sorted table; those not seen before are merged once.
Only pieces that fail are merged exactly, rank by rank.  A piece longer than
``LONGEST`` is merged exactly at once.

What a worker remembers is bounded by ``MEMORY`` pieces and as many pairs and
forgotten as a whole beyond it, so a worker stays under about 200 MB.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, small_batches

#: Characters of text that are encoded together.
CHUNK_CHARS = 2_000_000
#: Pieces, and pairs of tokens, that a worker remembers; and the longest piece, in bytes, that is proposed token by token.
MEMORY = 250_000
LONGEST = 256


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones as they are, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Seen(dict):
    """Number of each piece; new pieces are numbered as they come."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            vocab.pop(self.bytes[i], None)
            self.bytes[i] = t.encode()
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = (bytes(letters[c] for c in t) for t in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank.setdefault((vocab[a], vocab[b]), len(self.result))
            self.result.append(vocab[a + b])
        self._trie(vocab)
        self.valid = np.full(len(self.bytes), -1, np.int8)  # whether a token encodes to itself
        self.forget()

    def _trie(self, vocab: dict[bytes, int]) -> None:
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for t, i in vocab.items():
            node = 0
            for b in t:
                to = child[node].get(b)
                if to is None:
                    to = child[node][b] = len(child)
                    child.append({})
                    token.append(-1)
                node = to
            token[node] = i
        # a node with one child keeps its byte; the others have rows in a table
        n = len(child)
        self.byte, self.only, self.row = np.full(n, -1, np.int16), np.zeros(n, np.int32), np.zeros(n, np.int32)
        several = [node for node, out in enumerate(child) if len(out) > 1]
        self.next = np.zeros((len(several) + 1) * 256, np.int32)  # 0: none; the root is no child
        for k, node in enumerate(several):
            self.row[node] = (k + 1) * 256
            self.next[self.row[node] + np.array(list(child[node]))] = list(child[node].values())
        for node, out in enumerate(child):
            if len(out) == 1:
                ((self.byte[node], self.only[node]),) = out.items()
        self.token = np.array(token, np.int32)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node behind a byte, or 0."""
        return np.where(self.byte[node] == byte, self.only[node], self.next[self.row[node] + byte])

    def forget(self) -> None:
        self.seen = _Seen()
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.bytes) <= 65536 else np.int32)
        self.first = np.zeros(1 << 16, np.int64)  # ids of piece n: first[n]:first[n + 1]
        self.pairs = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)

    def exact(self, piece: bytes) -> list[int]:
        """Merges a piece, lowest rank first, leftmost first."""
        ids = [self.single[b] for b in piece]
        if len(ids) > 200:
            return self._exact_long(ids)
        rank, result, none = self.rank.get, self.result, len(self.result)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at] = result[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for long pieces."""
        import heapq

        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (rank := self.rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.result[rank], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def _propose(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, token) of the longest-match proposal, in order."""
        of, tokens = [], []
        piece = np.flatnonzero(begin < end)
        at = begin[piece]
        while len(piece):
            best, size = np.full(len(piece), -1, np.int32), np.zeros(len(piece), np.int64)
            live, node, depth = np.arange(len(piece)), np.zeros(len(piece), np.int64), 0
            while len(live):
                node = self._child(node, flat[at[live] + depth])
                depth += 1
                go = node > 0
                live, node = live[go], node[go]
                got = self.token[node]
                hit = got >= 0
                best[live[hit]] = got[hit]
                size[live[hit]] = depth
                go = at[live] + depth < end[piece[live]]
                live, node = live[go], node[go]
            of.append(piece)
            tokens.append(best)
            at = at + size
            more = at < end[piece]
            piece, at = piece[more], at[more]
        if not of:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        of, tokens = np.concatenate(of), np.concatenate(tokens)
        order = np.argsort(of, kind="stable")
        return of[order], tokens[order]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two neighbours encode to themselves when joined."""
        keys = a.astype(np.int64) << 20 | b
        new = np.unique(keys)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, new), len(self.pairs) - 1)
            new = new[self.pairs[at] != new]
        if len(new):
            fits = np.fromiter((self.exact(self.bytes[k >> 20] + self.bytes[k & 0xFFFFF]) == [k >> 20, k & 0xFFFFF] for k in new.tolist()), bool, len(new))
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs)
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits])[order]
        return self.fits[np.searchsorted(self.pairs, keys)]

    def _learn(self) -> None:
        """Encodes the pieces that came since the last time."""
        fresh = self.seen.fresh
        if not fresh:
            return
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(sizes)
        bad = sizes > LONGEST
        of, tokens = self._propose(np.frombuffer(b"".join(raw), np.uint8), end - sizes, np.where(bad, end - sizes, end))
        unknown = np.unique(tokens)
        unknown = unknown[self.valid[unknown] < 0]
        for t in unknown.tolist():
            self.valid[t] = self.exact(self.bytes[t]) == [t]
        bad[of[self.valid[tokens] == 0]] = True
        near = np.flatnonzero(of[1:] == of[:-1])
        if len(near):
            bad[of[near[~self._compatible(tokens[near], tokens[near + 1])]]] = True
        counts = np.bincount(of, minlength=len(raw))
        failed = np.flatnonzero(bad)
        merged = [self.exact(raw[i]) for i in failed.tolist()]
        self.failed = len(failed)
        final = counts.copy()
        final[failed] = [len(m) for m in merged]
        start = np.concatenate([[0], np.cumsum(final)])
        out = np.zeros(start[-1], self.ids.dtype)
        good = ~bad[of]
        out[np.repeat(start[:-1], counts)[good] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts))[good]] = tokens[good]
        for i, m in zip(failed.tolist(), merged, strict=True):
            out[start[i] : start[i + 1]] = m
        known = len(self.seen) - len(fresh)
        used = self.first[known]
        while len(self.first) <= len(self.seen):
            self.first = np.concatenate([self.first, np.zeros(len(self.first), np.int64)])
        while len(self.ids) < used + len(out):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.ids.dtype)])
        self.first[known + 1 : len(self.seen) + 1] = used + start[1:]
        self.ids[used : used + len(out)] = out
        self.seen.fresh = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them without special tokens added."""
        if max(len(self.seen), len(self.pairs)) > MEMORY:
            self.forget()
        pieces: list[str] = []
        cuts, marks = [0], {}
        for text in texts:
            if self.split_special and any(s in text for s in self.special):
                at = 0
                for m in self.split_special.finditer(text):
                    pieces += self.pattern.findall(text[at : m.start()])
                    marks[len(pieces)] = self.special[m[0]]
                    pieces.append("")
                    at = m.end()
                pieces += self.pattern.findall(text[at:])
            else:
                pieces += self.pattern.findall(text)
            cuts.append(len(pieces))
        numbers = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        begin = self.first[numbers]
        sizes = self.first[numbers + 1] - begin
        ends = np.cumsum(sizes)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)]
        bounds = np.concatenate([[0], ends])[np.array(cuts)]
        out = [flat[a:b].astype(np.uint32) for a, b in zip(bounds, bounds[1:], strict=False)]
        if marks:
            places = np.array(sorted(marks))
            for t in range(len(texts)):
                own = places[(places >= cuts[t]) & (places < cuts[t + 1])]
                if len(own):
                    inside = np.concatenate([[0], ends])[own] - bounds[t]
                    out[t] = np.insert(out[t], inside, [marks[int(i)] for i in own])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_batches(pdf: pd.DataFrame, path: str) -> Iterator[tuple[int, int, list[str], list[np.ndarray]]]:
    coder = codec(path)
    texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
    begin = total = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or total and total + len(texts[i]) > CHUNK_CHARS:
            if i > begin:
                yield begin, i, texts[begin:i], coder.encode(texts[begin:i])
            begin, total = i, 0
        total += len(texts[i]) if i < len(texts) else 0


def roundtrip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Columns of ``docs`` but text, with n_tokens, ids_sha256, decoded_sha256 (and ids array<int>).

    A null text is encoded as an empty one, which has no ids; its digests are
    those of nothing.  Texts of any length are encoded whole.  Equal texts have
    equal ids, so repeated rows give repeated results; an empty table gives an
    empty one.  Columns of the names above are replaced, others returned as
    they are.  ``path`` names the vocabulary file, which every worker must be
    able to open.  Where two merges of equal rank apply, the left one is taken.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*own).dtypes), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if with_ids else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, z, _, ids in encoded_batches(pdf, path):
                coder = codec(path)
                part = pdf[own].iloc[a:z].assign(
                    n_tokens=[len(x) for x in ids],
                    ids_sha256=[hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    decoded_sha256=[hashlib.sha256(coder.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids],
                )
                yield part.assign(ids=[x.astype(np.int32) for x in ids]) if with_ids else part

    return docs.select(*own, "text").mapInPandas(run, schema)


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(documents(spark, sf_dir).select("doc_id", "text"))
