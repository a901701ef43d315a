"""Vectorised text helpers used inside Spark tasks.

Texts are joined into one byte buffer and cut into words, hashed and compared
with numpy, so that a task never loops over single words in Python.  A word is
a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``, or other than
``MARKS``; in UTF-8 these bytes never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are handled at once inside a task.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside of words made of letters, digits and all characters beyond ASCII.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` for each pair, in linear time."""
    pow_, inv = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pow_[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of several texts: ``hash[i]`` of each word; words of text ``t`` are ``first[t]:first[t + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False, gaps: np.ndarray = _SPACE):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = joined
        if lower:
            joined = _LOWER[joined]
        self.buffer = joined
        edge = np.diff((~gaps[joined]).view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = span_hashes(_BYTES[joined], self.start, self.end)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, position, text) of each run of ``k`` words inside one text."""
        at, of = runs(self.first, k)
        return span_hashes(self.hash, at, at + k), at, of


def runs(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of each run of ``k`` items that stays inside one text."""
    n = np.maximum(np.diff(first) - (k - 1), 0)
    of = np.repeat(np.arange(len(n)), n)
    skipped = first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.arange(int(n.sum())) + np.repeat(skipped, n), of


def encoded(texts: Iterable) -> list[bytes]:
    """UTF-8 of each text; a missing text counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's BIGINT."""
    return x.view(np.int64)
