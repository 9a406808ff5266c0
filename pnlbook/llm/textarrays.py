"""Words and substring fingerprints of many texts at once, as numpy arrays.

A batch of texts is one UTF-8 byte buffer with document offsets (the layout
Arrow uses), so tokenising and hashing are a few vector passes per batch and
no Python runs per word. Words are maximal runs of bytes other than
``\\x20\\x09-\\x0D``; they never cross a document's end.

Fingerprints are polynomial: f(x) = sum T[x_k] * P**k modulo 2**64 over a table
T of random 64-bit values, finished by a bijective mixer. Prefix sums give the
fingerprint of any substring in constant time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2 ** 64 - 1, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32                      # A-Z to a-z

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n (modulo 2**64), kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 2 ** 64)):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            while done < size:                      # doubling: p[d:2d] = p[:d] * b**d
                step = min(done, size - done)
                p[done:done + step] = p[:step] * _U(pow(b, done, 2 ** 64))
                done += step
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
        if size > 1 << 23:                          # a giant text: do not keep its tables
            _POWERS.pop(base)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher (xor-shift and multiply) on unsigned 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Prefix:
    """Fingerprints of substrings of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass
class Texts:
    """``buf`` holds the texts end to end; text i is buf[at[i]:at[i + 1]]."""
    buf: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def byte_prefix(self, base: int = BASES[0], fold: bool = False) -> Prefix:
        return Prefix((_BYTE[_FOLD] if fold else _BYTE)[self.buf], base)


@dataclass
class Words:
    """Word k is buf[start[k]:end[k]]; text i has words at[i] to at[i + 1]."""
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def texts_of(col: pa.Array) -> Texts:
    """The buffers of an Arrow string or binary column; null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offs, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(buf, at - at[0])


def words_of(t: Texts) -> Words:
    n = len(t.buf)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(t.n + 1, np.int64))
    solid = ~_SPACE[t.buf]
    edge = np.zeros(n + 1, bool)
    edge[t.at] = True                    # a document starts (or the buffer ends) here
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return Words(s, np.flatnonzero(end) + 1, np.searchsorted(s, t.at))


def word_prints(t: Texts, w: Words, fold: bool = False, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit fingerprint of every word; ``fold`` lower-cases A-Z first."""
    return t.byte_prefix(base, fold).of(w.start, w.end)


def spans_cover(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Positions below n that lie in some span start <= x < end."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
