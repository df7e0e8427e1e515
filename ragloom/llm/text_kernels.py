"""Vectorised word and hash kernels shared by the text operators (NumPy only, no Spark).

Words here are runs of bytes outside ASCII white space, the language
``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` splits exactly there, and
``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen lately.

    ``limit`` bounds the memory of a Python worker; the table is emptied when
    it is full, so the hashes never depend on what it holds.
    """

    def __init__(self, seed: int = 0, limit: int = 200_000):
        super().__init__()
        self._seed, self._limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self._seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """B**i and B**-i modulo 2**64, grown to the longest text seen."""

    def __init__(self):
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            with np.errstate(over="ignore"):
                for name, base in (("_up", _BASE), ("_down", _BASE_INVERSE)):
                    grown = np.full(size, base & _MASK64, np.uint64)
                    grown[0] = 1
                    setattr(self, name, np.cumprod(grown, dtype=np.uint64))
        return self._up[:n], self._down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a rolling hash counts."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
_LANES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: bytes, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words ``data[start : start + size]``, eight bytes of all of them at a time; those of equal size up to 8 never collide."""
    lanes = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    out = mix(out ^ (lanes[start] & _LANES[np.minimum(size, 8)]))
    rest, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rest):
        out[rest] = mix(out[rest] ^ (lanes[start[rest] + at] & _LANES[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for no in np.flatnonzero(size > LONG_WORD).tolist():
        out[no] = xxhash.xxh64_intdigest(data[start[no] : start[no] + size[no]], seed)
    return out


class RollingHash:
    """Hashes of any word range of one text from one prefix sum."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        n = len(hashes)
        self._up, down = powers.upto(n + 1)
        self._prefix = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * down[:n], dtype=np.uint64, out=self._prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end]; it depends on these words alone."""
        with np.errstate(over="ignore"):
            value = (self._prefix[end] - self._prefix[start]) * self._up[start]
            return mix(value + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` words, in order."""
        n = len(self._prefix) - 1
        if n < size:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            value = (self._prefix[size:] - self._prefix[: n - size + 1]) * self._up[: n - size + 1]
            return mix(value + np.uint64(size))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= size:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


_POSITION = np.uint64((1 << 24) - 1)


def winnow(grams: np.ndarray, size: int) -> np.ndarray:
    """Position of the anchor of each ``size`` consecutive grams.

    The anchor is the gram with the least hash, the first one of equals.
    Equal runs of grams therefore have their anchor at the same place.
    """
    n = len(grams)
    if n < size:
        return np.empty(0, np.int64)
    if n > int(_POSITION):  # texts of over 16 million words, piece by piece
        step = int(_POSITION) // 2
        return np.concatenate([winnow(grams[i : i + step + size - 1], size) + i for i in range(0, n - size + 1, step)])
    keyed = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
    return (sliding_min(keyed, size) & _POSITION).astype(np.int64)
