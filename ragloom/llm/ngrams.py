"""Streams of hashed tokens and their n-grams for the operators that count them (NumPy only, no Spark).

A stream is cut into chunks of bounded size wherever that falls; the last tokens of a chunk come first in the next
one, so no n-gram is lost or counted twice, and no text needs to fit into a chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .text_kernels import mix

_SPACE = re.compile(rb"[\x20\x09-\x0D]").search
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(text: bytes, cut=_SPACE, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut where ``cut`` finds a separator."""
    at = 0
    while at < len(text):
        found = cut(text, at + size) if len(text) - at > size else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _joined(parts: list) -> np.ndarray | list:
    return list(chain.from_iterable(parts)) if isinstance(parts[0], list) else np.concatenate(parts)


def chunks(pieces: Iterator[tuple], overlap: int, size: int = 1 << 20) -> Iterator[tuple]:
    """Consecutive pieces, tuples of columns (arrays or lists, one item a token), joined to chunks of about ``size`` tokens: the
    chunk's columns, and how many of its first tokens are the last ``overlap`` ones of the chunk before."""
    kept, n, fresh = [], 0, 0
    for piece in pieces:
        kept.append(piece)
        n += len(piece[0])
        if n >= size + fresh:
            whole = [_joined(column) for column in zip(*kept, strict=True)]
            yield (*whole, fresh)
            fresh = min(overlap, n)
            kept, n = [tuple(column[n - fresh :] for column in whole)], fresh
    if n > fresh:
        yield (*[_joined(column) for column in zip(*kept, strict=True)], fresh)


def gram_keys(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """64-bit keys of the n-grams of 1 to ``order`` tokens by their first place; a token is its own key."""
    keys = [tokens]
    with np.errstate(over="ignore"):
        for k in range(1, order):
            before = keys[-1][: max(0, len(tokens) - k)]
            keys.append(mix(before * _STEP + tokens[k:] + np.uint64(k)))
    return keys
