"""The tokens of ``retrieval.tokens`` over Arrow columns: found on the bytes of many texts at once, without a row or a list for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked through at once; a longer text is looked through by itself.
SLICE_BYTES = 1 << 23
_SIGNS = np.zeros(256, bool)
_SIGNS[ord("0") : ord("9") + 1] = _SIGNS[ord("a") : ord("z") + 1] = True


def token_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """``(first row, tokens in each row, all of them in order)`` of consecutive rows of lower-cased texts, null ones as empty."""
    for start, data, offsets in text_slices(texts):
        yield start, *_tokens(data, offsets)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, where each row begins and the last ends)`` of consecutive rows of ``most`` bytes, null ones as empty."""
    held = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    _, offsets, data = held.buffers()
    offsets = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(held):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def is_lead(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a Han sign, which is three bytes, U+4E00 to U+9FFF."""
    lead = (data >= 0xE4) & (data <= 0xE9)
    at = np.flatnonzero(data == 0xE4)
    lead[at] = data[at + 1] >= 0xB8
    return lead


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    kept = _SIGNS[data]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = kept[first]  # a text doesn't go on with the one before
    lead = np.flatnonzero(is_lead(data))  # each a token of its own
    if len(lead):
        begins[lead] = True
        for i in range(3):
            kept[lead + i] = True
    size = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    told = data[kept]
    ends = np.append(np.flatnonzero(begins[kept]), len(told))
    kind, number = (pa.string(), np.int32) if len(told) < 1 << 31 else (pa.large_string(), np.int64)
    return size, pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(number)), pa.py_buffer(told)])
