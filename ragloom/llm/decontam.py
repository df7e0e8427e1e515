"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

If a passage of m characters occurs in a text with at most k edits, the two share at
least m + 1 - q - k*q q-grams, on diagonals (place in the text minus place in the
passage) that lie at most k apart. So the shared q-grams are counted in
overlapping bands of diagonals of width 2(k+1), each k+1 on from the last: one of these
has all of an occurrence. Bands with enough q-grams are verified by an alignment of
the whole passage that keeps to the band's diagonals.

Texts are compared lower-cased, with runs of white space as one space. A passage too short
for its budget at the usual q has grams of its own, as short as it takes, so none is left out.

Documents are read once, where they lie, and nothing is shuffled. The benchmark is cut into
blocks of bounded size, each a broadcast variable; the driver holds one at a time, and a task
holds one at a time with a bounded buffer of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import row_slices

_FACTOR = 0xD6E8FEB86659FD93 | 1
_BITS = 22
#: Places of grams that are expanded at once, bands that are counted at once, diagonals that are aligned at once.
EXPANDED, CELLS, WIDEST = 1 << 21, 1 << 22, 1 << 17


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q consecutive codes, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    n = len(codes) - q + 1
    out, done, power = np.zeros(n, np.uint64), 0, codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        reach = 1
        while True:
            if q & reach:
                out = out * np.uint64(pow(_FACTOR, reach, 1 << 64)) + power[done : done + n]
                done += reach
            if reach * 2 > q:
                return out * np.uint64(0x9E3779B97F4A7C15)
            power = power[:-reach] * np.uint64(pow(_FACTOR, reach, 1 << 64)) + power[reach:]
            reach *= 2


@dataclass(frozen=True)
class Match:
    item: object
    start: int
    end: int
    edits: int


class PassageIndex:
    """q-grams of a block of passages, an index for each length that grams have."""

    def __init__(self, items: list[tuple[object, str]], q: int = 8, edit_rate: float = 0.08):
        of_size: dict[int, list[tuple[object, np.ndarray, int]]] = {}
        for item, text in items:
            codes = _codes(normalised(text or ""))
            if m := len(codes):
                edits = min(int(m * edit_rate), m - 1)
                # the longest grams of which one is shared at that budget
                of_size.setdefault(min(q, m // (edits + 1)), []).append((item, codes, edits))
        self.parts = [GramIndex(size, kept) for size, kept in sorted(of_size.items())]

    def find(self, text: str) -> list[Match]:
        """The best verified occurrence of each passage."""
        if not self.parts:
            return []
        codes = _codes(normalised(text))
        return [m for part in self.parts for m in part.find(codes)]


class GramIndex:
    """Grams of one length of passages ``(item, codes, edits)``, with a bitmap in front."""

    def __init__(self, q: int, kept: list[tuple[object, np.ndarray, int]]):
        self.q = q
        self.ids = [i for i, _, _ in kept]
        self.codes = [c for _, c, _ in kept]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([k for _, _, k in kept], np.int64)
        self.least = self.sizes + 1 - q - self.edits * q
        grams = [gram_hashes(c, q) for c in self.codes]
        hashes = np.concatenate(grams)
        item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(hashes, kind="stable")
        self.grams, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.item, self.place = item[order], place[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> list[Match]:
        if len(codes) < self.q:
            return []
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[gram] == hashes[at]
        at, gram = at[same], gram[same]
        # passages that the whole text hasn't enough q-grams for
        distinct, times = np.unique(gram, return_counts=True)
        entry, owner = self._entries(distinct)
        enough = np.bincount(self.item[entry], times[owner], len(self.ids)) >= self.least
        best = {no: match for no in np.flatnonzero(enough).tolist() if (match := self._whole(codes, no))}
        enough[list(best)] = False  # nothing is better than the first place without an edit
        count = (self.first[1:] - self.first[:-1])[gram]
        for no, low, high in self._surviving(at, gram, count, enough) if enough.any() else []:
            match = self._verify(codes, no, low, high - low, int(self.edits[no]))
            if match and (no not in best or (match.edits, match.start) < (best[no].edits, best[no].start)):
                best[no] = match
        return [best[no] for no in sorted(best)]

    def _entries(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place in a passage of each of the grams, and which of these it is of."""
        count = self.first[gram + 1] - self.first[gram]
        owner = np.repeat(np.arange(len(gram)), count)
        return np.arange(len(owner)) + np.repeat(self.first[gram] - np.cumsum(count) + count, count), owner

    def _whole(self, codes: np.ndarray, no: int) -> Match | None:
        """The first place where the passage stands without an edit."""
        own, text = self.codes[no].astype("<u4").tobytes(), codes.astype("<u4").tobytes()
        at = text.find(own)
        while at > 0 and at % 4:
            at = text.find(own, at + 1)
        return Match(self.ids[no], at // 4, (at + len(own)) // 4, 0) if at >= 0 else None

    def _surviving(self, at: np.ndarray, gram: np.ndarray, count: np.ndarray, enough: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(passage, first diagonal, end)`` of the regions of bands with enough q-grams. Places are expanded in slices of bounded
        size, and counted either by the bands that they meet or, where they are many, in an array of all bands of some passages."""
        step = self.edits + 1
        slices = np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(count) // EXPANDED)) + 1)
        if len(slices) == 1:
            entry, owner = self._entries(gram)
            item = self.item[entry]
            held = enough[item]
            item, diagonal = item[held], at[owner[held]] - self.place[entry[held]]
            if not len(item):
                return
            band = diagonal // step[item]
            low = int(band.min())
            span = int(band.max()) - low + 3
            key, hits = np.unique(item * span + (band - low + 1), return_counts=True)
            yield from self._regions(key, hits, span, low - 1, np.arange(len(self.ids)))
            return
        chosen = np.flatnonzero(enough)
        lowest, highest = -(self.sizes // step) - 2, int(at[-1]) // step + 2
        width = highest - lowest + 3
        first = 0
        while first < len(chosen):
            stop = first + max(1, int(np.searchsorted(np.cumsum(width[chosen[first:]]), CELLS, "right")))
            own = chosen[first:stop]
            span, low = int(width[own].max()), int(lowest[own].min()) - 1
            span += int(lowest[own].max() - lowest[own].min()) + 2
            slot = np.full(len(self.ids), -1)
            slot[own] = np.arange(len(own))
            hits = np.zeros(len(own) * span, np.int64)
            for part in slices:
                entry, owner = self._entries(gram[part])
                held = slot[self.item[entry]] >= 0
                entry, owner = entry[held], owner[held]
                item = self.item[entry]
                key = slot[item] * span + ((at[part][owner] - self.place[entry]) // step[item] - low)
                hits += np.bincount(key, minlength=len(hits))
            key = np.flatnonzero(hits)
            yield from self._regions(key, hits[key], span, low, own)
            first = stop

    def _regions(self, key: np.ndarray, hits: np.ndarray, span: int, low: int, own: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Regions of bands that have enough hits together with the next one; ``key`` is slot times ``span`` plus band less ``low``,
        and the first and last keys of a slot are those of no band."""
        both = np.unique(np.concatenate([key, key - 1]))
        total = np.zeros(len(both), np.int64)
        for shift in (0, 1):
            place = np.minimum(np.searchsorted(key, both + shift), len(key) - 1)
            total += np.where(key[place] == both + shift, hits[place], 0)
        owner = own[np.minimum(both // span, len(own) - 1)]
        kept = total >= self.least[owner]
        both, owner = both[kept], owner[kept]
        if not len(both):
            return
        cut = np.flatnonzero((np.diff(both) > 2) | (np.diff(owner) != 0)) + 1
        for part, who in zip(np.split(both, cut), np.split(owner, cut), strict=True):
            no, size = int(who[0]), int(self.edits[who[0]]) + 1
            for a in range(0, len(part), WIDEST // size + 1):
                some = part[a : a + WIDEST // size + 1] % span + low
                yield no, int(some[0]) * size, (int(some[-1]) + 2) * size

    def _verify(self, codes: np.ndarray, no: int, diagonal: int, width: int, edits: int) -> Match | None:
        end, distance = banded_alignment(self.codes[no], codes, diagonal - edits, width + 2 * edits)
        if distance > edits:
            return None
        # from the end back, the same alignment finds where it starts; it needs no more of the text than this
        back = codes[max(0, end - len(self.codes[no]) - edits) : end][::-1]
        size, _ = banded_alignment(self.codes[no][::-1], back, -edits, 2 * edits + 1, anchored=True)
        return Match(self.ids[no], max(0, end - size), end, distance)


def banded_alignment(pattern: np.ndarray, text: np.ndarray, diagonal: int, width: int, anchored: bool = False) -> tuple[int, int]:
    """(end in the text, edits) of the best occurrence of the whole pattern whose alignment keeps to
    ``width`` diagonals from ``diagonal`` on; ``anchored``: it starts at the start of the text."""
    # the part of the text that the band meets
    skip = max(0, min(diagonal, len(text)))
    if skip and not anchored:
        end, distance = banded_alignment(pattern, text[skip : max(skip, diagonal + width + len(pattern))], diagonal - skip, width)
        return end + skip, distance
    text = text[: max(0, diagonal + width + len(pattern))]
    far = len(pattern) + len(text) + 1
    lane = diagonal + np.arange(width)  # text place of a row's cell: row + lane
    padded = np.full(len(text) + len(pattern) + 2 * width + 2, np.iinfo(np.uint32).max, np.uint32)
    # cells before the text or after its end can't be reached
    cost = np.where((lane >= 0) & (lane <= len(text)), 0, far)
    if anchored:
        cost = np.where(lane == 0, 0, np.where(lane > 0, lane, far))
    offset = max(0, -diagonal)
    padded[offset : offset + len(text)] = text[: len(padded) - offset]
    ramp = np.arange(width)
    for row, letter in enumerate(pattern, 1):
        place = row + lane
        begin = row - 1 + diagonal + offset
        own = padded[begin : begin + width] if begin < len(padded) else padded[:0]
        differs = np.ones(width, np.int64)
        differs[: len(own)] = own != letter
        step = cost + differs
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        step[(place < 0) | (place > len(text))] = far
        cost = np.minimum.accumulate(step - ramp) + ramp
        cost[(place < 0) | (place > len(text))] = far
    best = int(cost.argmin())
    return len(pattern) + int(lane[best]), int(cost[best])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str, int]]]:
    """The benchmark's distinct ``(item, text, rows)`` in blocks that hold about ``block_chars`` characters."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    items = items.groupBy("item", "text").agg(F.count("*").alias("n"))
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = total // block_chars + 1
    for no in range(blocks):
        yield [(r.item, r.text, r.n) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == no).collect()]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = 8,
    edit_rate: float = 0.08,
    block_chars: int = 4_000_000,
    buffer_bytes: int = 32 << 20,
    into: str = "leaks",
) -> DataFrame:
    """``docs`` with a column ``into`` added (replaced if it is there): the benchmark passages that occur
    in the text with at most ``edit_rate`` edits a character (rounded down), each with its best occurrence
    as (item, start, end, edits) in the lower-cased text with single spaces.

    Null texts have none; passages that are null or empty, or have a null id, are never found; items that
    repeat an id are passages of their own, reported once for each. Ids may be of any type. An empty
    benchmark finds nothing. All other columns and repeated rows are kept as they are.

    The benchmark is dealt into blocks of ``block_chars`` characters. With several, a task takes
    ``buffer_bytes`` of texts at a time through all of them.
    """
    held = docs.drop(into)
    names = held.columns
    item = benchmark.schema[item_col].dataType
    out = held.withColumn(into, F.array().cast(f"array<struct<item:{item.simpleString()},start:bigint,end:bigint,edits:bigint>>"))
    kind = pa.list_(pa.struct([("item", to_arrow_type(item)), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    text_at = names.index(text_col)
    context = docs.sparkSession.sparkContext
    indexes = []
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        if block:
            copies = {(i, t): n for i, t, n in block if n > 1}
            rows = [(i, t) for i, t, _ in block] + [(i, t) for (i, t), n in copies.items() for _ in range(n - 1)]
            indexes.append(context.broadcast(PassageIndex(rows, q, edit_rate)))
    if not indexes:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for part in row_slices(batches):
            waiting.append(part)
            size += part.nbytes
            if len(indexes) == 1 or size >= buffer_bytes:
                yield from scan(waiting)
                waiting, size = [], 0
        yield from scan(waiting)

    def scan(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[[] for _ in range(part.num_rows)] for part in parts]
        for index in indexes if parts else []:
            for part, rows in zip(parts, found, strict=True):
                for text, row in zip(part.column(text_at).to_pylist(), rows, strict=True):
                    row += [{"item": m.item, "start": m.start, "end": m.end, "edits": m.edits} for m in index.value.find(text or "")]
            if len(indexes) > 1:
                del index._value  # the worker keeps no more than one block; it is on disk
        for part, rows in zip(parts, found, strict=True):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, kind)], schema=part.schema.set(len(names), pa.field(into, kind)))

    return out.mapInArrow(run, out.schema)


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, items, spans`` for each document."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark).withColumn("leaks", F.array_sort("leaks"))
    told = F.transform("leaks", lambda m: F.concat_ws(":", m["item"].cast("string"), m["start"].cast("string"), m["end"].cast("string"), m["edits"].cast("string")))
    items = F.array_distinct(F.transform("leaks", lambda m: m["item"]))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        F.array_join(F.transform(items, lambda i: i.cast("string")), ",").alias("items"),
        F.array_join(told, ",").alias("spans"),
    )
