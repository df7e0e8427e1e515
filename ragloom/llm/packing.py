"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenised where they lie; only lengths and checksums travel. Pieces
of full length are sequences of their own. The rest are dealt into shards by a hash
of their identity (so a hot source or id can't gather in one), and each shard is
packed on its own: best fit in hash order, then local search among its underfull bins,
which moves a document, or exchanges one for one or two for one, whenever that
raises the sum of squared fills, and so drains the emptiest bins until they vanish.
A shard wastes less than one bin where that can be reached; its size bounds the memory.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_slices

TOKENIZER = "word_bpe_49k.json"

# Byte-level signs. A printable Latin-1 character stands for its own byte, the rest are numbered from 256.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_NUMBERED = [b for b in range(256) if b not in _OWN]
BYTE_SIGNS = {b: chr(b) for b in _OWN} | {b: chr(256 + n) for n, b in enumerate(_NUMBERED)}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable(dict[str, bytes]):
    """Ids of words as bytes, found by the model when first asked for.

    Two generations bound it: words in use move to the younger one, and when that is
    full it becomes the older one, whose predecessor goes.
    """

    def __init__(self, tokenize: Callable, limit: int):
        super().__init__()
        self._tokenize, self._half = tokenize, limit // 2
        self._older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self._older.get(word)
        if found is None:
            plain = word if word.isascii() else "".join(map(BYTE_SIGNS.__getitem__, word.encode()))
            found = array("I", [t.id for t in self._tokenize(plain)]).tobytes()
        if len(self) >= self._half:
            self._older = dict(self)
            self.clear()
        self[word] = found
        return found


class WordTokens:
    """Ids of a text by a word-level BPE tokenizer file, with the ids of recent words kept.

    A BPE works on each pre-token alone, so a text's ids are those of its pre-tokens in
    order. Texts in Latin letters are cut by a regular expression that equals the
    file's; any other text, and one that spells a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = WordTable(self._tokenizer.model.tokenize, limit)
        latin = [chr(c) for c in range(0x180)]
        letters, numbers = ("".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == kind) for kind in "LN")
        # The pre-tokenizer's contractions and classes.
        self._cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # beyond Latin, or white space on which the two engines differ
        self._other = re.compile("[^\t-\r -\u0084\u0086-\u017f]").search

    def ids(self, text: str) -> np.ndarray:
        words = self._words(text)
        if words is None:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self._known.__getitem__, words)), "=u4").astype("<u4", copy=False)

    def _words(self, text: str) -> list[str] | None:
        """Pre-tokens of a text in Latin letters, else None."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        lowered = text.lower()
        if self._other(lowered) or any(s in text for s in self._special):
            return None
        return self._cut(lowered)


@cache
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``(doc_id, row, piece, start, length, ids_crc32)`` of each document's ids and the end id.

    ``row`` tells rows with the same id apart: it is a hash of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer)
        for part in row_slices(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                ids = np.append(tokens.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for no, begin in enumerate(range(0, len(ids), capacity)):
                    own = ids[begin : begin + capacity]
                    at.append(i), piece.append(no), start.append(begin), length.append(len(own)), crc.append(zlib.crc32(own.tobytes()))
            take = pa.array(at, pa.int64())
            columns = [part.column(0).take(take), part.column(1).take(take), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each length, in the order given, goes to the open bin where it leaves the least room."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left
    for i, n in enumerate(lengths.tolist()):
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room - n:
            rooms[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int, steps: dict[str, int] | None = None) -> list[list[int]]:
    """Bins of indices: best fit in the order given, then local search. No length exceeds ``capacity``."""
    return LocalSearch(best_fit(lengths, capacity), lengths, capacity).run(steps)


@lru_cache(256)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class LocalSearch:
    """Steps between two underfull bins that raise the sum of squared fills, from the emptiest bin on.

    A step takes load from one bin (the poor one) to a fuller one whose room it fits in: one document (move), one for
    a smaller one that comes back (one_for_one), or two for one (two_for_one). Of all steps that its
    documents have, with whatever document of whatever fuller bin, the one that takes most is made. When none is
    left, the next emptiest bin has its turn. The search ends when less than one bin's room is free (no packing
    has fewer bins), or when a pass over all underfull bins finds no step. As the squares are integers
    that rise with each step, it does end; nothing else bounds it.

    A document of size s in a bin with room r can be replaced by loads up to s + r, and a bin's room r can take
    loads up to r (as a document of size 0). ``top`` has the smallest size for each such limit, so that the best
    step for every load comes from one suffix minimum. Bins that change get a new version; their
    old entries go when they are met.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins = [list(b) for b in bins if b]
        self.lengths, self.capacity = np.asarray(lengths, np.int64), capacity
        self.fill = [int(self.lengths[b].sum()) for b in self.bins]
        self.version = [0] * len(self.bins)

    def run(self, steps: dict[str, int] | None = None) -> list[list[int]]:
        counted = {"move": 0, "one_for_one": 0, "two_for_one": 0}
        free = self.capacity * len(self.bins) - sum(self.fill)
        changed = True
        while (changed or self._repack()) and free >= self.capacity:
            changed = False
            free = self.capacity * len(self.bins) - sum(self.fill)
            self.least = None
            self.top = np.full(self.capacity + 1, self.capacity + 1, np.int64)
            self.heaps: list[list[tuple[int, int, int, int]]] = [[] for _ in range(self.capacity + 1)]
            self.queue: list[tuple[int, int]] = []
            for b in range(len(self.bins)):
                self._enter(b)
            passed = set()
            while self.queue:
                fill, poor = heappop(self.queue)
                if poor in passed or fill != self.fill[poor]:
                    continue
                passed.add(poor)
                self.version[poor] += 1  # what is passed over is no place to go to until the next pass
                while self.bins[poor] and (step := self._step(self.bins[poor])):
                    counted[self._make(poor, *step)] += 1
                    changed = True
                if not self.bins[poor]:
                    free -= self.capacity
                    if free < self.capacity:
                        break
        if steps is not None:
            for kind, n in counted.items():
                steps[kind] = steps.get(kind, 0) + n
        return [b for b in self.bins if b]

    def _repack(self) -> bool:
        """When no step is left: lets the underfull bins and the full ones with the smallest documents go and packs
        these best-fit decreasing, if that saves a bin; first few full ones, then twice as many, until all are in."""
        self.bins = [b for b in self.bins if b]
        self.fill = [int(self.lengths[b].sum()) for b in self.bins]
        self.version = [0] * len(self.bins)
        order = sorted(range(len(self.bins)), key=lambda b: (self.fill[b] == self.capacity, self.lengths[self.bins[b]].min()))
        if self.capacity * len(self.bins) - sum(self.fill) < self.capacity:
            return False
        taken = 2 * sum(f < self.capacity for f in self.fill)
        while True:
            gone = order[:taken]
            loose = np.array([i for b in gone for i in self.bins[b]])
            loose = loose[np.argsort(-self.lengths[loose], kind="stable")]
            made = best_fit(self.lengths[loose], self.capacity)
            if len(made) < len(gone):
                stay = set(order[taken:])
                self.bins = [b for no, b in enumerate(self.bins) if no in stay] + [loose[b].tolist() for b in made]
                self.fill = [int(self.lengths[b].sum()) for b in self.bins]
                self.version = [0] * len(self.bins)
                return True
            if taken >= len(order):
                return False
            taken *= 2

    def _enter(self, b: int) -> None:
        if room := self.capacity - self.fill[b]:
            heappush(self.queue, (self.fill[b], b))
            now = self.version[b]
            for size, i in [(0, -1), *zip(self.lengths[self.bins[b]].tolist(), self.bins[b], strict=True)]:
                heappush(self.heaps[size + room], (size, i, b, now))
                if size < self.top[size + room]:
                    self.top[size + room] = size
                    self.least = None

    def _make(self, poor: int, rich: int, out: list[int], back: list[int]) -> str:
        for i in out:
            self.bins[poor].remove(i), self.bins[rich].append(i)
        for i in back:
            self.bins[rich].remove(i), self.bins[poor].append(i)
        taken = int(self.lengths[out].sum() - self.lengths[back].sum())
        self.fill[poor] -= taken
        self.fill[rich] += taken
        self.version[rich] += 1
        self._enter(rich)
        return "move" if not back else "one_for_one" if len(out) == 1 else "two_for_one"

    def _step(self, mine: list[int]) -> tuple[int, list[int], list[int]] | None:
        """(other bin, documents that go, documents that come back) of the step that takes most."""
        own = self.lengths[mine]
        one, two = _pairs(len(mine))
        pairs = own[one] + own[two]
        fit = np.flatnonzero(pairs <= self.capacity)
        loads = np.concatenate([own, pairs[fit]])
        while True:
            if self.least is None:
                self.least = np.minimum.accumulate(self.top[::-1])[::-1]
            taken = loads - self.least[loads]
            best = int(taken.argmax())
            if taken[best] <= 0:
                return None
            limit = int(loads[best]) + int(self.top[loads[best] :].argmin())  # the tightest of equals
            heap = self.heaps[limit]
            while heap and self.version[heap[0][2]] != heap[0][3]:
                heappop(heap)
            if heap and heap[0][0] == self.top[limit]:
                _, i, rich, _ = heap[0]
                out = [mine[best]] if best < len(mine) else [mine[x[fit[best - len(mine)]]] for x in (one, two)]
                # two documents that both just move are two steps
                if i < 0 and len(out) == 2:
                    out = [max(out, key=self.lengths.__getitem__)]
                return rich, out, [i] if i >= 0 else []
            self.top[limit] = heap[0][0] if heap else self.capacity + 1
            self.least = None


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer: str | None = None,
    shard_pieces: int = 8_192,
) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Texts are null-safe (null is empty: the end id alone). Only documents of more than
    ``capacity`` ids are cut. Repeated rows and null ids are packed like others; other
    columns of ``docs`` are not read. An empty table gives an empty table.
    """
    pieces = checkpointed(token_pieces(docs, id_col, text_col, capacity, tokenizer or tokenizer_path()))
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))
    # equal rows (a repeated document) are dealt by a number of their own
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece", F.monotonically_increasing_id()), F.lit(shards)))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ids_crc32", "ascending"), ("length", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, members in enumerate(pack_lengths(lengths, capacity)):
            sequence[members] = (rows.column("shard")[0].as_py() << 32) + b
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return rows.drop_columns("shard").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kind = docs.schema[id_col].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInArrow(pack, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return whole.unionByName(packed).drop("row")
