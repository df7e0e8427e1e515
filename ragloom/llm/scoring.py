"""N-gram scoring with a log-frequency Bloom filter.

Counts of n-grams are aggregated over all training texts and quantised on a logarithmic scale: an n-gram of level q
is put into the filter q times, once with each of the levels 1 to q. To read its count, levels are probed from 1
on until one is missing; an n-gram that isn't there passes the first probe with the filter's error rate only, so counts
are never read too low and seldom too high. A token's probability is smoothed down the orders:

    p1(w) = (c(w) + 1) / (N + V + 1),    pk(w | h) = (min(c(hw), c(h)) + m p(k-1)(w)) / (c(h) + m)

with every count a read of the filter. The filter follows the number of n-grams; it is dealt by key range into
shards of at most ``shard_bits`` bits. Each shard is built by one task, passes the driver alone, and is a broadcast
variable of its own; a task holds one at a time and brings it the distinct n-grams of a chunk of its texts.

The plain unigram score beside it is exact: its counts come from the aggregated table, dealt into
broadcast blocks of bounded size. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import KeyBlocks, block_bits, block_of, ranges, release
from .common import row_slices, scratch_path, utf8
from .ngrams import chunks, gram_keys, slices
from .text_kernels import WordHashes, mix

SEED = 11
#: What stands before a text and after it; no word has white space in it.
_MARKS = WordHashes(SEED)
START, END = np.uint64(_MARKS[b"\n"]), np.uint64(_MARKS[b" "])
_LEVEL = np.uint64(0xBF58476D1CE4E5B9)


class Levels:
    """Counts on a logarithmic scale: level j holds the counts from ``base**(j-1)`` up to below ``base**j``."""

    def __init__(self, base: float = 1.5, most: int = 1 << 48):
        edges = [1]
        power = base
        while edges[-1] < most:
            edges.append(max(edges[-1], int(np.ceil(power))))
            power *= base
        self.edges = np.array(edges, np.int64)
        middle = [(a + max(a, b - 1)) / 2 for a, b in zip(edges, [*edges[1:], edges[-1]], strict=True)]
        self.middle = np.array([0.0, *middle])

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, counts, "right")


def _places(keys: np.ndarray, level: int, hashes: int, size: int) -> Iterator[np.ndarray]:
    """Bit numbers of keys at a level, one array for each hash function."""
    with np.errstate(over="ignore"):
        first = mix(keys + np.uint64(level) * _LEVEL)
        second = mix(first ^ _LEVEL) | np.uint64(1)
        for i in range(hashes):
            yield ((first + np.uint64(i) * second) % np.uint64(size)).astype(np.int64)


def fill(bits: np.ndarray, keys: np.ndarray, levels: np.ndarray, hashes: int) -> None:
    """Puts keys into an array of bits (a byte each), with each of the levels up to their own."""
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys = keys[levels >= level]
        levels = levels[levels >= level]
        for place in _places(keys, level, hashes, len(bits)):
            bits[place] = 1


def probe(packed: np.ndarray, size: int, keys: np.ndarray, hashes: int) -> np.ndarray:
    """The levels of keys: the first one that is missing ends the search."""
    out, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(alive):
        level += 1
        there = np.ones(len(alive), bool)
        for place in _places(keys[alive], level, hashes, size):
            there &= (packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        alive = alive[there]
        out[alive] = level
    return out


class ShardedFilter:
    """A log-frequency Bloom filter over ``(key long, n long)``, dealt by key range into broadcast shards."""

    def __init__(self, counts: DataFrame, base: float = 1.5, hashes: int = 5, shard_bits: int = 1 << 25):
        spark = counts.sparkSession
        self.hashes, self.levels = hashes, Levels(base)
        scale, shape = self.levels, hashes
        inserted = counts.agg(F.sum(F.floor(F.log(base, F.col("n"))) + 1)).first()[0] or 0
        # bits for each insertion so that about half of them are set
        wanted = max(64, int(inserted * hashes * 1.4427) + 64)
        self.bits = block_bits(wanted, shard_bits)
        size = self.size = -(-wanted // (1 << self.bits))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, bits = None, np.zeros(0, np.uint8)
            for batch in batches:
                shard = batch.column(0).to_numpy()
                key = batch.column(1).to_numpy().view(np.uint64)
                level = scale.of(batch.column(2).to_numpy())
                for no in np.unique(shard).tolist():
                    if no != own:
                        if own is not None:
                            yield pack(own, bits)
                        own, bits = no, np.zeros(size, np.uint8)
                    fill(bits, key[shard == no], level[shard == no], shape)
            if own is not None:
                yield pack(own, bits)

        def pack(no: int, bits: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])

        dealt = counts.select(block_of("key", self.bits).alias("shard"), "key", "n").repartition(1 << self.bits, "shard").sortWithinPartitions("shard")
        path = scratch_path(spark, "count-filter")
        dealt.mapInArrow(build, "shard int, bits binary").write.parquet(path)
        stored = spark.read.schema("shard int, bits binary").parquet(path)
        self.shards: list[Broadcast] = []
        for no in range(1 << self.bits):
            row = stored.where(F.col("shard") == no).select("bits").first()
            self.shards.append(spark.sparkContext.broadcast(np.frombuffer(bytes(row.bits), np.uint8) if row else np.zeros(-(-size // 8), np.uint8)))

    def reader(self) -> FilterReader:
        return FilterReader(self)


class FilterReader:
    """What goes to the tasks of a ``ShardedFilter``."""

    def __init__(self, source: ShardedFilter):
        self.shards, self.bits, self.size, self.hashes, self.middle = source.shards, source.bits, source.size, source.hashes, source.levels.middle

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Expected counts of sorted distinct keys."""
        out = np.zeros(len(keys), np.int64)
        edges = ranges(keys, self.bits)
        for no, shard in enumerate(self.shards):
            low, high = edges[no], edges[no + 1]
            if low < high:
                out[low:high] = probe(shard.value, self.size, keys[low:high], self.hashes)
                if len(self.shards) > 1:
                    release(shard)
        return self.middle[np.minimum(out, len(self.middle) - 1)]


def _pieces(texts: list[bytes], hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens of each text, piece by piece, between its marks, and the number of the text."""
    for no, text in enumerate(texts):
        for tokens in chain([np.array([START], np.uint64)], (hashes.of(piece.split()) for piece in slices(text.lower())), [np.array([END], np.uint64)]):
            yield tokens, np.full(len(tokens), no, np.int64)


def ngram_counts(texts: DataFrame, order: int, min_count: int) -> DataFrame:
    """``k, key, n`` of the n-grams of all texts (one column): tokens with k = 1, text starts with k = 0, and the
    longer ones that occur ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(SEED)
        rows = (text for part in row_slices(batches) for text in utf8(part.column(0)))
        for tokens, _, fresh in chunks((piece for text in rows for piece in _pieces([text], hashes)), order - 1, 1 << 19):
            inner = tokens != START
            whole = np.ones(len(tokens), bool)
            for k, keys in enumerate(gram_keys(tokens, order), 1):
                if k > 1:
                    whole = whole[: len(keys)] & inner[k - 1 :]
                last = np.arange(len(keys)) + k - 1 >= fresh
                for size, which in ((k, whole & last & (inner if k == 1 else True)),) + (((0, ~inner & last),) if k == 1 else ()):
                    found, n = np.unique(keys[which], return_counts=True)
                    for at in range(0, len(found), 1 << 15):
                        part = found[at : at + (1 << 15)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), size, np.int32)), pa.array(part), pa.array(n[at : at + (1 << 15)].astype(np.int64))], ["k", "key", "n"])

    told = texts.mapInArrow(run, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    return told.where((F.col("k") <= 1) | (F.col("n") >= min_count))


class NgramModel:
    """Fitted on the texts of one column; ``score`` adds probabilities to any documents."""

    def __init__(self, docs: DataFrame, text_col: str = "text", order: int = 2, min_count: int = 2, smoothing: float = 100.0, base: float = 1.5, hashes: int = 5, block_rows: int = 1 << 19, shard_bits: int = 1 << 25):
        spark = docs.sparkSession
        path = scratch_path(spark, "ngram-counts")
        ngram_counts(docs.select(F.col(text_col).cast("string").alias("text")), order, min_count).write.parquet(path)
        self.counts = spark.read.schema("k int, key long, n long").parquet(path)
        total = self.counts.where("k = 1").agg(F.sum("n"), F.count("*")).first()
        self.order, self.smoothing = order, smoothing
        self.tokens, self.vocabulary = total[0] or 0, total[1]
        self.words = KeyBlocks(self.counts.where("k = 1").select("key", F.col("n").alias("value")), block_rows, self.vocabulary)
        self.filter = ShardedFilter(self.counts.select("key", "n"), base, hashes, shard_bits)

    def score(self, docs: DataFrame, text_col: str = "text", into: str = "lm", buffer_bytes: int = 8 << 20) -> DataFrame:
        """``docs`` with a column ``into`` added (replaced if it is there): (n_tokens, n_known, train_tokens, base_score, score)."""
        held = docs.drop(into)
        at = held.columns.index(text_col)
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        out = held.withColumn(into, F.struct(*[F.lit(0).cast("double" if "score" in n else "long").alias(n) for n in names]))
        kind = to_arrow_type(out.schema[into].dataType)
        order, smoothing, n_all, total = self.order, self.smoothing, self.tokens, float(self.tokens + self.vocabulary + 1)
        words, reader = self.words.finder(), self.filter.reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes(SEED)
            waiting, size = [], 0
            for part in row_slices(batches):
                waiting.append(part)
                size += part.nbytes
                if size >= buffer_bytes:
                    yield from scan(waiting, hashes)
                    waiting, size = [], 0
            if waiting:
                yield from scan(waiting, hashes)

        def scan(parts: list[pa.RecordBatch], hashes: WordHashes) -> Iterator[pa.RecordBatch]:
            texts = [t for part in parts for t in utf8(part.column(at))]
            rows = len(texts)
            seen, known, plain, model = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
            for tokens, owner, fresh in chunks(_pieces(texts, hashes), order, 1 << 19):
                base, told = chances(tokens)
                which = np.arange(len(tokens)) >= fresh
                which &= tokens != START
                own = owner[which]
                seen += np.bincount(own, minlength=rows)
                known += np.bincount(own, base[which] > 0, rows).astype(np.int64)
                plain += np.bincount(own, np.log10((base[which] + 1) / total), rows)
                model += np.bincount(own, np.log10(told[which]), rows)
            begin = 0
            for part in parts:
                end = begin + part.num_rows
                columns = [pa.array(x[begin:end]) for x in (seen, known, np.full(rows, n_all, np.int64), plain, model)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.StructArray.from_arrays(columns, fields=list(kind))], schema=part.schema.set(len(part.columns) - 1, pa.field(into, kind)))
                begin = end

        def chances(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Exact counts of a chunk's tokens, and their smoothed probabilities after the tokens before."""
            distinct, place = np.unique(tokens, return_inverse=True)
            exact = words.find(distinct)[place]
            keys = gram_keys(tokens, order)
            wanted, where = np.unique(np.concatenate(keys), return_inverse=True)
            read = np.split(reader.counts(wanted)[where], np.cumsum([len(k) for k in keys])[:-1])
            chance = (read[0] + 1) / total
            starts = np.flatnonzero(tokens == START)
            # how many tokens of its text, the start included, are before a token
            before = np.arange(len(tokens)) - np.concatenate([[0], starts])[np.searchsorted(starts, np.arange(len(tokens)), "right")]
            for k in range(1, order):
                context, joint = read[k - 1][: len(tokens) - k], read[k]
                better = (np.minimum(joint, context) + smoothing * chance[k:]) / (context + smoothing)
                chance[k:] = np.where(before[k:] >= k, better, chance[k:])
            return exact, np.minimum(chance, 1.0)

        return out.mapInArrow(run, out.schema)


def training_rows(id_col: Column, parts: int = 7, held: int = 2) -> Column:
    """Whether a document is learnt from: its id's crc32, as text, modulo ``parts`` isn't ``held``. A null id is learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts != held, F.lit(True))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    The model learns from all rows but those whose id is held out (``training_rows``); ``options`` are those of ``NgramModel``.
    Tokens are the words between ASCII white space with A-Z lower-cased, and one end for each text. A null text is
    empty, so it has the end alone. Repeated rows count as often as they are there. Without any row to learn
    from, N and V are 0 and every token has probability 1. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = NgramModel(rows.where(training_rows(F.col("doc_id"))), "text", **options)
    scored = model.score(rows, "text", "lm")
    return scored.select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score")
