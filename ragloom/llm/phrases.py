"""Collocations: phrases of two to four words that stay together, by language.

1. A sketch counts hashed words and word pairs of all texts: its cells are dealt in ranges of 4 million counters, and
   each range is summed by one task. A cell's count is an upper bound for each phrase that falls into it.
2. Texts are cut into runs: words whose bound reaches the threshold, joined where their pair's bound does as well. Every
   place of a frequent phrase lies in a run, so equal runs are counted and only distinct ones go on.
3. A second sketch counts the phrases of three and four words in the runs. Phrases of which all bounds reach the
   threshold are the candidates: every phrase that is frequent enough, and a few that aren't.
4. The candidates, each between delimiters, are dealt into blocks of bounded size. A block is compiled into one
   Aho-Corasick automaton for each language, and every shard of the runs goes through it (with many blocks, a run goes only to those of
   its word pairs); matches may overlap and count as often as their run is there. The counts are summed and the threshold applied, so all that follows is exact.
5. Cuts, containment and ranks are joins and aggregates of the counted phrases.

The texts are read twice, and the runs once for each of a few blocks. Chunks of text have bounded size: a chunk starts with the last
three words of the one before, and the run of these is counted once less, so no text needs to fit into a chunk. The
cells that reach the threshold, and the blocks of candidates, pass the driver one bounded block at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from math import isqrt
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import KeyBlocks, KeyFinder
from .common import hot_blocks, join_dealt, row_slices, scratch_path, utf8, written
from .ngrams import chunks, gram_keys, slices
from .text_kernels import mix, span_hashes

SEED, LONGEST = 13, 4
#: Counters of a range of the sketch, as a power of two.
RANGE_BITS = 22
_CUTS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"\t" + _CUTS, b" " + b"\n" * len(_CUTS))
_CUT = b"\n"
_MARK = span_hashes(_CUT, np.zeros(1, np.int64), np.ones(1, np.int64), SEED)[0]
_BLANK = re.compile(b" ").search


def _told(text: bytes) -> bytes:
    """A text with A-Z lower-cased, blanks between its words and a sign between its pieces."""
    return b" \n " + text.lower().translate(_TABLE).replace(_CUT, b" \n ")


def _spans(told: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a told text start, and their sizes."""
    inner = np.frombuffer(b" " + told + b" ", np.uint8) != 32
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    return edges[::2], edges[1::2] - edges[::2]


class _Chunk:
    """Tokens of a piece of the stream with the languages' numbers, the weights of their rows and the words; ``keys`` and
    ``whole`` of phrases of 1 to 4 words, by first place: the key, and whether it crosses no cut."""

    def __init__(self, tokens: np.ndarray, lang: np.ndarray, weight: np.ndarray, words: list[bytes], fresh: int, langs: list[str], longest: int):
        self.tokens, self.lang, self.weight, self.words, self.fresh = tokens, lang, weight, words, fresh
        salt = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) for x in langs], np.uint64)[lang]
        inner = tokens != _MARK
        self.keys, self.whole = [], []
        for k, plain in enumerate(gram_keys(tokens, longest)):
            with np.errstate(over="ignore"):
                self.keys.append(mix(plain + salt[: len(plain)] * np.uint64(2 * k + 3)))
            self.whole.append(inner if k == 0 else self.whole[-1][: len(plain)] & inner[k:])

    def ends_new(self, k: int) -> np.ndarray:
        """Which phrases of k words are whole and end in the new part of the chunk."""
        return self.whole[k - 1] & (np.arange(len(self.whole[k - 1])) + k - 1 >= self.fresh)


class _Stream:
    """Chunks of the tokens of Arrow batches (lang, text, weight); the weight may be left out, and so may the words."""

    def __init__(self, batches: Iterator[pa.RecordBatch], size: int, longest: int = LONGEST, named: bool = False):
        self.batches, self.size, self.longest, self.named = batches, size, longest, named
        self.langs: list[str] = []
        self.number: dict[str, int] = {}

    def _pieces(self) -> Iterator[tuple]:
        def piece(told: list[bytes], langs: np.ndarray, weights: np.ndarray) -> tuple:
            whole = b"".join(told)
            start, size = _spans(whole)
            n = np.diff(np.searchsorted(start, np.cumsum([0, *map(len, told)])))
            found = span_hashes(whole, start, size, SEED), np.repeat(langs, n).astype(np.int32), np.repeat(weights, n)
            return (*found, list(filter(None, whole.split(b" ")))) if self.named else found

        for part in chain.from_iterable(row_slices(iter([batch]), 256 if batch.num_columns == 2 else 1 << 12) for batch in self.batches):
            names = part.column(0).dictionary_encode()
            langs = np.array([self.number.setdefault(x, len(self.number)) for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()]
            self.langs = list(self.number)
            weights = part.column(2).to_numpy().astype(np.int64) if part.num_columns > 2 else np.ones(len(langs), np.int64)
            told, at = [], []
            for no, text in enumerate(utf8(part.column(1))):
                if len(text) <= 1 << 16:
                    told.append(_told(text)), at.append(no)
                    continue
                for some in slices(_told(text), _BLANK):
                    yield piece([some], langs[no : no + 1], weights[no : no + 1])
            if at:
                yield piece(told, langs[at], weights[at])

    def __iter__(self) -> Iterator[_Chunk]:
        for *columns, fresh in chunks(self._pieces(), LONGEST - 1, self.size):
            yield _Chunk(*columns[:3], columns[3] if self.named else [], fresh, self.langs, self.longest)


class Bound:
    """Which keys fall into cells of a sketch that reach its threshold."""

    def __init__(self, cells: KeyFinder, bits: int):
        self.cells, self.shift = cells, np.uint64(64 - bits)

    def reached(self, keys: np.ndarray, which: np.ndarray) -> np.ndarray:
        which = which.copy()
        which[which] = self.cells.may_have(keys[which] >> self.shift << self.shift)
        found, place = np.unique(keys[which] >> self.shift << self.shift, return_inverse=True)
        which[which] = (self.cells.find(found) > 0)[place]
        return which


def sketch(rows: DataFrame, pick: Callable[[_Chunk], list[tuple[np.ndarray, np.ndarray | None]]], longest: int, bits: int, threshold: int, size: int) -> Bound:
    """Counts the keys, with weights if there are any, that ``pick`` gives for a chunk in ``2**bits`` cells, and keeps the cells that reach ``threshold``."""
    local = min(RANGE_BITS, bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _Stream(batches, size, longest):
            keys, weights = zip(*pick(chunk), strict=True)
            inside = np.concatenate(keys) >> np.uint64(64 - bits)
            if weights[0] is None:
                cells, n = np.unique(inside, return_counts=True)
            else:
                cells, place = np.unique(inside, return_inverse=True)
                n = np.bincount(place, np.concatenate(weights), len(cells)).astype(np.int64)
            # a byte holds most counts; the others stand apart
            part = (cells >> np.uint64(local)).astype(np.int64)
            inside = (cells & np.uint64((1 << local) - 1)).astype(np.uint32)
            own, first = np.unique(part, return_index=True)
            edges = np.append(first, len(part)).tolist()
            for at in range(0, len(own), 256):
                spans = [slice(a, b) for a, b in zip(edges[at : at + 256], edges[at + 1 : at + 257], strict=False)]
                big = [n[s] if np.abs(n[s]).max() > 127 else n[s].astype(np.int8) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 256]), pa.array([inside[s].tobytes() for s in spans], pa.binary()), pa.array([b.tobytes() for b in big], pa.binary())], ["part", "cells", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counters = None, np.zeros(1 << local, np.int64)

        def told() -> pa.RecordBatch:
            found = np.flatnonzero(counters >= threshold).astype(np.uint64)
            keys = (found + (np.uint64(own) << np.uint64(local))) << np.uint64(64 - bits)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.ones(len(keys), np.int64))], ["key", "value"])

        for batch in batches:
            for no, cells, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if no != own:
                    if own is not None:
                        yield told()
                    own = no
                    counters[:] = 0
                counters[np.frombuffer(cells, np.uint32)] += np.frombuffer(n, np.int8 if 4 * len(n) == len(cells) else np.int64)
        if own is not None:
            yield told()

    summed = rows.mapInArrow(partial, "part long, cells binary, n binary").repartition("part").sortWithinPartitions("part")
    return Bound(KeyBlocks(written(summed.mapInArrow(total, "key long, value long"), "cells")).finder(), bits)


def text_runs(rows: DataFrame, short: Bound, size: int) -> DataFrame:
    """``lang, run, n``: the runs of all texts and how often each is there, and for each language one row with a null
    run and its number of words. A run may be there a negative number of times, where it is part of others that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(batches, size, 2, named=True)
        for chunk in stream:
            one = short.reached(chunk.keys[0], chunk.whole[0])
            pair = short.reached(chunk.keys[1], one[:-1] & one[1:]) if len(one) > 1 else one[:0]
            langs, told, times = [], [], []
            for stop, sign in ((len(one), 1), (chunk.fresh, -1)):
                at = np.flatnonzero(one[:stop])
                begins = at[~np.concatenate([[False], pair])[at]]
                length = at[~np.concatenate([pair[: max(0, stop - 1)], [False]])[at]] + 1 - begins
                for few in (1, 2):  # most runs: their keys tell them apart
                    short_ones = begins[length == few]
                    _, first, n = np.unique(chunk.keys[few - 1][short_ones], return_index=True, return_counts=True)
                    langs.append(chunk.lang[short_ones[first]]), times.append(sign * n)
                    told += [b" ".join(chunk.words[i : i + few]) for i in short_ones[first].tolist()]
                for lang in np.unique(chunk.lang):
                    own = (length > 2) & (chunk.lang[begins] == lang)
                    found = Counter(b" ".join(chunk.words[i : i + n]) for i, n in zip(begins[own].tolist(), length[own].tolist(), strict=True))
                    langs.append(np.full(len(found), lang)), times.append(sign * np.fromiter(found.values(), np.int64, len(found)))
                    told += found
            n_words = np.bincount(chunk.lang[chunk.ends_new(1)], minlength=len(stream.langs))
            lang = pa.array(np.concatenate([*langs, np.arange(len(n_words))]))
            yield pa.RecordBatch.from_arrays([pa.array(stream.langs, pa.string()).take(lang), pa.array([*told, *[None] * len(n_words)], pa.binary()).cast(pa.string()), pa.array(np.concatenate([*times, n_words]).astype(np.int64))], ["lang", "run", "n"])

    return rows.mapInArrow(run, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).where("n <> 0")


def candidates(runs: DataFrame, min_count: int, cell_bits: int, size: int) -> DataFrame:
    """``lang, phrase``: the phrases of two to four words in ``runs`` (lang, run, n) whose bounds all reach ``min_count``, and their words.
    The pairs of a run do so already."""

    def long_keys(chunk: _Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
        which = [chunk.ends_new(k) for k in (3, 4)]
        return [(chunk.keys[k][w], chunk.weight[: len(w)][w]) for k, w in zip((2, 3), which, strict=True)]

    long = sketch(runs, long_keys, LONGEST, cell_bits, min_count, size)

    def reached(chunk: _Chunk) -> list[np.ndarray]:
        _, pair, three, four = chunk.whole
        three = long.reached(chunk.keys[2], three)
        return [pair, three, long.reached(chunk.keys[3], four & three[:-1] & three[1:] if len(three) > 1 else four)]

    def named(stream: _Stream, chunk: _Chunk, places: list[np.ndarray]) -> list[pa.Array]:
        """Languages and phrases at places of phrases of two, three and four words."""
        lang = pa.array(stream.langs, pa.string()).take(pa.array(chunk.lang[np.concatenate(places)]))
        told = [b" ".join(chunk.words[i : i + k]) for k, at in enumerate(places, 2) for i in at.tolist()]
        return [lang, pa.array(told, pa.binary()).cast(pa.string())]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(batches, size, named=True)
        for chunk in stream:
            mark = np.concatenate([[False], chunk.tokens == _MARK, [False]])
            places = [np.flatnonzero(may & chunk.ends_new(k) & mark[: len(may)] & mark[k + 1 : k + 1 + len(may)]) for k, may in enumerate(reached(chunk), 2)]
            keys = np.concatenate([chunk.keys[k - 1][at] for k, at in enumerate(places, 2)])
            yield pa.RecordBatch.from_arrays([*named(stream, chunk, places), pa.array(keys.view(np.int64))], ["lang", "phrase", "key"])

    # most candidates are a run somewhere, and runs are distinct
    words = F.split("run", " ")
    own = written(runs.where(F.size(words).between(2, LONGEST)).mapInArrow(alone, "lang string, phrase string, key long"), "own-runs")
    runs_known = KeyBlocks(own.select("key", F.lit(1).cast("long").alias("value"))).finder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(batches, size, named=True)
        known = np.zeros(0, np.uint64)
        for chunk in stream:
            pair, three, four = reached(chunk)
            places = []
            for k, may, longer in ((2, pair, three), (3, three, four), (4, four, four[:0])):
                # what lies in a longer one at this place comes with it
                alone = may & chunk.ends_new(k)
                alone[: len(longer)] &= ~(longer & chunk.ends_new(k + 1) if len(longer) else longer)
                alone[1 : len(longer) + 1] &= ~longer
                at = np.flatnonzero(alone)
                found, first = np.unique(chunk.keys[k - 1][at], return_index=True)
                new = ~np.isin(found, known, assume_unique=True) & (runs_known.find(found) == 0)
                known = np.concatenate([known, found[new]])
                places.append(at[first[new]])
            if len(known) > 1 << 21:
                known = known[:0]  # some may be told again
            yield pa.RecordBatch.from_arrays(named(stream, chunk, places), ["lang", "phrase"])

    found = runs.mapInArrow(run, "lang string, phrase string").union(own.select("lang", "phrase")).distinct()
    # parts of a candidate may stand nowhere but in it
    words = F.split("phrase", " ")
    part = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return found.select("lang", F.explode(F.flatten(F.array(*[part(n) for n in range(1, LONGEST + 1)]))).alias("phrase")).distinct()


#: The automata of the block that a worker had last, by the block's number of broadcast.
_COMPILED: dict[int, dict[str, tuple[ahocorasick.Automaton, list[str]]]] = {}


def _compiled(by_lang: dict[str, list[str]]) -> dict[str, tuple[ahocorasick.Automaton, list[str]]]:
    found = {}
    for lang, phrases in by_lang.items():
        automaton = ahocorasick.Automaton()
        for no, phrase in enumerate(phrases):
            automaton.add_word(f" {phrase} ", no)
        automaton.make_automaton()
        found[lang] = (automaton, phrases)
    return found


def _automata(block) -> dict[str, tuple[ahocorasick.Automaton, list[str]]]:
    if block.id not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[block.id] = _compiled(block.phrases.value)
    return _COMPILED[block.id]


class _Block:
    def __init__(self, no: int, phrases):
        self.id, self.phrases = no, phrases


class _Counts:
    """How often a block's phrases stand in runs (lang, run, n), overlaps included, each n times."""

    def __init__(self, automata: dict[str, tuple[ahocorasick.Automaton, list[str]]], join_chars: int):
        self.automata, self.join_chars = automata, join_chars
        self.counts = {lang: np.zeros(len(phrases), np.int64) for lang, (_, phrases) in automata.items()}
        self.waiting: dict[tuple[str, int], list[str]] = {}
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        for lang in self.automata:
            own = part.filter(pc.equal(part.column(0), lang))
            once = pc.equal(own.column(2), 1)
            if told := own.column(1).filter(once).to_pylist():
                self.waiting.setdefault((lang, 1), []).extend(told)
                self.size += sum(map(len, told))
            for told, n in zip(own.column(1).filter(pc.invert(once)).to_pylist(), own.column(2).filter(pc.invert(once)).to_pylist(), strict=True):
                self.waiting.setdefault((lang, n), []).append(told)
                self.size += len(told)
        if self.size >= self.join_chars:
            self._search()

    def _search(self) -> None:
        for (lang, n), told in self.waiting.items():
            text = " \n ".join(["", *told, ""])
            walk, counts = self.automata[lang][0].iter(""), self.counts[lang]
            for at in range(0, len(text), self.join_chars):
                walk.set(text[at : at + self.join_chars])  # goes on where the last part ended
                found = np.fromiter(map(itemgetter(1), walk), np.int64)
                if len(found) > 1000:
                    counts += n * np.bincount(found, minlength=len(counts))
                else:
                    np.add.at(counts, found, n)
        self.waiting.clear()
        self.size = 0

    def told(self) -> Iterator[pa.RecordBatch]:
        self._search()
        for lang, (_, phrases) in self.automata.items():
            found = np.flatnonzero(self.counts[lang]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([phrases[no] for no in found], pa.string()), pa.array(self.counts[lang][found])], ["lang", "phrase", "f"])


def scan_counts(runs: DataFrame, block: _Block, join_chars: int = 1 << 20) -> DataFrame:
    """``lang, phrase, f``: all occurrences in ``runs`` (lang, run, n) of a block's phrases, overlaps included, each n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(_automata(block), join_chars)
        for part in row_slices(batches, 1 << 14):
            counts.add(part)
        yield from counts.told()

    return runs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def dealt_counts(runs: DataFrame, told: DataFrame, blocks: int, most: int = 1 << 20, join_chars: int = 1 << 20) -> DataFrame:
    """What ``scan_counts`` gives of all blocks, in one pass: phrases go to the block of their first two words and a run only to the blocks
    of its pairs, so that the work doesn't grow with the number of blocks times the runs. A block with over ``most`` runs
    is dealt over several tasks, which all get its phrases. Single words are summed without an automaton."""
    block = lambda lang, pair: F.pmod(F.xxhash64(lang, pair), F.lit(blocks)).cast("int")
    words = F.split("phrase", " ")
    phrases = told.where(F.size(words) > 1).select("lang", "phrase", block(F.col("lang"), F.array_join(F.slice(words, 1, 2), " ")).alias("block"))
    parts = F.split("run", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: block(F.col("lang"), F.concat_ws(" ", F.element_at(parts, i), F.element_at(parts, i + 1))))
    placed = runs.where(F.size(parts) > 1).select("lang", F.col("run").alias("phrase"), "n", F.explode(F.array_distinct(pairs)).alias("block"))
    tasks = written(placed.groupBy("block").agg(F.ceil(F.count("*") / most).cast("int").alias("tasks")), "block-tasks")
    share = F.pmod(F.xxhash64("phrase"), F.col("tasks")).cast("int")
    texts = placed.join(F.broadcast(tasks), "block").select("block", share.alias("task"), "lang", "phrase", "n")
    every = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))
    asked = phrases.join(F.broadcast(tasks), "block").select("block", every.alias("task"), "lang", "phrase", F.lit(None).cast("long").alias("n"))
    # the phrases of a block come before its runs
    dealt = asked.unionByName(texts).repartition("block", "task").sortWithinPartitions("block", "task", F.col("n").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, waiting = None, None, {}
        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).is_null().to_numpy(zero_copy_only=False)])
            edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                if own != (key := tuple(place[:2, a].tolist())):
                    if counts:
                        yield from counts.told()
                    own, counts, waiting = key, None, {}
                part = batch.slice(a, b - a)
                if place[2, a]:
                    for lang, phrase in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                        waiting.setdefault(lang, []).append(phrase)
                elif waiting or counts:
                    counts = counts or _Counts(_compiled(waiting), join_chars)
                    waiting = {}
                    counts.add(part.select(["lang", "phrase", "n"]))
        if counts:
            yield from counts.told()

    many = dealt.mapInArrow(run, "lang string, phrase string, f long")
    single = runs.select("lang", F.explode(parts).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    alone = told.where(F.size(words) == 1).join(single, ["lang", "phrase"])
    return many.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).unionByName(alone.select("lang", "phrase", "f"))


#: Blocks of phrases from which on runs are dealt to them, in place of a pass over all runs for each.
DEALT_BLOCKS = 8


def count_phrases(runs: DataFrame, told: DataFrame, block_chars: int) -> DataFrame:
    """``lang, phrase, f`` of the phrases of ``told`` (lang, phrase) that occur in ``runs``: block by block if there are few, else with the runs dealt to the blocks."""
    spark = runs.sparkSession
    total = told.agg(F.sum(F.char_length("phrase") + 2)).first()[0] or 0
    blocks = -(-total // block_chars)
    if blocks >= DEALT_BLOCKS:
        return dealt_counts(runs, told, blocks)
    path = scratch_path(spark, "phrases")
    dealt = told.select("lang", "phrase", F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, blocks))).cast("int").alias("block"))
    dealt.write.partitionBy("block").parquet(f"{path}/told")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/told")
    parts = []
    for no in range(blocks):
        by_lang: dict[str, list[str]] = {}
        for lang, phrase in stored.where(F.col("block") == no).select("lang", "phrase").collect():
            by_lang.setdefault(lang, []).append(phrase)
        phrases = spark.sparkContext.broadcast(by_lang)
        scan_counts(runs, _Block(phrases._jbroadcast.id(), phrases)).write.parquet(f"{path}/counts-{no}")
        phrases.unpersist()
        parts.append(spark.read.schema("lang string, phrase string, f long").parquet(f"{path}/counts-{no}"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "lang string, phrase string, f long")


def _big(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def best_cuts(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two and more words of ``(lang, phrase, f)``: their lowest-scoring cut."""
    words = F.split("phrase", " ")
    key = lambda lang, phrase: F.concat(lang, F.lit("\t"), phrase)
    size = F.size(words)
    joined = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(F.struct((k * 2).alias("no"), joined(F.lit(1), k).alias("part")), F.struct((k * 2 + 1).alias("no"), joined(k + 1, size - k).alias("part")))))
    many = phrases.where(size > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(parts).alias("p")).select("lang", "phrase", "a", "p.no", key(F.col("lang"), F.col("p.part")).alias("part"))
    one = phrases.select(key(F.col("lang"), F.col("phrase")).alias("part"), "f")
    hot = hot_blocks(many.groupBy("part").agg(F.count("*").alias("n")), "part", 10_000)
    whole = join_dealt(many, one, "part", hot, ["lang", "phrase", "no"])
    f = lambda no: F.max(F.when(F.col("no") == no, F.col("f")))
    held = whole.groupBy("lang", "phrase", "a").agg(*[f(no).alias(f"f{no}") for no in range(2, 2 * LONGEST)])
    score = lambda left, right: F.expr(f"(cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0))) div (cast({left} as decimal(19,0)) + cast({right} as decimal(19,0)))")
    cuts = [F.when(F.col(f"f{2 * k}").isNotNull(), F.struct(score(f"f{2 * k}", f"f{2 * k + 1}").alias("score"), F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))) for k in range(1, LONGEST)]
    return held.withColumn("cut", F.array_min(F.array_compact(F.array(*cuts)))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def absorbed(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, most``: the phrases of two and more words inside longer ones of ``(lang, phrase, f)``, and the
    largest count of such a longer one."""
    words = F.split("phrase", " ")
    size = F.size(words)
    inner = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    inside = F.when(size == 3, inner(2)).when(size == 4, F.concat(inner(2), inner(3)))
    return phrases.where(size > 2).select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def first_ranks(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``. They are looked for in shares of each language
    first, so that no task holds a language."""
    shares = max(1, isqrt(rows.count() // top))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, top: int = 2000, cell_bits: int | None = None, block_chars: int = 3_000_000, chunk_tokens: int = 1 << 19) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Texts are lower-cased in A-Z, cut at ``.,;:!?`` and line ends, and split at blanks and tabs; a null text is empty and a
    null language is ``und``. A candidate has two to four words and occurs ``min_count`` times in its language, overlaps
    and repeated rows included; its score is that of its lowest cut, floor(2000000 a / (l + r)). Candidates inside
    a longer one with at least 80 % of their count are dropped. Ties go by count, then by the phrase's bytes. Texts
    without any candidate, and empty tables, give no rows. Other columns are not read.

    ``cell_bits``: the sketch's cells as a power of two, by default over one a byte of text; ``block_chars``: the characters of
    candidates that an automaton may hold; ``chunk_tokens``: the words that a task counts at once.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    if cell_bits is None:
        volume = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        cell_bits = max(RANGE_BITS, int(volume).bit_length())

    def short_keys(chunk: _Chunk) -> list[tuple[np.ndarray, None]]:
        which = [chunk.ends_new(k) for k in (1, 2)]
        return [(chunk.keys[k][w], None) for k, w in enumerate(which)]

    short = sketch(rows, short_keys, 2, cell_bits, min_count, chunk_tokens)
    found = written(text_runs(rows, short, chunk_tokens), "runs")
    runs = found.where("run is not null")
    told = written(candidates(runs, min_count, cell_bits, chunk_tokens), "candidates")
    counted = written(count_phrases(runs, told, block_chars).where(F.col("f") >= min_count), "counted")
    held = best_cuts(counted).join(absorbed(counted), ["lang", "phrase"], "left")
    dropped = _big(F.col("most")) * 100 >= _big(F.col("a")) * 80
    stays = held.where(~F.coalesce(dropped, F.lit(False))).drop("most")
    best = first_ranks(stays, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    sizes = found.where("run is null").select("lang", "n")
    return best.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
