"""Substring de-duplication by seed and extend over winnowed anchors.

A window is ``window`` consecutive words. Its seed is the 8-gram of least hash in it
(winnowing), so equal windows have equal seeds at the same place, and consecutive
windows mostly share theirs: an occurrence of a seed with all the windows that it
stands for is an *anchor*. Anchors are joined by seed, never document by document:

1. Anchors extended both ways as far as their windows reach form a *block*. Blocks of
   equal seed and content are one class; if it has two occurrences all its windows repeat.
2. A seed with several classes may have equal windows in different ones, cut off where
   the texts part. Only there each class, not each occurrence, is extended word by word
   both ways: its windows are hashed one by one, and those that two classes share repeat.

Runs of repeated windows that touch are the maximal repeats. Rows are linear in the
anchors of the corpus whatever the size of a group of copies: no pair of occurrences is
made. Counts use partial aggregates, so a hot passage doesn't gather in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices, utf8, written
from .text_kernels import Powers, RollingHash, WordHashes, winnow

GRAM = 8


class _Anchors:
    """Anchors of texts; ``cut`` gives seed, block and place of each, ``window_hashes`` its windows."""

    def __init__(self, window: int):
        self.window, self.hashes, self.powers = window, WordHashes(), Powers()
        self.gram = min(GRAM, window)

    def rolling(self, words: list[bytes]) -> RollingHash:
        return RollingHash(self.hashes.of(words), self.powers)

    def cut(self, words: list[bytes]):
        """(rolling hash, first window, end window, seed place) or None for a short text."""
        if len(words) < self.window:
            return None
        rolling = self.rolling(words)
        seed = winnow(rolling.windows(self.gram), self.window - self.gram + 1)
        edge = np.flatnonzero(np.diff(seed)) + 1
        first = np.concatenate([[0], edge])
        end = np.concatenate([edge, [len(seed)]])
        return rolling, first, end, seed[first]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, text``: rows are told apart by a hash of id and text, equal rows are one text twice."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(window)
        for part in row_slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for row, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                if (cut := anchors.cut(text.split())) is None:
                    continue
                rolling, first, end, place = cut
                seed = rolling.spans(place, place + anchors.gram)
                # a block's hash also tells where its seed stands
                block = rolling.spans(first, end - 1 + window) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for column, values in zip(out, (seed.view(np.int64), block.view(np.int64), np.full(len(seed), row), first.astype(np.int32)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["seed", "block", "row", "first"])

    return rows.select("row", "text").mapInArrow(run, "seed long, block long, row long, first int")


def _class_windows(rows: DataFrame, window: int) -> DataFrame:
    """Extends the anchors that ``rows`` (text, firsts) names: ``(seed, block, hash, no)`` of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(window)
        for part in row_slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for text, named in zip(utf8(part.column(0)), part.column(1).to_pylist(), strict=True):
                rolling, first, end, place = anchors.cut(text.split())
                at = np.searchsorted(first, np.unique(named))
                size = end[at] - first[at]
                seed = np.repeat(rolling.spans(place[at], place[at] + anchors.gram), size)
                block = np.repeat(rolling.spans(first[at], end[at] - 1 + window) + (place[at] - first[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), size)
                no = np.arange(len(seed)) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(first[at], size) + no
                for column, values in zip(out, (seed.view(np.int64), block.view(np.int64), rolling.spans(start, start + window).view(np.int64), no.astype(np.int32)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["seed", "block", "hash", "no"])

    return rows.select("text", "firsts").mapInArrow(run, "seed long, block long, hash long, no int")


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """``(row, repeats)``: for each row with repeated windows the array of (start, size) of their runs,
    an entry for each anchor's run. ``rows`` is ``(doc_id, row, text)``."""
    found = _anchor_rows(rows, window)
    classes = written(found.groupBy("seed", "block").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("sample")), "window-classes")
    parted = classes.groupBy("seed").agg(F.count("*").alias("classes")).where("classes > 1").select("seed")
    samples = classes.join(parted, "seed", "left_semi").select("sample.*").groupBy("row").agg(F.collect_set("first").alias("firsts"))
    texts = rows.select("row", "text").join(samples, "row").dropDuplicates(["row"])
    windows = written(_class_windows(texts, window), "class-windows")
    shared = windows.groupBy("seed", "hash").agg(F.count("*").alias("n")).where("n > 1").select("seed", "hash")
    partial = windows.join(shared, ["seed", "hash"], "left_semi").groupBy("seed", "block").agg(F.array_sort(F.collect_set("no")).alias("nos"))
    full = classes.where("n > 1").select("seed", "block", F.lit(True).alias("all"))
    told = full.join(partial, ["seed", "block"], "full_outer").select("seed", "block", F.coalesce("all", F.lit(False)).alias("all"), "nos")
    hits = found.join(told, ["seed", "block"]).select("row", F.struct("first", "all", F.when(~F.col("all"), F.col("nos")).alias("nos")).alias("hit"))
    return hits.groupBy("row").agg(F.collect_set("hit").alias("hits"))  # equal rows name the same ones


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, spans)``, one row for each row of ``docs``; ``kept`` is the words
    that stay, joined by one space, and ``spans`` the maximal repeats that went: (start, end) in words.

    A word goes if a window that covers it has the same words as a window that starts anywhere else,
    in the same text included; windows are judged on the input. Null texts have no words. Equal rows
    repeat each other. Rows with null ids are texts like others. Other columns are not read.
    Windows are compared by 64-bit hashes within equal 64-bit seeds.
    """
    rows = _keyed(docs, id_col, text_col)
    hits = repeated_windows(rows, window)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(window)
        for part in row_slices(batches):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, named in zip(utf8(part.column(1)), part.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                found = _repeats(words, named, anchors, window) if named else []
                for start, end in reversed(found):
                    del words[start:end]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
                spans.append([{"start": a, "end": b} for a, b in found])
            columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "spans"])

    spec = f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
    return rows.join(hits, "row", "left").select("doc_id", "text", "hits").mapInArrow(run, spec)


def _repeats(words: list[bytes], named: list[dict], anchors: _Anchors, window: int) -> list[tuple[int, int]]:
    """Runs (start, end) of words that repeated windows cover."""
    _, first, end, _ = anchors.cut(words)
    cover = np.zeros(len(words) + window + 1, np.int64)
    at = np.searchsorted(first, [h["first"] for h in named])
    for hit, a in zip(named, at.tolist(), strict=True):
        if hit["all"]:
            cover[first[a]] += 1
            cover[end[a] - 1 + window] -= 1
        else:
            starts = first[a] + np.array(hit["nos"])
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
    edge = np.diff(np.concatenate([[0], np.cumsum(cover)[: len(words)] > 0, [0]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def kept_digest(kept: Column) -> Column:
    return F.sha2(kept, 256)


def sha256_hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
