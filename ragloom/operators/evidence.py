"""Evidences found in whole tables of documents, cut or changed ones too, without comparing every pair.

An evidence of m signs is found in a text that shares a run of L = 0.6 m signs with it. Cut into blocks of q signs from its start, with
2q - 1 <= L, every such run holds a whole block. So the blocks are looked for in the texts: a small bitmap of their hashes
drops most places where the texts lie, the others are joined with the blocks, and each place and block that agree
give a diagonal (place in the text less place in the evidence). The longest run of equal signs on
these diagonals is the longest common substring, as that lies on one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.operators.evaluation import EVIDENCE_CHARS, FOUND_FROM, SHORTEST_MATCH, _windows, evidence_key

#: Bits of the bitmap, as a power of two: half a megabyte at any number of evidences.
SIEVE_BITS = 22


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def longest_run(text: np.ndarray, part: np.ndarray, diagonals: list[int]) -> int:
    """Most equal signs in a row, the part being laid on the text at each of the diagonals."""
    best = 0
    for d in diagonals:
        low, high = max(0, -d), min(len(part), len(text) - d)
        if high - low <= best:
            continue
        differs = np.flatnonzero(part[low:high] != text[low + d : high + d])
        edges = np.concatenate([[-1], differs, [high - low]])
        best = max(best, int(np.diff(edges).max()) - 1)
    return best


def _needed(size: Column, found_from: float) -> Column:
    return F.greatest(F.ceil(F.round(size * found_from, 6)).cast("int"), F.least(F.lit(SHORTEST_MATCH), size))


def _block_hashes(rows: DataFrame, sizes: list[int], sieve: np.ndarray | None, id_kind: str) -> DataFrame:
    """``id, size, hash, at`` of runs of each of ``sizes`` signs of ``(id, key, q)``: with a sieve, of all places that pass it; else of
    the whole blocks of q signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, (text, q) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                told = points(text)
                for size in sizes if sieve is not None else [q]:
                    if len(told) < size:
                        continue
                    hashes = _windows(told, size)
                    if sieve is None:
                        at = np.arange(0, len(hashes), size)
                    else:
                        hole = _hole(hashes)
                        at = np.flatnonzero((sieve[hole >> 6] >> (hole & 63).astype(np.uint64)) & np.uint64(1))
                    if len(at):
                        same = pa.array(np.full(len(at), no))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(same), pa.array(np.full(len(at), size, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(at.astype(np.int64))], ["id", "size", "hash", "at"])

    return rows.mapInArrow(run, f"id {id_kind}, size int, hash long, at long")


def _hole(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def evidence_matches(docs: DataFrame, items: DataFrame, found_from: float = FOUND_FROM) -> DataFrame:
    """``doc_id, item_id, ratio`` of all documents (doc_id, text) and evidences (item_id, text) with a match ratio of ``found_from``
    on: the share of the evidence, of its first 800 signs, that their longest common substring has. White space and case
    don't count. Null and empty texts match nothing; rows that repeat an id count as their best one."""
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    keyed = items.select(F.col("item_id").alias("id"), F.substring(evidence_key(F.col("text")), 1, EVIDENCE_CHARS).alias("key")).where("key <> ''").distinct()
    half = F.floor((_needed(F.char_length("key"), found_from) + 1) / 2)
    keyed = keyed.withColumn("q", F.pow(F.lit(2.0), F.floor(F.log2(half))).cast("int"))
    sizes = sorted(r.q for r in keyed.select("q").distinct().collect())  # powers of two up to half of the longest evidence
    blocks = _block_hashes(keyed, sizes, None, item_kind).withColumnsRenamed({"id": "item_id", "at": "off"})
    spec = f"doc_id {doc_kind}, item_id {item_kind}, ratio double"
    if not sizes:
        return docs.sparkSession.createDataFrame([], spec)

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hole(batch.column(0).to_numpy().view(np.uint64)))], ["hole"])

    words = blocks.select("hash").mapInArrow(holes, "hole long").groupBy(F.floor(F.col("hole") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(hole, 64) as int))")).alias("bits")).collect()
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[[r.word for r in words]] = np.array([r.bits for r in words], np.int64).view(np.uint64)
    texts = docs.select(F.col("doc_id").alias("id"), evidence_key(F.col("text")).alias("key"), F.lit(0).alias("q")).where("key <> ''")
    places = _block_hashes(texts, sizes, sieve, doc_kind)
    diagonal = (F.col("at") - F.col("off")).alias("diagonal")
    met = places.join(blocks, ["size", "hash"]).select("id", "item_id", diagonal).distinct().groupBy("id", "item_id").agg(F.collect_list("diagonal").alias("diagonals"))
    told = met.join(keyed.select(F.col("id").alias("item_id"), F.col("key").alias("part")), "item_id").groupBy("id").agg(F.collect_list(F.struct("item_id", "part", "diagonals")).alias("met"))
    rows = texts.select("id", "key").join(told, "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, item, ratio = [], [], []
            for no, (text, met) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = points(text)
                for m in met:
                    part = points(m["part"])
                    run = longest_run(own, part, m["diagonals"])
                    if run >= min(SHORTEST_MATCH, len(part)) and run / len(part) >= found_from:
                        at.append(no), item.append(m["item_id"]), ratio.append(run / len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, batch.schema.field("met").type.value_type.field("item_id").type), pa.array(ratio, pa.float64())], ["doc_id", "item_id", "ratio"])

    return rows.mapInArrow(measure, spec).groupBy("doc_id", "item_id").agg(F.max("ratio").alias("ratio"))
