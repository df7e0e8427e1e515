"""Tables of 64-bit keys that tasks look things up in, dealt by key range into broadcast blocks of bounded size.

Keys are hashes, so their leading bits deal them evenly. The number of blocks follows the number of keys and
the size of one doesn't; driver and tasks hold one block at a time. A task brings the distinct keys of a
bounded piece of its input, sorted, so each block meets only its own range of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path
from .text_kernels import mix


#: Bits of the sieve that stands before the blocks, as a power of two: 4 MB at any number of keys.
SIEVE_BITS = 25


def _hole(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def block_bits(rows: int, block_rows: int) -> int:
    """Leading bits that deal so many rows into blocks of about ``block_rows``."""
    return max(0, -(-rows // block_rows) - 1).bit_length()


def block_of(key: str, bits: int):
    """The block of a key column: its ``bits`` leading bits."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each block's range of sorted unsigned keys begins, and the end of the last."""
    if not bits:
        return np.array([0, len(keys)])
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def release(block: Broadcast) -> None:
    """Lets a worker forget a block; it can be read again from the worker's disk."""
    if getattr(block, "_path", None) is not None and hasattr(block, "_value"):
        del block._value


class KeyBlocks:
    """A distributed table ``(key long, value long)`` of distinct keys, for lookups in tasks."""

    def __init__(self, rows: DataFrame, block_rows: int = 1 << 19, n: int | None = None):
        spark = rows.sparkSession
        self.bits = block_bits(rows.count() if n is None else n, block_rows)
        path = scratch_path(spark, "key-blocks")
        rows = rows.select("key", "value", block_of("key", self.bits).alias("block"))
        rows.write.partitionBy("block").parquet(path)
        stored = spark.read.schema(rows.schema).parquet(path)
        self.blocks: list[Broadcast] = []
        sieve = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
        for no in range(1 << self.bits):
            part = stored.where(F.col("block") == no).select("key", "value").toArrow()
            keys = part.column("key").to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(keys)
            values = part.column("value").to_numpy().astype(np.int64)
            self.blocks.append(spark.sparkContext.broadcast((keys[order], values[order])))
            at = _hole(keys)
            np.bitwise_or.at(sieve, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        self.sieve = spark.sparkContext.broadcast(sieve)

    def finder(self) -> KeyFinder:
        return KeyFinder(self.blocks, self.bits, self.sieve)


class KeyFinder:
    """What goes to the tasks of a ``KeyBlocks``."""

    def __init__(self, blocks: list[Broadcast], bits: int, sieve: Broadcast):
        self.blocks, self.bits, self.sieve = blocks, bits, sieve

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        """False for most keys that are in no block; keys may repeat and come in any order."""
        at = _hole(keys)
        return (self.sieve.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of sorted distinct keys; 0 where there is none."""
        out = np.zeros(len(keys), np.int64)
        edges = ranges(keys, self.bits)
        for no, block in enumerate(self.blocks):
            low, high = edges[no], edges[no + 1]
            if low == high:
                continue
            known, values = block.value
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[low:high]), len(known) - 1)
                out[low:high] = np.where(known[at] == keys[low:high], values[at], 0)
            if len(self.blocks) > 1:
                release(block)
        return out
