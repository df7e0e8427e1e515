"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint has 64 bits. It is cut into segments; by the pigeonhole
principle, radii r_i with sum(r_i + 1) = distance + 1 make sure that two
fingerprints within the distance differ by at most r_i bits in some segment i.
Every fingerprint is stored once per segment under its exact segment value, and
probes the Hamming ball of radius r_i around it; what meets in a bucket is
verified on the whole fingerprint.

Hot groups: equal fingerprints are one node, so copies cost nothing. A bucket
returns a spanning forest of its verified links, never all pairs, and a bucket
with over ``max(hot_rows, rows / 1000)`` stored fingerprints, or sixteen times as many
probes, is dealt out in a grid of blocks of stored ones and blocks of probes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, hot_blocks, join_dealt, row_slices, utf8
from .components import connected_components
from .text_kernels import Powers, RollingHash, WordHashes, mix

BITS = 64
#: Buckets with more stored fingerprints than this link each node with the least one that it is joined with there,
#: the others all pairs; both ways join the same nodes.
FEW_STORED = 8
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: bytes, shingle_words: int, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included.

    Fewer words than a shingle: the whole sequence is one shingle; no words: 0.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle_words + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle_words - 1 :].tolist(), strict=True)],
        np.uint64,
        len(starts),
    )
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``(doc_id, fp)``; one row for each row of ``docs``, null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            fps = np.array([fingerprint(t, shingle_words) for t in utf8(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Segment:
    """``width`` bits from ``shift`` on of fingerprint column ``column``, probed within ``radius``."""

    column: str
    shift: int
    width: int
    radius: int


def plan_segments(distance: int, nodes: int, bits: int = BITS) -> list[Segment]:
    """Segments of one 64-bit fingerprint that find all within ``distance``; the first have the wider balls.

    Every number of segments finds them all. Fewer ones have larger balls (more rows), more ones have
    narrower keys (more comparisons in a bucket); the cheapest for ``nodes`` is taken, at 100 comparisons a row.
    """
    plans = []
    for count in range(1, max(1, distance) + 1):
        spare = distance - count + 1
        widths = [bits // count + (i >= count - bits % count) for i in range(count)]
        plan = [Segment("fp", sum(widths[:i]), width, max(0, spare // count + (i < spare % count))) for i, width in enumerate(widths)]
        plans.append((sum(_ball_size(s) * (1 + nodes / 2**s.width / 100) for s in plan), plan))
    return min(plans, key=lambda p: p[0])[1]


def _ball_size(s: Segment) -> int:
    return sum(comb(s.width, r) for r in range(s.radius + 1))


def _ball(s: Segment) -> list[int]:
    """The masks that lead from a segment's value to the others of its Hamming ball."""
    return [sum(1 << b for b in bits) for r in range(1, s.radius + 1) for bits in combinations(range(s.width), r)]


def _bucket_key(segment: int, value: F.Column) -> F.Column:
    return F.shiftleft(value, 6).bitwiseOR(F.lit(segment).cast("long"))


def _segment_value(s: Segment) -> F.Column:
    return F.shiftrightunsigned(s.column, s.shift).bitwiseAND(F.lit((1 << s.width) - 1).cast("long"))


def _stored_keys(plan: list[Segment]) -> F.Column:
    return F.array(*[_bucket_key(no, _segment_value(s)) for no, s in enumerate(plan)])


def _ball_keys(plan: list[Segment]) -> F.Column:
    """Keys of the Hamming balls around a fingerprint's segments, without the centres."""

    def keys(no: int, s: Segment) -> F.Column:
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(s)]).cast("array<bigint>")
        return F.transform(masks, lambda mask: _bucket_key(no, _segment_value(s).bitwiseXOR(mask)))

    return F.concat(*[keys(no, s) for no, s in enumerate(plan)])


def _dealt(exact: DataFrame, balls: DataFrame, plan: list[Segment], most: int) -> DataFrame:
    """Stored rows and probes with the ``block`` of their bucket that they go to.

    A key with over ``most`` stored rows, or 16 times as many probes from neighbours like that, gets a grid:
    each stored row meets each probe in one block. There are under 1000 such neighbours for a segment if ``most``
    is a thousandth of the nodes or more, and the grids are at most a ball's size times as many."""
    columns = [c for c in exact.columns if c != "key"]
    both = exact.withColumn("stored", F.lit(True)).union(balls.withColumn("stored", F.lit(False)))
    hot = exact.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()
    if not hot:
        return both.withColumn("block", F.lit(0))
    stored = {r.key: r.n for r in hot}
    probes = dict(stored)
    for key, n in stored.items():
        for mask in _ball(plan[key & 63]):
            probes[key ^ mask << 6] = probes.get(key ^ mask << 6, 0) + n
    grid = [(key, -(-stored.get(key, 1) // most), -(-n // (16 * most))) for key, n in probes.items()]
    grid = [g for g in grid if g[1] > 1 or g[2] > 1]
    grids = F.broadcast(exact.sparkSession.createDataFrame(grid, "key long, across int, down int"))
    words = [c for c in columns if c not in ("node", "tree")]
    rows = both.join(grids, "key", "left").withColumns({"across": F.coalesce("across", F.lit(1)), "down": F.coalesce("down", F.lit(1))})
    rows = rows.withColumns({"i": F.pmod(F.xxhash64(*words), F.col("across")), "j": F.pmod(F.xxhash64(*words, F.lit(1)), F.col("down"))})
    # as a probe in all blocks of stored rows; as a stored row in all blocks of probes
    cell = lambda i, j, held: F.struct((i * F.col("down") + j).cast("int").alias("block"), held.alias("stored"))
    probing = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda x: cell(x, F.col("j"), F.col("stored") & (x == F.col("i"))))
    holding = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda x: cell(F.col("i"), x, F.lit(True)))
    holding = F.filter(holding, lambda c: F.col("stored") & (c["block"] != F.col("i") * F.col("down") + F.col("j")))
    return rows.withColumn("cell", F.explode(F.concat(probing, holding))).select("key", *columns, F.col("cell.stored").alias("stored"), F.col("cell.block").alias("block"))


def near_links(nodes: DataFrame, plan: list[Segment], distance: int, hot_rows: int = 8192) -> DataFrame:
    """Links ``(a, b)`` that join the nodes ``(node, fingerprint columns)`` which share a bucket and are within
    ``distance`` bits in all, or which others in it join by such steps.

    A node of a large group is met in a hundred buckets, in each with another least node. Of its links
    only that to the least of these is kept, and the others are linked with that one: as many links as
    nodes and pairs of least nodes, not as nodes and buckets. What comes together there is one node's links
    to smaller ones, of which a bucket has one (or a few stored ones)."""
    words = list(dict.fromkeys(s.column for s in plan))
    nodes = nodes.select("node", *words)
    exact = nodes.select("node", *words, F.explode(_stored_keys(plan)).alias("key"))
    balls = nodes.select("node", *words, F.explode(_ball_keys(plan)).alias("key"))
    most = max(hot_rows, -(-nodes.count() // 1000))
    dealt = _dealt(exact, balls, plan, most).select("key", "block", "node", "stored", *words)
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    kind = nodes.schema["node"].dataType.simpleString()
    met = dealt.mapInArrow(_bucket_links(distance), f"a {kind}, b {kind}")
    below = met.groupBy("b").agg(F.collect_set("a").alias("below")).select("b", "below", F.array_min("below").alias("least"))
    others = F.transform(F.filter("below", lambda x: x != F.col("least")), lambda x: F.struct(F.col("least").alias("a"), x.alias("b")))
    links = F.concat(F.array(F.struct(F.col("least").alias("a"), F.col("b").alias("b"))), others)
    return below.select(F.explode(links).alias("link")).select("link.*").distinct()


def _distance(fps: list[np.ndarray], i: np.ndarray | slice, j: np.ndarray | int) -> np.ndarray:
    return sum(np.bitwise_count(fp[i] ^ fp[j]).astype(np.int16) for fp in fps)


def _bucket_links(distance: int) -> Callable:
    """Streams sorted buckets; the rows of the last key of a batch wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(same))
            if held and not cut and rows[0][0] == held[-1][0][-1] and rows[1][0] == held[-1][1][-1]:
                held.append(rows)  # one bucket all through
                continue
            yield from emit([np.concatenate(c) for c in zip(*held, [c[:cut] for c in rows], strict=True)])
            held = [[c[cut:] for c in rows]]
        if held:
            yield from emit([np.concatenate(c) for c in zip(*held, strict=True)])

    def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, block, node, stored, *words = rows
        if len(key) < 2:
            return
        fps = [w.view(np.uint64) for w in words]
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        held_by = np.add.reduceat(stored, starts, dtype=np.int64)
        owner = np.repeat(np.arange(len(starts)), sizes)
        # buckets with few stored fingerprints: each of these with every row of its bucket
        at = np.flatnonzero(stored)
        at = at[(held_by[owner[at]] <= FEW_STORED) & (sizes[owner[at]] > 1)]
        ends = np.cumsum(sizes[owner[at]])
        found = []
        for part in np.split(at, np.flatnonzero(np.diff(ends // PAIRS_AT_ONCE)) + 1):
            many = sizes[owner[part]]
            i = np.repeat(part, many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[owner[part]], many)
            near = _distance(fps, i, j) <= distance
            found.append(np.stack([node[i[near]], node[j[near]]], 1))
        for g in np.flatnonzero(held_by > FEW_STORED):
            span = slice(starts[g], starts[g] + sizes[g])
            found.append(_forest(node[span], [fp[span] for fp in fps], stored[span], distance))
        pairs = np.concatenate(found) if found else np.empty((0, 2), node.dtype)
        pairs = np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)
        for i in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 50_000, 0]), pa.array(pairs[i : i + 50_000, 1])], ["a", "b"])

    return run


def _forest(node: np.ndarray, fps: list[np.ndarray], stored: np.ndarray, distance: int) -> np.ndarray:
    """Links of each node of a bucket with the least one that it is joined with by links of stored nodes."""
    order = np.argsort(node, kind="stable")
    node, fps, stored = node[order], [fp[order] for fp in fps], stored[order]
    parent = np.arange(len(node))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for no, t in enumerate(np.flatnonzero(stored).tolist()):
        near = np.flatnonzero(_distance(fps, slice(None), t) <= distance)
        near = near[parent[near] != parent[t]]
        for j in near.tolist():
            a, b = root(t), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if no % 16 == 0:
            parent[:] = _flattened(parent)
    return np.stack([node[_flattened(parent)], node], 1)


def _flattened(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    distance: int = 4,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Documents link when their fingerprints differ in at most ``distance`` bits; the
    component is the least ``doc_id`` reachable. Null texts count as empty, and all
    texts without words share fingerprint zero. Rows with a null ``doc_id`` link like others;
    a component has the least of its other ids (null if none). Repeated rows are
    returned as often as they come. Other columns of ``docs`` are not read.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    plan = plan_segments(distance, nodes.count())
    reached = connected_components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), plan, distance))
    labelled = _least_of_each(nodes.withColumn("node", F.col("fp")), reached).select("fp", "component_id")
    return fps.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _least_of_each(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """``nodes``, ``(node, least, ..)``, with the least id of their component as ``component_id``."""
    grouped = nodes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return grouped.join(least, "component")


#: Of two texts with Jaccard similarity 0.8, at most about this share of SimHash bits differs: acos(cosine) / pi,
#: for sets of equal size (0.1476 if one holds the other).
DIFFERING_AT_MOST = 0.1515


def plan_recall(nodes: int, recall: float = 0.95, words: int = 2, radius: int = 1, differing: float = DIFFERING_AT_MOST) -> list[Segment]:
    """Segments that find a pair with the ``differing`` share of bits with probability ``recall``.

    A segment is as wide as it takes for a bucket to hold about four of ``nodes``, 16 bits at least."""
    width = min(32, max(16, nodes.bit_length() - 2))
    hit = sum(comb(width, r) * differing**r * (1 - differing) ** (width - r) for r in range(radius + 1))
    wanted = max(1, -(-log(1 - recall) // log(1 - hit)))
    each = BITS // width
    words = max(words, int(-(-wanted // each)))
    return [Segment(f"fp{no // each}", no % each * width, width, radius) for no in range(min(int(wanted), each * words))]


def candidate_distance(bits: int, differing: float = DIFFERING_AT_MOST, sigmas: float = 4.0) -> int:
    """Bits that a pair may differ in to be verified: ``sigmas`` over what a pair that is just similar enough differs in."""
    return int(bits * differing + sigmas * (bits * differing * (1 - differing)) ** 0.5)


def _shingle_hashes(text: bytes, shingle_words: int, hashes: WordHashes, powers: Powers) -> np.ndarray:
    words = text.lower().split()
    return RollingHash(hashes.of(words), powers).windows(min(shingle_words, len(words))) if words else np.empty(0, np.uint64)


def _text(text_col: str) -> F.Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def text_copy(text: F.Column) -> F.Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text))


def long_fingerprints(docs: DataFrame, words: int, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, copy, n, fp0, fp1, ..)``: SimHash of 64 * ``words`` bits over the set of ``n`` shingles; ``copy`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for part in row_slices(batches):
            fps, sizes = np.zeros((part.num_rows, words), np.uint64), np.zeros(part.num_rows, np.int64)
            for i, text in enumerate(utf8(part.column(2))):
                h = np.unique(_shingle_hashes(text, shingle_words, hashes, powers))
                sizes[i] = len(h)
                for no in range(words if len(h) else 0):
                    ones = np.zeros(BITS, np.int64)
                    for k in range(0, len(h), 1 << 16):
                        ones += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    fps[i, no] = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")
                    h = mix(h + np.uint64(no + 1))
            columns = [part.column(0), part.column(1), pa.array(sizes), *(pa.array(fps[:, no].view(np.int64)) for no in range(words))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "n", *(f"fp{no}" for no in range(words))])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_copy(_text(text_col)).alias("copy"), _text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, copy binary, n long, " + ", ".join(f"fp{no} long" for no in range(words)))


def _shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """``texts`` with the sorted distinct shingle hashes, eight bytes each, in place of their last column, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for part in row_slices(batches):
            made = [np.unique(_shingle_hashes(t, shingle_words, hashes, powers)).tobytes() for t in utf8(part.column(part.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.binary())], [*part.schema.names[:-1], "shingles"])

    return texts.mapInArrow(run, texts.drop("text").withColumn("shingles", F.lit(b"")).schema)


class GroupLinks:
    """Verified links of one group, a spanning forest of them: nodes within ``distance`` bits whose shingle
    sets have the Jaccard ``similarity``. Pairs that are joined already aren't looked at; of the others
    the nearest by fingerprint come first, and all have their turn."""

    def __init__(self, similarity: float, distance: int):
        self.similarity, self.distance = similarity, distance

    def hold(self, node: np.ndarray, fps: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[tuple]:
        """Takes the nodes to compare with and gives the links among them."""
        self.node, self.fps = node, fps
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.member = np.zeros(len(self.known), bool)
        self.tree = np.arange(len(node))
        for i in range(1, len(node)):
            own = self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]
            yield from self._links(i, int(self.tree[i]), [fp[i] for fp in fps], own, int(self.sizes[i]), node[i])

    def meet(self, node: int, fps: list[np.uint64], shingles: np.ndarray) -> Iterator[tuple]:
        """Links of one more node, which isn't kept, with those that are held."""
        at = np.minimum(np.searchsorted(self.known, shingles), max(0, len(self.known) - 1))
        own = at[self.known[at] == shingles] if len(self.known) else at[:0]
        yield from self._links(len(self.node), -1, fps, own, len(shingles), node)

    def _links(self, before: int, tree: int, fps: list[np.uint64], own: np.ndarray, size: int, node: int) -> Iterator[tuple]:
        far = sum(np.bitwise_count(held[:before] ^ fp).astype(np.int16) for held, fp in zip(self.fps, fps, strict=True))
        sizes = self.sizes[:before]
        met = np.flatnonzero((far <= self.distance) & (self.tree[:before] != tree) & (np.minimum(sizes, size) >= self.similarity * np.maximum(sizes, size)))
        met = met[np.argsort(far[met], kind="stable")]
        self.member[own] = True
        step = 8
        while len(met):
            part, met = met[:step], met[step:]
            both = self._shared(part)
            for j in part[both >= self.similarity * (self.sizes[part] + size - both)].tolist():
                if self.tree[j] != tree:
                    yield node, self.node[j]
                    if tree >= 0:
                        self.tree[self.tree == self.tree[j]] = tree
                    tree = int(self.tree[j])
            met = met[self.tree[met] != tree]
            step = min(4 * step, 4096)
        self.member[own] = False

    def _shared(self, part: np.ndarray) -> np.ndarray:
        sizes = self.sizes[part]
        at = np.repeat(self.starts[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(np.repeat(np.arange(len(part)), sizes), self.member[self.ids[at]], len(part))


def _verified(similarity: float, distance: int, words: int) -> Callable:
    """Streams sorted rows ``(group, block, visits, node, fp.., shingles)``: the nodes of a block, then its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, links, waiting, found = None, GroupLinks(similarity, distance), [], []

        def settle() -> None:
            if waiting:
                node, sets = np.array([w[0] for w in waiting]), [w[2] for w in waiting]
                found.extend(links.hold(node, [np.array([w[1][k] for w in waiting]) for k in range(words)], sets))
                waiting.clear()

        for batch in batches:
            group, block, visits, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            fps = [c.to_numpy().view(np.uint64) for c in batch.columns[4 : 4 + words]]
            for i in range(batch.num_rows):
                if (key := (group[i], block[i])) != at:
                    settle()
                    at = key
                shingles = np.frombuffer(batch.column(4 + words)[i].as_py(), np.uint64)
                own = [fp[i] for fp in fps]
                if visits[i]:
                    settle()
                    found.extend(links.meet(node[i], own, shingles))
                else:
                    waiting.append((node[i], own, shingles))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
                found = []
        settle()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _blocks_met(block: F.Column, blocks: F.Column) -> F.Column:
    """The blocks that a row of ``block`` visits: of ``blocks`` in a ring half of those before it, so that each two meet once."""
    half = F.floor((blocks - 1) / 2).cast("int")
    opposite = (blocks % 2 == 0) & (block < blocks / 2)
    steps = F.sequence(F.lit(0), half + F.when(opposite, 1).otherwise(0))
    return F.transform(F.filter(steps, lambda d: d > 0), lambda d: F.pmod(block - d, blocks).cast("int"))


def _verify_groups(nodes: DataFrame, groups: DataFrame, texts: DataFrame, shingle_words: int, similarity: float, distance: int, words: int, block_bytes: int) -> DataFrame:
    """Links ``(a, b)`` between nodes of one group (``groups``: node, component) whose texts are similar enough.

    A group is dealt into blocks of about ``block_bytes`` of shingles; a task holds one block, and rows of others pass by."""
    fps = [f"fp{no}" for no in range(words)]
    grouped = checkpointed(nodes.join(groups.withColumnRenamed("component", "group"), "node").select("group", "node", "copy", "least", "n", *fps))
    sizes = checkpointed(grouped.groupBy("group").agg(F.count("*").alias("n"), F.ceil(F.sum("n") * 8 / block_bytes).cast("int").alias("parts")))
    hot = hot_blocks(sizes.select("group", "n"), "group")
    sized = sizes.select("group", F.greatest("parts", F.lit(1)).alias("parts"))
    placed = join_dealt(grouped.drop("n"), sized, "group", hot, ["node"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # the text of a node is that of one document, so that copies don't gather
    held = texts.join(placed, (F.col("text_copy") == F.col("copy")) & F.col("text_id").eqNullSafe(F.col("least"))).dropDuplicates(["node"])
    sets = _shingle_sets(held.select("group", "own", "parts", "node", *fps, "text"), shingle_words)
    seat = lambda block, visits: F.struct(block.alias("block"), visits.alias("visits"))
    seats = F.concat(F.array(seat(F.col("own"), F.lit(False))), F.transform(_blocks_met(F.col("own"), F.col("parts")), lambda b: seat(b, F.lit(True))))
    rows = sets.withColumn("seat", F.explode(seats)).select("group", "seat.block", "seat.visits", "node", *fps, "shingles")
    rows = rows.repartition("group", "block").sortWithinPartitions("group", "block", "visits")
    return rows.mapInArrow(_verified(similarity, distance, words), "a long, b long")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float, recall: float, block_bytes: int = 32 << 20) -> DataFrame:
    """``(doc_id, copy, component_id)`` for each row of ``docs``."""
    distinct = docs.select(F.xxhash64(_text(text_col)).alias("c")).agg(F.approx_count_distinct("c", 0.02)).first()[0]
    plan = plan_recall(max(1, distinct), recall)
    words = len({s.column for s in plan})
    fps = [f"fp{no}" for no in range(words)]
    rows = checkpointed(long_fingerprints(docs, words, shingle_words, id_col, text_col))
    own = rows.groupBy("copy").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", *fps)])
    nodes = checkpointed(own.withColumn("node", F.monotonically_increasing_id()))
    distance = candidate_distance(BITS * words)
    groups = connected_components(near_links(nodes, plan, distance))
    texts = docs.select(F.col(id_col).alias("text_id"), text_copy(_text(text_col)).alias("text_copy"), _text(text_col).alias("text"))
    reached = connected_components(_verify_groups(nodes, groups, texts, shingle_words, similarity, distance, words, block_bytes))
    labelled = _least_of_each(nodes, reached).select("copy", "component_id")
    return rows.select("doc_id", "copy").join(labelled, "copy")


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: float = 0.8,
    recall: float = 0.98,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """``(doc_id, component_id)`` of documents that are copies or near copies of one another.

    Near copies have a Jaccard similarity of ``similarity`` at least, over their sets of
    ``shingle_words`` words (fewer words: the whole text), A-Z lower-cased; this is verified on the
    texts. ``recall`` is how surely the index meets a pair that is just similar enough; pairs that are more
    alike are met almost surely. What the index joins is a group, and in a group every two texts within
    the distance are compared unless others join them already. Equal texts are one node, texts without words are equal; null texts count as empty. Rows with null ids link
    like others; a component has the least of its other ids (null if none).
    """
    return _groups(docs, id_col, text_col, shingle_words, similarity, recall, block_bytes).select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, recall: float = 0.98) -> DataFrame:
    """``docs`` without the rows whose group has a document of a smaller id. Rows with null ids stay, and so do
    repeated rows of a document that stays; of rows with one id and different texts each has its own group."""
    groups = _groups(docs, id_col, text_col, shingle_words, similarity, recall)
    gone, which = free_name(docs, "gone_id"), free_name(docs, "gone_copy")
    lost = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(gone), F.col("copy").alias(which)).distinct()
    return docs.join(lost, (F.col(id_col) == F.col(gone)) & (text_copy(_text(text_col)) == F.col(which)), "left_anti")
