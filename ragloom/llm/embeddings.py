"""Exact near-duplicate join of embeddings: a metric range join over pivot cells.

Unit vectors are points with the Euclidean metric, where cosine >= c is distance
<= r = sqrt(2 - 2c). Vectors of equal labels are dealt to the cell of their nearest
pivot. By the triangle inequality, a vector within r of a member of cell p lies at
most 2r further from p than from its own pivot, and, as the metric is Euclidean, at
most r beyond the bisecting hyperplane of the two pivots; it is replicated to the
cells for which both bounds hold. Cells then join independently.

The first level's pivots are bounded in number and broadcast; a cell that is still large gets
pivots of its own, which travel with its rows, and is dealt once more by the same two bounds.
Where vectors lie far apart in many dimensions, both bounds hold for most pivots, and copies cost more than
the comparisons they save: on a sample, each label takes as many of its pivots as make least work, or none.

Hot groups: equal vectors of a label are one row with a multiplicity. A cell that stays
large is dealt in blocks that each see the cell's other rows in turn, so no task holds
more than two blocks; a block returns counts and a spanning forest, never pairs. Pairs are compared
in single precision, and those within its error of the bound in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, StructType

from .common import checkpointed
from .components import connected_components

#: Pivots are this many at most in all, so that what every task reads of them is bounded.
MAX_PIVOTS = 4096
#: Comparisons that take as long as a further copy of a row.
COPY_PAIRS = 8192
#: Numbers of a block of rows.
BLOCK_NUMBERS = 1 << 20


def _usable(vector: F.Column) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _group(label: F.Column, kind: DataType) -> F.Column:
    """A string that is equal for equal labels of this type, and for no others."""
    if isinstance(kind, (FloatType, DoubleType)):
        return (label + F.lit(0.0).cast(kind)).cast("string")  # minus zero is zero
    if isinstance(kind, BinaryType):
        return F.hex(label)
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.to_json(F.struct(label))
    return label.cast("string")


def choose_pivots(points: DataFrame, cell_rows: int, max_pivots: int = MAX_PIVOTS) -> dict[tuple, np.ndarray]:
    """Unit pivots of each (group, dimension), picked by hash: about one for ``cell_rows`` vectors, two at least,
    and ``max_pivots`` in all at most; the rows that come to the driver are no more than twice as many."""
    return {key: some[:wanted] for key, (_, wanted, some) in _drawn_vectors(points, cell_rows, max_pivots).items()}


def _drawn_vectors(points: DataFrame, cell_rows: int, max_pivots: int) -> dict[tuple, tuple[int, int, np.ndarray]]:
    """For each (group, dimension) that gets pivots: its vectors, the pivots that are wanted, and a hash sample of twice as many and some."""
    # more groups than half the pivots: the largest ones get theirs, and the rest has cells of one group
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "label", "dim").limit(max_pivots // 2).collect()
    total = sum(r.n for r in sizes) or 1
    share = max_pivots - 2 * len(sizes)
    wanted = {(r.label, r.dim): (r.n, 2 + min(max(0, r.n // cell_rows - 2), share * r.n // total)) for r in sizes}
    if not wanted:
        return {}
    rows = [(r.label, r.dim, min(1.0, (2.0 * wanted[r.label, r.dim][1] + 12) / r.n)) for r in sizes]
    rate = F.broadcast(points.sparkSession.createDataFrame(rows, "label string, dim int, rate double"))
    drawn = points.join(rate, ["label", "dim"]).withColumn("h", F.xxhash64("node", F.lit(7)))
    drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("label", "dim", "h", "vector").toPandas()
    return {(k, int(d)): (*wanted[k, int(d)], _matrix(own.sort_values("h")["vector"])) for (k, d), own in drawn.groupby(["label", "dim"])}


def useful_pivots(some: np.ndarray, wanted: int, rows: int, radius: float, block_rows: int) -> np.ndarray:
    """The first vectors of a sample as pivots, ``wanted`` at most: as many as make least work of ``rows`` rows, and none where cells
    would only add copies. The rest of the sample tells how many cells a row goes to."""
    most = min(wanted, len(some) // 2)
    told, work = some[most:][:512], {0: rows + COPY_PAIRS * -(-rows // block_rows)}
    for n in sorted({most, *(1 << k for k in range(1, most.bit_length()))} - {0, 1}):
        copies = len(_homes(told, some[:n], radius)[0]) / len(told)
        cell = min(rows, rows * copies / n)
        work[n] = cell + COPY_PAIRS * copies * max(1, cell / block_rows)
    return some[: min(work, key=lambda n: (work[n], n))]


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.98,
    cell_rows: int = 1024,
    block_rows: int | None = None,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors with equal, non-null labels (of any type) and equal dimensions link at cosine >= ``min_cosine``,
    in double precision. Null or zero vectors, and those with null or non-finite components,
    link with nothing: they have no links and are their own component, as have rows with a null
    label. Rows with a null id link, but no component is named after them unless it has no other
    (then it is null, and nothing of it is kept). Rows that repeat an id count as vectors
    of their own. Other columns are not read. ``block_rows``: by default about a million numbers.
    """
    radius = float(np.sqrt(2 - 2 * min_cosine)) * (1 + 1e-9) + 1e-12
    label = _group(F.col(label_col), vectors.schema[label_col].dataType)
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", _usable(F.col("vector")) & F.col("label").isNotNull())
    rows = rows.withColumn("code", F.when(F.col("usable"), F.sha2(F.array_join(F.transform("vector", lambda x: F.hex(F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string"))), ","), 256)))
    points = rows.where("usable").groupBy("label", "code").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # numbered once and for all: the checkpoint keeps the numbers
    points = checkpointed(points.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}))
    linked = checkpointed(_cell_joins(points, radius, min_cosine, cell_rows, block_rows, max_pivots))
    counts = linked.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    reached = connected_components(linked.where("kind = 1").select("a", "b"))
    seen = points.select("label", "code", "node", "least", "copies").join(counts, "node", "left").join(reached, "node", "left")
    seen = seen.withColumn("component", F.coalesce("component", "node")).withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    least = seen.groupBy("component").agg(F.min("least").alias("component_id"))
    known = seen.join(least, "component").select("label", "code", "n_links", "component_id")
    single = ~F.col("usable")
    joined = rows.drop("vector").join(known, ["label", "code"], "left")
    return joined.select(
        "vec_id",
        F.when(single, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(single, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


DEALT = "label string, dim int, node long, copies long, vector array<double>, cell string, own boolean"
HOT_CELL = 16
SALT_ROWS = 1 << 16
#: The one cell of a group that no pivots help.
WHOLE = -1


def _homes(x: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, whether it is the row's nearest) of all cells that a row goes to."""
    d2 = np.maximum(2 - 2 * x @ centres.T, 0)
    d = np.sqrt(d2)
    home = d.argmin(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[home]
    near = np.arange(len(x)), home
    inside = (d <= d[near][:, None] + 2 * radius) & (d2 - d2[near][:, None] <= 2 * radius * between + 1e-9)
    inside[near] = True
    i, c = np.nonzero(inside)
    return i, c, c == home[i]


def _first_cells(points: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.to_pandas()
            take, cell, own = [], [], []
            for key, rows in frame.groupby(["label", "dim"]):
                at = rows.index.to_numpy()
                centres = pivots.get((key[0], int(key[1])))
                if centres is None or not len(centres):
                    i, c, mine = np.arange(len(at)), np.full(len(at), 0 if centres is None else WHOLE), np.ones(len(at), bool)
                else:
                    i, c, mine = _homes(_matrix(rows["vector"]), centres, radius)
                take.append(at[i]), cell.append(c), own.append(mine)
            take, cell, own = map(np.concatenate, (take, cell, own))
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(str)), pa.array(own)], [*part.schema.names, "cell", "own"])

    return points.select("label", "dim", "node", "copies", "vector").mapInArrow(cells, DEALT)


def _split_cells(dealt: DataFrame, large: DataFrame, cell_rows: int, most: int, radius: float, block_rows: int | None) -> DataFrame:
    """The rows of the cells of ``large``, (label, dim, cell, n), dealt once more: each of these cells has pivots
    of its own, one for ``cell_rows`` rows and ``most`` at most (fewer if that is less work), picked by hash from the rows that live there.

    A cell's pivots go before its rows, in each of the parts that a very large one is dealt in, so that a
    task keeps the pivots of one cell and a batch of its rows."""
    keys = ["label", "dim", "cell"]
    rows = dealt.join(large, keys).withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SALT_ROWS)).cast("int"))
    wanted = F.greatest(F.lit(2), F.least(F.lit(most), F.ceil(F.col("n") / cell_rows)))
    drawn = rows.where("own").withColumn("h", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)))
    # a few more than wanted by a threshold on the hash, then the least hashes
    drawn = drawn.where(F.col("h") < (4.0 * wanted + 12) / F.col("n") * (1 << 30))
    drawn = drawn.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "node"))).where(F.col("no") <= 2 * wanted)
    drawn = drawn.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALT_ROWS).cast("int") - 1)))
    columns = ["label", "dim", "node", "copies", "vector", "cell", "own", "salt", "n"]
    both = drawn.select(*columns, "no").union(rows.select(*columns, F.lit(None).alias("no")))
    both = both.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt", F.asc_nulls_last("no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, drawn, centres = None, [], None
        for batch in batches:
            frame = batch.to_pandas()
            for key, rows in frame.groupby([*keys, "salt"], sort=False):
                if key != at:
                    at, drawn, centres = key, [], None
                chosen = rows["no"].notna().to_numpy()
                if chosen.any():
                    drawn.append(_matrix(rows["vector"][chosen]))
                place = rows.index.to_numpy()[~chosen]
                if not len(place):
                    continue
                if drawn and centres is None:
                    some = np.concatenate(drawn)
                    centres = useful_pivots(some, -(-len(some) // 2), int(rows["n"].iloc[0]), radius, block_rows or _block_rows(int(key[1])))
                i, c, home = _homes(_matrix(rows["vector"][~chosen]), centres, radius) if centres is not None and len(centres) else (np.arange(len(place)), np.zeros(len(place), np.int64), np.ones(len(place), bool))
                part = batch.take(pa.array(place[i]))
                cell = [f"{key[2]}.{k}" for k in c.tolist()]
                own = frame["own"].to_numpy()[place[i]] & home
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(cell, pa.string()), pa.array(own)], part.schema.names[:7])

    return both.mapInArrow(run, DEALT)


def _block_rows(dim: int) -> int:
    return max(256, BLOCK_NUMBERS // dim)


def _cell_joins(points: DataFrame, radius: float, min_cosine: float, cell_rows: int, block_rows: int | None, max_pivots: int) -> DataFrame:
    keys = ["label", "dim", "cell"]
    pivots = {key: useful_pivots(some, wanted, n, radius, block_rows or _block_rows(key[1])) for key, (n, wanted, some) in _drawn_vectors(points, cell_rows, max_pivots).items()}
    dealt = checkpointed(_first_cells(points, pivots, radius))
    sizes = checkpointed(dealt.groupBy(*keys).agg(F.count("*").alias("n")))
    large = sizes.where((F.col("n") > HOT_CELL * cell_rows) & (F.col("cell") != str(WHOLE)))
    if not large.isEmpty():
        again = _split_cells(dealt, large, cell_rows, max_pivots, radius, block_rows)
        dealt = checkpointed(dealt.join(large, keys, "left_anti").unionByName(again))
        sizes = checkpointed(dealt.groupBy(*keys).agg(F.count("*").alias("n")))
    most = F.lit(block_rows) if block_rows else F.greatest(F.lit(256), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")))
    sized = sizes.withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    rows = dealt.join(sized.drop("n"), keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a task has two blocks, or one that meets itself; each pair of blocks is one task
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        x, node, own, copies = _matrix(rows["vector"]), rows["node"].to_numpy(), rows["own"].to_numpy(), rows["copies"].to_numpy()
        block = rows["block"].to_numpy()
        count, edges, forest = np.zeros(len(node), np.int64), [], Forest(len(node))
        for i, j in near_pairs(x, np.flatnonzero(block == low), np.flatnonzero(block == high), min_cosine):
            told = own[i] | own[j]
            i, j = i[told], j[told]
            # a vector counts its links in its own cell alone
            np.add.at(count, i, np.where(own[i], copies[j], 0))
            np.add.at(count, j, np.where(own[j], copies[i], 0))
            edges += forest.joined(i, j)
        found = np.flatnonzero(count)
        out = pd.DataFrame({"kind": 0, "a": node[found], "b": node[found], "n": count[found]})
        if edges:
            out = pd.concat([out, pd.DataFrame({"kind": 1, "a": node[[e[0] for e in edges]], "b": node[[e[1] for e in edges]], "n": 0})])
        return out

    return rows.groupBy("label", "dim", "cell", "low", "high").applyInPandas(join, "kind int, a long, b long, n long")


def near_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, min_cosine: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs of unit vectors of ``left`` and ``right``, which are the same or disjoint, each pair once."""
    same = len(left) and len(right) and left[0] == right[0]
    one = x.astype(np.float32)
    a, b = one[left], one[right]
    margin = (x.shape[1] + 8) * 2.0**-23  # twice the error of a product in single precision
    for start in range(0, len(left), rows):
        first = start if same else 0
        cosine = a[start : start + rows] @ b[first:].T
        at = np.flatnonzero(cosine.ravel() >= np.float32(min_cosine - 2 * margin))
        if not len(at):
            continue
        about = cosine.ravel()[at]
        i, j = at // cosine.shape[1], at % cosine.shape[1]
        kept = (j > i) if same else np.ones(len(i), bool)
        i, j, about = left[start + i[kept]], right[first + j[kept]], about[kept]
        unsure = np.flatnonzero(about <= min_cosine + 2 * margin)
        held = np.ones(len(i), bool)
        for low in range(0, len(unsure), 1 << 14):
            part = unsure[low : low + (1 << 14)]
            held[part] = (x[i[part]] * x[j[part]]).sum(axis=1) >= min_cosine
        yield i[held], j[held]


class Forest:
    """Groups of rows that are joined pair by pair; tells the pairs that joined two of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _of(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = int(self.root[k])
        return k

    def joined(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        out = []
        while True:
            apart = self.root[i] != self.root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return out
            # a pair of each row at least, so that every pass halves the groups that are left
            for at in np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]).tolist():
                a, b = self._of(int(i[at])), self._of(int(j[at]))
                if a != b:
                    self.root[max(a, b)] = min(a, b)
                    out.append((int(i[at]), int(j[at])))
            flat = self.root[self.root]
            while (flat != self.root).any():
                self.root, flat = flat, flat[flat]
