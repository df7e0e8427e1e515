"""A vector index that is stored, grows by segments and is read cell by cell.

Under its folder lie a codebook and segments. The codebook has two levels of centres: coarse ones, fitted on the driver
on a bounded sample, and for each of these fine ones, fitted in tasks on the sample's vectors that lie there. A fine
centre makes a cell. The number of cells grows with the square root of the vectors. What is left of a vector after its
cell's centre is cut into parts, each coded by one of 256 codewords (residual product quantisation).

A segment is a Parquet table, in folders by bucket of its cells, of ids, cells, codes, the unit vectors and any
columns that searches may filter by. ``append`` adds a segment, ``delete`` a table of ids that hides
them in the segments before, and ``compact`` writes all that is left as one segment. Each is published by Spark's commit, so
readers see a segment whole or not at all, and an index reopens from its folder in any session.

A search reads the cells next to each query only: the buckets are a partition filter of the scan, and a query meets the
rows of its cells where they lie; large cells are dealt over several tasks. Rows are ordered by their codes, and the best of
each block are compared with the query exactly. A block returns each query's best hits, never all pairs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragloom.operators.best import CELLS, Best, first_hits, stored

#: Folders of a segment, and the most cells: what a task holds of the centres is bounded by these.
BUCKETS, MOST_CELLS = 256, 1 << 16
_CODEBOOK = "level int, no int, part int, centre array<double>"


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the ``n`` nearest centres of each row, the nearest first; ties go to the smaller number."""
    far = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    if n == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of the rows of ``x``, at most one for each; they start from rows that lie far apart."""
    k = min(k, len(x))
    if not k:
        return np.empty((0, x.shape[1]))
    far = ((x - x[0]) ** 2).sum(axis=1)
    chosen = [0]
    for _ in range(k - 1):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres = x[chosen].copy()
    for _ in range(rounds):
        home = nearest(x, centres)[:, 0]
        size = np.bincount(home, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


class Codebook:
    """Centres of both levels and the codewords of each part of a residual."""

    def __init__(self, coarse: np.ndarray, fine: dict[int, np.ndarray], words: list[np.ndarray]):
        self.coarse, self.words = coarse, words
        self.first = np.cumsum([0] + [len(fine[c]) for c in range(len(coarse))])
        self.centres = np.concatenate([fine[c] for c in range(len(coarse))]) if len(coarse) else coarse
        self.edges = np.linspace(0, coarse.shape[1], len(words) + 1).astype(int) if len(words) else np.zeros(1, int)

    @property
    def cells(self) -> int:
        return max(1, len(self.centres))

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: the nearest fine centre below the nearest coarse one."""
        if not len(self.centres):
            return np.zeros(len(x), np.int64)
        home = nearest(x, self.coarse)[:, 0]
        out = np.empty(len(x), np.int64)
        for c in np.unique(home).tolist():
            at = home == c
            out[at] = self.first[c] + nearest(x[at], self.centres[self.first[c] : self.first[c + 1]])[:, 0]
        return out

    def probes(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        """The ``n`` cells next to each row, of all levels."""
        return list(nearest(x, self.centres, n)) if len(self.centres) else [np.zeros(1, np.int64)] * len(x)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centres[cell] if len(self.centres) else x
        parts = [nearest(rest[:, a:b], w)[:, 0].astype(np.uint8) for a, b, w in zip(self.edges[:-1], self.edges[1:], self.words, strict=True)]
        return np.stack(parts, axis=1) if parts else np.empty((len(x), 0), np.uint8)

    def angle(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Angles between rows and the centres of their cells; all of them are possible where a centre is zero."""
        if not len(self.centres):
            return np.full(len(x), np.pi)
        own = self.centres[cell]
        norm = np.sqrt((own * own).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))
        return np.where(norm > 0, np.arccos(np.clip((x * own).sum(axis=1) / np.where(norm > 0, norm, 1.0), -1, 1)), np.pi)

    def angles(self, q: np.ndarray) -> np.ndarray:
        """Angles between a query and all centres; a right one where either is zero."""
        if not len(self.centres):
            return np.full(1, np.pi / 2)
        norm = np.sqrt((self.centres * self.centres).sum(axis=1))
        cosine = (self.centres @ q) / np.where(norm > 0, norm, 1.0) / (np.sqrt(q @ q) or 1.0)
        return np.arccos(np.clip(cosine, -1.0, 1.0))

    def estimate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of a query with coded rows of a cell: sums of looked up parts."""
        out = np.full(len(codes), q @ self.centres[cell] if len(self.centres) else 0.0)
        for no, (a, b, w) in enumerate(zip(self.edges[:-1], self.edges[1:], self.words, strict=True)):
            out += (w @ q[a:b])[codes[:, no]]
        return out


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


class VectorIndex:
    """``VectorIndex(spark, path)`` opens what is stored under a folder; ``build`` starts it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._book = None

    # --- what is stored ---
    def _committed(self, kind: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [status.getPath() for status in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(p.getName().split("-")[1]) for p in names if p.getName().startswith(f"{kind}-") and files.exists(hadoop.Path(p, "_SUCCESS")))

    def _state(self) -> tuple[list[int], list[int]]:
        """Numbers of the segments and of the deletions that count: those from the last compaction on."""
        whole = self._committed("whole")
        since = whole[-1] if whole else 0
        return whole[-1:] + [n for n in self._committed("seg") if n > since], [n for n in self._committed("gone") if n > since]

    def _next(self) -> int:
        return max([0, *self._committed("seg"), *self._committed("gone"), *self._committed("whole")]) + 1

    def built(self) -> bool:
        return bool(self._committed("whole"))

    def book(self) -> Codebook:
        if self._book is None:
            rows = self.spark.read.schema(_CODEBOOK).parquet(f"{self.path}/codebook").collect()
            pick = lambda level: sorted((r for r in rows if r.level == level), key=lambda r: (r.part, r.no))
            coarse = np.array([r.centre for r in pick(0)]).reshape(len(pick(0)), -1) if pick(0) else np.empty((0, 0))
            fine = {c: np.array([r.centre for r in pick(1) if r.part == c]) for c in range(len(coarse))}
            words = [np.array([r.centre for r in pick(2) if r.part == p]) for p in sorted({r.part for r in pick(2)})]
            self._book = self.spark.sparkContext.broadcast(Codebook(coarse, fine, words))
        return self._book

    # --- writing ---
    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = 20_000, parts: int | None = None) -> VectorIndex:
        """Fits the codebook on a hash sample of ``(id, v, ..)`` and stores all vectors as the first segment. ``cells``: by
        default the root of their number; at most ``sample`` vectors are fitted on."""
        n = vectors.count()
        cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
        rate = min(1.0, sample / max(1, n))
        drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
        some = drawn.orderBy(F.xxhash64("id"), "id").limit(min(sample, 4096)).select("v").toArrow()
        rows = some.column("v").to_pylist()
        dims = len(rows[0]) if rows else 0
        x = np.array(rows, np.float64).reshape(len(rows), dims)
        coarse = k_means(x, max(1, round(cells**0.5))) if dims else np.empty((0, 0))
        per = -(-cells // max(1, len(coarse)))

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(nearest(_matrix(batch.column(0)), coarse)[:, 0].astype(np.int32)), batch.column(0)], ["part", "v"])

        def split(key: tuple, own: pa.Table) -> pa.Table:
            centres = k_means(_matrix(own.column("v").combine_chunks()), per)
            return pa.table({"level": pa.array([1] * len(centres), pa.int32()), "no": pa.array(range(len(centres)), pa.int32()), "part": pa.array([key[0].as_py()] * len(centres), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})

        found = [(0, no, 0, c) for no, c in enumerate(coarse.tolist())]
        if dims:
            fine = drawn.select("v").mapInArrow(home, "part int, v array<double>").groupBy("part").applyInArrow(split, _CODEBOOK).collect()
            reached = {r.part for r in fine}
            found += [tuple(r) for r in fine] + [(1, 0, c, coarse[c].tolist()) for c in range(len(coarse)) if c not in reached]
            by_coarse = {c: np.array([r[3] for r in sorted(found) if r[0] == 1 and r[2] == c]) for c in range(len(coarse))}
            plain = Codebook(coarse, by_coarse, [])
            rest = x - plain.centres[plain.cell(x)]
            edges = np.linspace(0, dims, (parts or max(1, dims // 4)) + 1).astype(int)
            found += [(2, no, p, w) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) for no, w in enumerate(k_means(rest[:, a:b], 256, 6).tolist())]
        self.spark.createDataFrame(found, _CODEBOOK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/codebook")
        self._book = None
        self._write(vectors, "whole")
        return self

    def append(self, vectors: DataFrame) -> None:
        """A segment of more vectors, coded as the others; an id that is there already has a row in both."""
        self._write(vectors, "seg")

    def delete(self, ids: DataFrame) -> None:
        """Hides the rows with these ids of all segments so far; later segments may have them again."""
        ids.select("id").distinct().write.parquet(f"{self.path}/gone-{self._next()}")

    def compact(self) -> None:
        """One segment in place of all; what was hidden is gone. Older tables go after the new one is committed."""
        segments, gone = self._state()
        no = self._next()
        self._store(self.rows().drop("segment", "bucket"), f"whole-{no}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for kind, numbers in (("whole", segments), ("seg", segments), ("gone", gone)):
            for old in numbers:
                path = hadoop.Path(f"{self.path}/{kind}-{old}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _write(self, vectors: DataFrame, kind: str) -> None:
        book = self.book()
        more = [c for c in vectors.columns if c not in ("id", "v")]
        rows = vectors.select("id", F.col("v").cast("array<double>").alias("v"), *more).where("v is not null")
        schema = self.spark.createDataFrame([], rows.schema).withColumns({"cell": F.lit(0), "code": F.lit(b""), "angle": F.lit(0.0)}).schema
        at = rows.columns.index("v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = book.value
                x = _matrix(batch.column(at))
                cell = own.cell(x)
                codes = own.encode(x, cell)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own.angle(x, cell))], [*batch.schema.names, "cell", "code", "angle"])

        self._store(rows.mapInArrow(run, schema), f"{kind}-{self._next()}")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """By ranges of cell and id, so that a large cell is written by several tasks."""
        bucket = F.floor(F.col("cell") * min(BUCKETS, self.book().value.cells) / self.book().value.cells).cast("int")
        return rows.withColumn("bucket", bucket).repartitionByRange("cell", "id").sortWithinPartitions("bucket", "cell")

    # --- reading ---
    def rows(self) -> DataFrame:
        """All rows that aren't hidden: the stored columns, and the segment's number."""
        segments, gone = self._state()
        if not segments:
            raise ValueError(f"{self.path} has no segment yet")
        out, whole = None, self._committed("whole")
        for no in segments:
            kind = "whole" if no in whole else "seg"
            schema = self._schema(f"{kind}-{no}")
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}-{no}").withColumn("segment", F.lit(no))
            later = [n for n in gone if n > no]
            for n in later:
                part = part.join(self.spark.read.parquet(f"{self.path}/gone-{n}"), "id", "left_anti")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _schema(self, name: str) -> StructType:
        """The schema that was stored with a segment; one without rows has no file to tell it."""
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema-{name}", wholetext=True).first().value))

    def _store(self, rows: DataFrame, name: str) -> None:
        dealt = self._dealt(rows)
        told = self.spark.createDataFrame([(dealt.schema.json(),)], "value string")
        told.coalesce(1).write.mode("overwrite").text(f"{self.path}/schema-{name}")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def count(self) -> int:
        return self.rows().count()

    def _asked(self, queries: DataFrame, cells_of: Callable[[Codebook, np.ndarray, np.ndarray | None], list[np.ndarray]]) -> DataFrame:
        """``query_id, q, bucket, cells``: a row for each bucket with cells that a query looks into. ``queries`` may have a ``floor``."""
        book = self.book()
        kind = queries.schema["query_id"].dataType.simpleString()
        buckets, n = min(BUCKETS, book.value.cells), book.value.cells
        more = [c for c in ("floor",) if c in queries.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                floor = batch.column("floor").to_numpy(zero_copy_only=False) if more else None
                for no, cells in enumerate(cells_of(book.value, _matrix(batch.column(1)), floor)):
                    cells = np.sort(cells).astype(np.int32)
                    bucket, first = np.unique(cells.astype(np.int64) * buckets // n, return_index=True)
                    same = pa.array(np.full(len(bucket), no))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cells)).astype(np.int32)), pa.array(cells))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(bucket.astype(np.int32)), lists], ["query_id", "q", "bucket", "cells"])

        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), *more)
        return asked.mapInArrow(run, f"query_id {kind}, q array<double>, bucket int, cells array<int>")

    def _scan(self, asked: DataFrame, where: Column | None, keep: int | None, top_k: int, digits: int, block_rows: int, block_queries: int) -> DataFrame:
        """``query_id, id, score``, rounded, of the queries of each bucket with the rows of their cells there: each query's best of each block of
        rows; with ``keep``, of those that are best by codes only."""
        book = self.book()
        cells = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most MOST_CELLS numbers
        n = book.value.cells
        buckets = sorted({cell * min(BUCKETS, n) // n for cell in cells})
        rows = self.rows().where(F.col("bucket").isin(buckets))
        if len(cells) <= 1000:
            rows = rows.where(F.col("cell").isin(cells))
        rows = rows if where is None else rows.where(where)
        # sizes of the buckets that are asked for, and of their queries: blocks of rows and of queries meet
        size = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("down"))
        wish = asked.groupBy("bucket").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("across"))
        plan = F.broadcast(size.join(wish, "bucket"))  # a row for each bucket
        part = lambda key, many: F.pmod(F.xxhash64(key), F.col(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        held = ["id", "cell", "v"] + ["code"] * (keep is not None)
        left = rows.join(plan, "bucket").withColumn("i", part("id", "down")).withColumn("j", every("across")).select("bucket", "i", "j", *held)
        right = asked.join(plan, "bucket").withColumn("j", part("query_id", "across")).withColumn("i", every("down")).select("bucket", "i", "j", "query_id", "q", "cells")
        out = pa.schema([("query_id", _arrow(asked, "query_id")), ("id", _arrow(rows, "id")), ("score", pa.float64())])

        def meet(own: pa.Table, queries: pa.Table) -> pa.Table:
            if not own.num_rows or not queries.num_rows:
                return out.empty_table()
            own = own.sort_by([("cell", "ascending"), ("id", "ascending")])
            cell, x, q = own.column("cell").to_numpy(), _matrix(own.column("v").combine_chunks()), _matrix(queries.column("q").combine_chunks())
            lists = queries.column("cells").combine_chunks()
            wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(wanted, kind="stable")
            wanted, who = wanted[order], who[order]
            best, hits = Best(len(q), top_k, digits), []
            for no in np.unique(cell).tolist():
                low, high = np.searchsorted(cell, [no, no + 1])
                some = who[slice(*np.searchsorted(wanted, [no, no + 1]))]
                rough = keep is not None and high - low > keep
                codes = np.frombuffer(b"".join(own.column("code").slice(low, high - low).to_pylist()), np.uint8).reshape(high - low, -1) if rough else None
                step = max(1, CELLS // (high - low))
                for start in range(0, len(some), step):
                    of = some[start : start + step]
                    scores = q[of] @ x[low:high].T
                    scores[np.isnan(scores)] = np.inf  # what is no number comes first, as it sorts
                    if rough:
                        for query, row in zip(of.tolist(), scores, strict=True):
                            row[np.argpartition(-book.value.estimate(q[query], no, codes), keep - 1)[keep:]] = -np.inf
                    query, row, score = best.offer(scores, of)
                    told = score > -np.inf
                    hits.append(pa.table({"query": query[told], "id": own.column("id").take(pa.array(row[told] + low)), "score": score[told]}))
            if not hits:
                return out.empty_table()
            found = first_hits(hits, top_k)
            score = found.column("score").to_numpy().copy()
            score[score == np.inf] = np.nan
            return pa.Table.from_arrays([queries.column("query_id").take(found.column("query")), found.column("id"), pa.array(score)], schema=out)

        told = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
        return left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInArrow(meet, told)

    def search(self, queries: DataFrame, top_k: int = 20, probes: int = 16, where: Column | None = None, refine: int = 10, digits: int = 6, block_rows: int = 50_000, block_queries: int = 1 << 14) -> DataFrame:
        """``query_id, id, score, rank`` of ``(query_id, q)``, unit vectors: the best of the ``probes`` cells next to each query. Of a
        block's rows, the ``refine`` times ``top_k`` best by codes are compared exactly. ``where``: a filter on stored columns."""
        return _best(self._scan(self._asked(queries, lambda book, x, _: book.probes(x, probes)), where, refine * top_k, top_k, digits, block_rows, block_queries), top_k, digits)

    def search_exact(self, queries: DataFrame, top_k: int = 20, probes: int = 8, where: Column | None = None, digits: int = 6, block_rows: int = 50_000, block_queries: int = 1 << 14) -> DataFrame:
        """As ``search``, but nothing is missed: the ``probes`` nearest cells give each query a score that its last hit has at least, and
        then all cells are read that may hold a better one: by the triangle inequality of angles, no row of a cell is nearer than the
        angle to its centre less the widest angle of its rows. Made for a stated set of queries."""
        first = _best(self._scan(self._asked(queries, lambda book, x, _: book.probes(x, probes)), where, None, top_k, digits, block_rows, block_queries), top_k, digits)
        floor = stored(first.where(F.col("rank") == top_k).select("query_id", F.col("score").alias("floor")), "vector-floor")
        width = np.full(self.book().value.cells, -np.inf)
        for r in self._widths().collect():  # at most MOST_CELLS numbers
            width[r.cell] = r.width

        def may_hold(book: Codebook, x: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
            # rounding lets a score tie that is lower by less than the last digit
            low = np.where(np.isnan(floor), -2.0, floor) - 10.0**-digits
            return [np.flatnonzero((width > -np.inf) & (np.cos(np.maximum(0.0, book.angles(q) - width)) >= f)) for q, f in zip(x, low, strict=True)]

        more = self._asked(queries.select("query_id", "q").join(floor, "query_id", "left"), may_hold)
        return _best(self._scan(more, where, None, top_k, digits, block_rows, block_queries), top_k, digits)

    def _widths(self) -> DataFrame:
        """``cell, width``: the widest angle between a cell's centre and its rows; of these only the stored angles are read."""
        return self.rows().groupBy("cell").agg((F.max("angle") + 1e-9).alias("width"))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _best(hits: DataFrame, top_k: int, digits: int) -> DataFrame:
    rows = hits.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
