"""The best rows of some queries over many rows, without a row for each pair: a task scores its rows batch by batch against a block
of queries that is broadcast, and returns the best of these only. Time grows with rows times queries, memory doesn't."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ragloom.session import scratch_folder

#: Scores that are held at once.
CELLS = 1 << 21
#: Hits that a task holds before it drops those that are no longer among the best.
HELD_HITS = 1 << 20


class Best:
    """The ``k`` best rounded scores of each query that a task has seen."""

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.digits, self.top = k, digits, np.full((queries, k), -np.inf)

    def offer(self, scores: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, rounded score) of what may be among the best, from scores (queries, rows) of rows in the order of their
        ids: ``k`` a query at most, of equal ones those with the least ids. What is returned later may be better. ``of``: the queries that are scored, if not all."""
        n = scores.shape[1]
        floor = self.top[:, 0] if of is None else self.top[of, 0]
        if n > self.k and (floor == -np.inf).any():
            floor = np.maximum(floor, np.round(np.partition(scores, n - self.k, axis=1)[:, n - self.k], self.digits))
        query, row = np.nonzero(scores >= (floor - 10.0**-self.digits)[:, None])
        score = np.round(scores[query, row], self.digits)
        held = score >= floor[query]
        query, row, score = query[held], row[held], score[held]
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        held = place < self.k
        query, row, score, place = query[held], row[held], score[held], place[held]
        query = query if of is None else of[query]
        who, at = np.unique(query, return_inverse=True)
        new = np.full((len(who), self.k), -np.inf)
        new[at, place] = score
        self.top[who] = np.sort(np.concatenate([self.top[who], new], axis=1), axis=1)[:, self.k :]
        return query, row, score


def best_rows(rows: DataFrame, ids: pa.Array, query_field: StructField, top_k: int, digits: int, prepare: Callable[[], Callable[[pa.RecordBatch], tuple[Callable[[int, int], np.ndarray], int]]], positive: bool = False) -> DataFrame:
    """``query_id, id, score``, rounded: each task's ``top_k`` best of the queries ``ids``; ranks are left to the caller. ``rows`` has the
    column ``id``. ``prepare`` is called once for each task; what it gives takes a batch, whose rows are in the order of their ids, to a
    function that scores its rows from one to another as (queries, rows). ``positive``: only scores above zero."""
    schema = StructType([StructField("query_id", query_field.dataType), StructField("id", rows.schema["id"].dataType), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, best = prepare(), Best(len(ids), top_k, digits)
        step = max(top_k + 1, CELLS // max(1, len(ids)))
        held, n, most = [], 0, max(HELD_HITS, 4 * len(ids) * top_k)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            batch = batch.take(pc.sort_indices(batch.column("id")))
            scored = read(batch)
            for start in range(0, batch.num_rows, step):
                query, row, score = best.offer(scored(start, min(start + step, batch.num_rows)))
                if positive:
                    query, row, score = query[score > 0], row[score > 0], score[score > 0]
                if len(query):
                    held.append(pa.table({"query": query, "id": batch.column("id").take(pa.array(row + start)), "score": score}))
                    n += len(query)
                    if n > most:
                        held = [first_hits(held, top_k)]
                        n = held[0].num_rows
        if held:
            for part in first_hits(held, top_k).to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([ids.take(part.column("query")), part.column("id"), part.column("score")], ["query_id", "id", "score"])

    return rows.mapInArrow(run, schema)


def first_hits(held: list[pa.Table], top_k: int) -> pa.Table:
    """Each query's best by score, then by id."""
    hits = pa.concat_tables(held).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
    query = hits.column("query").to_numpy()
    return hits.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < top_k))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows that are dear and few, computed once: written to the shared folder and read again, so that joins know their size."""
    path = scratch_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
