"""Stored indexes: vectors by cells, reopened, grown, and read in part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import retrieval
from ragloom.operators.vector_index import Codebook, VectorIndex, k_means, nearest
from ragloom.sources import tables


@pytest.fixture(scope="module")
def vectors(spark):
    rows = tables.load(spark, "/root/testdata/sf0.1", "embeddings")
    return rows.select(F.col("vec_id").alias("id"), retrieval.unit(F.col("embedding").cast("array<double>")).alias("v"), "label")


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("vectors"))).build(vectors)


def hits(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


def test_k_means():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (50, 3)) for c in (0, 5, 9)])
    centres = k_means(x, 3)
    assert sorted(centres[:, 0].round().tolist()) == [0, 5, 9] and len(k_means(x[:2], 5)) == 2
    assert (nearest(x, centres, 3)[:, 0] == nearest(x, centres)[:, 0]).all()


def test_codes_estimate_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    coarse = k_means(x, 4)
    fine = {c: k_means(x[nearest(x, coarse)[:, 0] == c], 3) for c in range(4)}
    book = Codebook(coarse, fine, [])
    rest = x - book.centres[book.cell(x)]
    book = Codebook(coarse, fine, [k_means(rest[:, a : a + 2], 64) for a in range(0, 8, 2)])
    cell = book.cell(x)
    codes = book.encode(x, cell)
    q = rng.normal(size=8)
    for c in np.unique(cell).tolist():
        told = book.estimate(q, c, codes[cell == c])
        assert np.abs(told - x[cell == c] @ q).max() < 1.5


def test_vector_index_recall(index, vectors, asked):
    exact = hits(retrieval.vector_search(vectors.select("id", "v"), asked, 10))
    want = {x[:2] for x in exact}
    found = {x[:2] for x in hits(index.search(asked, 10, probes=30))}
    assert len(want & found) >= 0.95 * len(want)
    assert hits(index.search_exact(asked, 10)) == exact


def test_vector_index_blocks(index, asked):
    """Large cells and cells with many queries are dealt over several tasks; the hits stay the same."""
    assert hits(index.search(asked, 10, probes=12, refine=10**6)) == hits(index.search(asked, 10, probes=12, refine=10**6, block_rows=3, block_queries=2))


def test_vector_index_reads_few_cells(spark, index, asked, capsys):
    index.search(asked.limit(1), 10, probes=2).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters" in plan and "In(cell" in plan or "EqualTo(cell" in plan


def test_vector_index_filter(index, vectors, asked):
    some = vectors.where(F.col("label").isin(1, 3))
    assert hits(index.search_exact(asked, 10, where=F.col("label").isin(1, 3))) == hits(retrieval.vector_search(some.select("id", "v"), asked, 10))


def test_vector_index_grows(spark, vectors, asked, tmp_path):
    """Appended, hidden, compacted and reopened in another session."""
    early, late = vectors.where("id % 3 <> 0"), vectors.where("id % 3 = 0")
    index = VectorIndex(spark, str(tmp_path)).build(early, cells=40)
    index.append(late)
    assert index.count() == vectors.count() and len(index._state()[0]) == 2
    index.delete(vectors.where("id % 7 = 0").select("id"))
    index.append(vectors.where("id = 7"))
    left = vectors.where("id % 7 <> 0 or id = 7")
    want = hits(retrieval.vector_search(left.select("id", "v"), asked, 10))
    assert hits(index.search_exact(asked, 10)) == want
    again = VectorIndex(spark.newSession(), str(tmp_path))
    assert hits(again.search_exact(again.spark.createDataFrame(asked.collect(), asked.schema), 10)) == want
    again.compact()
    assert [len(x) for x in again._state()] == [1, 0] and again.count() == left.count()
    assert hits(VectorIndex(spark, str(tmp_path)).search_exact(asked, 10)) == want


def test_vector_index_odd(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "no")).rows()
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 1.0])], "id long, v array<double>")
    index = VectorIndex(spark, str(tmp_path / "few")).build(rows)
    got = index.search(rows.where("id = 1").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 5, probes=9)
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (None, 0.0)]
    empty = VectorIndex(spark, str(tmp_path / "none")).build(rows.limit(0))
    assert empty.search(rows.where("id = 1").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 5).count() == 0


def test_vector_blocks_give_their_best_only(spark, tmp_path):
    rows = spark.range(300).select("id", retrieval.hash_vector(F.col("id").cast("string")).alias("v"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    index = VectorIndex(spark, str(tmp_path / "best")).build(rows, cells=9)
    told = index._asked(asked, lambda book, x, _: book.probes(x, book.cells))
    assert told.groupBy("query_id", "bucket").count().where("count > 1").count() == 0
    cells = index.rows().select("bucket").distinct().count()
    assert index._scan(told, None, None, 5, 6, 50_000, 500).count() <= 5 * cells * asked.count() < 300 * asked.count()
    assert sorted(map(tuple, index.search_exact(asked, 5).collect())) == sorted(map(tuple, retrieval.vector_search(rows, asked, 5).collect()))
