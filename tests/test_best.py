"""Searches keep the best of each batch; they give what comparing every pair gives."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.operators import retrieval
from ragloom.operators.best import Best, best_rows


def test_best_of_batches_with_ties():
    rng = np.random.default_rng(5)
    scores = np.round(rng.random((7, 900)), 2)
    best, found = Best(7, 10, 2), [set() for _ in range(7)]
    for start in range(0, 900, 90):
        for q, r, s in zip(*best.offer(scores[:, start : start + 90]), strict=True):
            found[q].add((-s, r + start))
    assert [sorted(f)[:10] for f in found] == [sorted((-s, r) for r, s in enumerate(row))[:10] for row in scores]
    assert sum(map(len, found)) < 7 * 300  # later batches return what may still be among the best


def _hits(rows):
    return sorted((r.query_id, r["rank"], r.id, str(r.score)) for r in rows.collect())


def test_vector_search_equals_all_pairs_with_odd_vectors(spark):
    made = [(i, [float((i * 7 + j) % 11 - 5) for j in range(4)] if i % 9 else ([None, [1.0, None, 0.0, 0.0], [1.0], [float("nan")] * 4][i // 9 % 4])) for i in range(300)]
    rows = spark.createDataFrame(made, "id long, v array<double>").repartition(3).withColumn("v", F.when((F.size("v") == 4) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)), retrieval.unit(F.col("v"))).otherwise(F.col("v")))
    asked = rows.where("id % 50 = 1").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = retrieval.vector_search(rows, asked, 12)
    score = F.round(retrieval.cosine(F.col("q"), F.col("v")), 6).alias("score")
    assert _hits(found) == _hits(retrieval.ranked(rows.crossJoin(asked).select("query_id", "id", score), 12))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    few = rows.where("id < 60 and id % 9 <> 0")
    assert _hits(retrieval.vector_search(few, rows.where("id in (9, 1)").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 60)) == _hits(retrieval.ranked(few.crossJoin(rows.where("id in (9, 1)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))).select("query_id", "id", score), 60))


def test_bm25_in_blocks_of_queries_equals_the_formula(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    texts = [(str(i), None if i == 5 else " ".join(f"w{(i * k) % 13}" for k in range(1, 3 + i % 9))) for i in range(120)]
    corpus = spark.createDataFrame(texts, "id string, content string").repartition(4)
    queries = spark.createDataFrame([(q, f"w{q} W{q} w{q + 1} none") for q in range(7)], "query_id long, question string")
    posted, sizes = retrieval.postings(corpus), retrieval.lengths(corpus)
    rows = retrieval.query_terms(queries).join(retrieval.term_idf(posted, sizes), "term").join(posted, "term").join(sizes, "id")
    part = F.expr("qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))")
    want = retrieval.ranked(rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0"), 9)
    found = retrieval.bm25(corpus, queries, 9)
    assert _hits(found) == _hits(want)
    assert "Aggregate" not in found._jdf.queryExecution().toString()  # pairs are not grouped
    assert retrieval.bm25(corpus.where("false"), queries).count() == 0


def test_a_task_gives_its_best_only(spark):
    rows = spark.range(25_000).select("id", F.array(F.col("id").cast("double")).alias("v")).coalesce(1)

    def prepare():
        return lambda batch: lambda start, stop: np.stack([np.array([v[0] for v in batch.column("v").to_pylist()[start:stop]]) * sign for sign in (1, 0, -1)])

    asked = spark.range(3).withColumnRenamed("id", "query_id")
    found = best_rows(rows, pa.array([0, 1, 2], pa.int64()), asked.schema["query_id"], 4, 6, prepare).collect()
    assert sorted((r.query_id, r.id, r.score) for r in found) == [(0, i, float(i)) for i in range(24_996, 25_000)] + [(1, i, 0.0) for i in range(4)] + [(2, i, -float(i)) for i in range(4)]


def test_some_hundreds_of_queries_read_the_texts_once(spark, monkeypatch):
    blocks, whole = [], retrieval._scored_block
    monkeypatch.setattr(retrieval, "_scored_block", lambda docs, asked, top_k: blocks.append(1) or whole(docs, asked, top_k))
    corpus = spark.createDataFrame([(i, f"w{i} w{i % 7} x") for i in range(50)], "id long, content string")
    queries = spark.createDataFrame([(q, f"w{q % 50} w{q % 7}") for q in range(900)], "query_id long, question string")
    found = {(r.query_id, r.id) for r in retrieval.bm25(corpus, queries, 1).collect()}
    assert len(blocks) == 1 and len(found) == 900 and all(i == q % 50 for q, i in found if q % 7 == q % 50 % 7 and q % 50 > 6)
