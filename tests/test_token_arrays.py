"""Tokens on the bytes of Arrow columns, and BM25 over them."""

import re
from math import log

import pyarrow as pa
import pytest

from ragloom.operators import retrieval, token_arrays

TEXTS = ["ab", "cd e", None, "", "  x9 x9,x9", "天地a地 7", "㿿一鿿ꀀ é ö5", "y", "...", "z" * 40]


@pytest.mark.parametrize("slice_bytes", [1, 7, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_tokens_of_odd_texts(monkeypatch, slice_bytes, kind):
    monkeypatch.setattr(token_arrays, "SLICE_BYTES", slice_bytes)
    for texts in (pa.array(TEXTS, kind), pa.array(TEXTS, kind).slice(1, 6), pa.array([None, ""], kind), pa.array([], kind)):
        got = []
        for start, size, flat in token_arrays.token_slices(texts):
            assert start == len(got)
            told = iter(flat.to_pylist())
            got += [[next(told) for _ in range(n)] for n in size]
            assert next(told, None) is None
        assert got == [re.findall("[a-z0-9]+|[一-鿿]", t or "") for t in texts.to_pylist()]


def test_bm25_by_hand(spark, monkeypatch):
    """Counts that are sent early, few weights at once, null and empty texts, and repeated query terms give the scores of the formula."""
    monkeypatch.setattr(retrieval, "HELD_TERMS", 2)
    monkeypatch.setattr(retrieval, "ADDED", 1)
    texts = ["Pump seal pump", "seal of the valve", None, "", "valve 天 paste", "天地", "dry ROOM pump"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(2)
    asked = {1: "pump pump seal", 2: "地 天?", 3: "nothing", 4: "valve"}
    got = {(r.query_id, r.id): r.score for r in retrieval.bm25(corpus, spark.createDataFrame(list(asked.items()), "query_id long, question string")).collect()}
    cut = lambda t: re.findall("[a-z0-9]+|[一-鿿]", (t or "").lower())
    docs = [cut(t) for t in texts]
    mean = sum(map(len, docs)) / sum(t is not None for t in texts)
    terms = {t for d in docs for t in d}
    raw = {t: log(len(docs) - n + 0.5) - log(n + 0.5) for t in terms for n in [sum(t in d for d in docs)]}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    want = {(q, i): sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in cut(text)) for q, text in asked.items() for i, d in enumerate(docs)}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=2e-6)


def test_counting_sends_terms_not_pairs(spark):
    """Texts with the same words send these once for each task, not once for each text."""
    corpus = spark.range(0, 4000, 1, 4).selectExpr("id", "concat('same words in every text ', id % 3) as content")
    sent = retrieval._count_terms(corpus.selectExpr("content as text"))
    assert sent.count() <= 4 * (8 + 1)
