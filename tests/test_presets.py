"""Presets run over a small corpus."""

import time

from ragloom.operators import chunking, evaluation, presets

FACTS = ["The pump seal wears after nine months of use.", "Valve seats are ground with fine paste.", "The motor stands in a dry room.", "Filters go to the wash each Monday."]


def test_presets(spark):
    fill = " ".join(f"Word number {i} says nothing at all." for i in range(30))
    docs = spark.createDataFrame([(i, f"{fill}\n{fact}\n{fill}") for i, fact in enumerate(FACTS)] + [(9, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f.split()[:5]), f) for i, f in enumerate(FACTS)], "item_id long, question string, evidence string")
    got = {r.name: r for r in presets.sweep_presets(docs, items).collect()}
    assert list(got) and set(got) == {p[0] for p in evaluation.PRESETS}
    for name, r in got.items():
        assert r.questions == 4 and r.children >= r.parents > 0
        if name != "pipeline_no_bm25":  # hash vectors know nothing of words
            assert r.recall_5 == 1.0 and r.mrr > 0.5, name
    assert got["pipeline_no_bm25"].mrr <= got["chunk_parent_300"].mrr and got["chunk_parent_150"].children > got["chunk_parent_500"].children
    assert presets.sweep_presets(docs, items.limit(0), evaluation.PRESETS[:1]).count() == 0


def test_fixed_chunks_of_a_long_text(spark):
    text = "".join(f"{i:x} ü" for i in range(800_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None), (5, text[:16_301])], "doc_id long, text string")
    began = time.monotonic()
    got = {(r.doc_id, r.no): (r.start, r.end, r.content) for r in chunking.fixed_chunks(docs).collect()}
    assert time.monotonic() - began < 30
    want = {(d, i // 250): (i, min(i + 300, len(t)), t[i : i + 300]) for d, t in ((1, text), (2, "short"), (5, text[:16_301])) for i in range(0, max(1, len(t) - 50), 250)}
    assert got == want
