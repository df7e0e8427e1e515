"""A match ratio is of the whole evidence, however long it is."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import evaluation, presets

rng = random.Random(21)
LONG = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(600))
KEY = LONG.replace(" ", "")


def test_ratio_of_a_long_evidence(spark):
    n = len(KEY)
    assert n > 2 * evaluation.EVIDENCE_CHARS
    cases = [(KEY[500:].upper(), (n - 500) / n), (KEY[:900], 900 / n), (f"x{KEY[1000:1700]}x", 700 / n), (f"zz {LONG} zz", 1.0), (KEY[: n // 2] + "#" + KEY[n // 2 :], (n - n // 2) / n), ("#", 0.0)]
    rows = spark.createDataFrame([(no, c, LONG) for no, (c, _) in enumerate(cases)], "no int, content string, evidence string")
    got = {r.no: r.r for r in rows.select("no", evaluation.match_ratio(F.col("content"), F.col("evidence")).alias("r")).collect()}
    assert [got[no] for no in range(len(cases))] == pytest.approx([c[1] for c in cases])

def test_presets_look_for_the_whole_evidence(spark):
    """The text has only the first thousand signs of one evidence, and most of the other but its beginning."""
    short, rest = LONG[:1000], LONG[:1900][::-1]
    docs = spark.createDataFrame([(1, short), (2, rest[500:])], "doc_id long, text string")
    items = spark.createDataFrame([(1, short[:60], LONG), (2, rest[500:560], rest), (3, rest[600:660], rest)], "item_id long, question string, evidence string")
    row = presets.sweep_presets(docs, items, evaluation.PRESETS[3:4]).first()
    assert (row.questions, row.recall_5) == (3, pytest.approx(2 / 3, abs=1e-6))


def test_tables_of_a_chunking_are_deleted(spark, tmp_path, monkeypatch):
    """Only the contexts are left before the rows are read."""
    monkeypatch.setattr(presets, "scratch_folder", lambda spark, name: str(tmp_path / name))
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    items = spark.createDataFrame([(1, LONG[:60], LONG[:300])], "item_id long, question string, evidence string")
    found = presets.sweep_presets(docs, items, evaluation.PRESETS[:1])
    assert [p.name for p in (tmp_path / "presets").iterdir()] == ["contexts-chunk_fixed"]
    assert found.first().recall_5 == 1.0
