"""Grams and segmentations of many texts at once against counts and paths made one by one."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ragloom.operators import segmentation
from ragloom.operators.token_arrays import text_slices


def say(rng, signs, n):
    return "".join(rng.choice(signs) if rng.random() < 0.8 else rng.choice(["a", "7b ", " ", "é", "。", "ㄅ", "😀"]) for _ in range(n))


def grams_of(texts, longest):
    want = Counter()
    for run in (r for t in texts for r in re.findall(segmentation.SIGNS, t or "")):
        held = f"${run}$"
        want.update(held[i : i + k] for k in range(1, longest + 1) for i in range(len(held) - k + 1))
    return want


@pytest.mark.parametrize(("longest", "many"), [(3, 6), (5, 900), (8, 100), (8, 700)])
def test_grams_of_slices(longest, many, monkeypatch):
    """Also where signs come that were not seen before, where they are too many for one number, and where grams are passed on midway."""
    monkeypatch.setattr(segmentation, "GRAMS_HELD", 500)
    rng = random.Random(many)
    grams, got, every = segmentation._Grams(longest), Counter(), []
    for part in range(4):
        texts = [None, "", "鿿", "一一"] + [say(rng, [chr(0x4E00 + part * 90 + rng.randrange(many)) for _ in range(many)], rng.randrange(200)) for _ in range(20)]
        every += texts
        told = []
        for _, data, offsets in text_slices(pa.array(texts, pa.string()), 600):
            _, number, begins = segmentation._signs(data, offsets)
            told += list(grams.add(number, begins)) if len(number) else []
        for batch in told + (list(grams.told()) if part == 3 else []):
            for gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[gram] += n
    assert got == grams_of(every, longest)


def tokens_of(text, costs, longest, alone, search):
    out = []
    for piece in re.findall(segmentation.PIECES, (text or "").lower()):
        if piece[0] < "一":
            out.append(piece)
            continue
        ends = segmentation.best_path(len(piece), [(e, s, costs[piece[e - s : e]]) for e in range(1, len(piece) + 1) for s in range(1, min(e, longest) + 1) if piece[e - s : e] in costs], alone)
        for a, b in zip([0, *ends], ends, strict=False):
            inside = [piece[e - s : e] for s in (2, 3) if s < b - a for e in range(a + s, b + 1) if piece[e - s : e] in costs]
            out += [*(inside if search else []), piece[a:b]]
    return out


@pytest.mark.parametrize("cells", [0, 1 << 22])
@pytest.mark.parametrize("search", [True, False])
def test_tokens_of_slices(cells, search, monkeypatch):
    """Small numbers as costs make equal paths frequent; words may be too long, empty or of other letters."""
    monkeypatch.setattr(segmentation, "TABLE_CELLS", cells)
    rng = random.Random(12)
    signs = [chr(0x4E00 + i * 997) for i in range(7)]
    for _ in range(25):
        longest = rng.randrange(1, 6)
        costs = {"".join(rng.choice(signs[:5]) for _ in range(rng.randrange(1, 6))): rng.randrange(1, 6) for _ in range(rng.randrange(60))} | {"ab": 1, "": 1, "鿿一": 2}
        texts = [None, "", "ab12", "一", "鿿一2"] + [say(rng, signs, rng.choice([0, 3, 40, 300])) for _ in range(30)]
        words = segmentation._Words(pa.array(list(costs), pa.string()), pa.array(list(costs.values()), pa.int64()), longest, 9)
        words.prepare()
        got = [t for _, data, offsets in text_slices(pa.array(texts, pa.string()), 900) for t in segmentation._slice_tokens(data, offsets, words, search).to_pylist()]
        assert got == [tokens_of(t, costs, longest, 9, search) for t in texts]


def test_lexicon_too_great_to_be_sent(spark, monkeypatch):
    rng = random.Random(13)
    signs = [chr(0x4E00 + i) for i in range(6)]
    texts = spark.createDataFrame([(i % 15, None if i == 3 else say(rng, signs, rng.randrange(60))) for i in range(40)], "id long, content string")
    costs = segmentation.weighed(spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randrange(1, 5))), rng.randrange(1, 9)) for _ in range(80)], "word string, n long"))
    sent = sorted((r.id, r.tokens) for r in segmentation.segmented_tokens(texts, costs).collect())
    monkeypatch.setattr(segmentation, "HELD_WORDS", 0)
    assert sorted((r.id, r.tokens) for r in segmentation.segmented_tokens(texts, costs).collect()) == sent and len(sent) == 40
    none = segmentation.segmented_tokens(texts, costs.limit(0)).collect()
    assert len(none) == 40 and all(len(t) == 1 or t.isascii() for r in none for t in r.tokens)


def test_texts_are_segmented_where_they_lie(spark):
    """Neither runs nor tokens of texts are shuffled."""
    texts = spark.createDataFrame([(1, "天地人"), (2, None)], "id long, content string")
    found = segmentation.segmented_tokens(texts, segmentation.weighed(spark.createDataFrame([("天地", 3)], "word string, n long")))
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert {r.id: r.tokens for r in found.collect()} == {1: ["天地", "人"], 2: []}


def test_few_long_runs_and_many_short_ones():
    rng = np.random.default_rng(14)
    size = np.concatenate([[3000, 700], rng.integers(1, 9, 400)])
    first = np.cumsum(size) - size
    edges = [np.where(rng.random(size.sum()) < 0.5, rng.integers(1, 6, size.sum()), 5 if s == 1 else segmentation._NEVER) for s in (1, 2, 3)]
    for at, n in zip(first, size, strict=True):
        for s in (2, 3):
            edges[s - 1][max(at, at + n - s + 1) : at + n] = segmentation._NEVER
    ends = segmentation._word_ends(segmentation._solve_together(edges, first, size), first, size).tolist()
    want = []
    for at, n in zip(first.tolist(), size.tolist(), strict=True):
        held = [(e, s, int(edges[s - 1][at + e - s])) for e in range(1, n + 1) for s in range(1, min(e, 3) + 1) if edges[s - 1][at + e - s] < segmentation._NEVER]
        want += [at + e - 1 for e in segmentation.best_path(n, held, 5)]
    assert ends == want
