"""Evidence matching, segmentation, proximity and lexical segments against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import evaluation, evidence, retrieval, segmentation
from ragloom.operators.lexical_index import LexicalIndex
from ragloom.sources import tables


# --- evidences ----------------------------------------------------------------------------------
def test_longest_run():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(2))
        every = list(range(-len(b), len(a) + 1))
        assert evidence.longest_run(evidence.points(a), evidence.points(b), every) == evaluation.longest_common(evidence.points(b), evidence.points(a))


def test_evidence_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 8, 40, 300]))) for i in range(30)] + [(30, None), (31, " "), (3, "Again AN item")]
    docs = []
    for no in range(80):
        i, e = items[rng.randrange(30)]
        at = rng.randrange(max(1, len(e) // 2))
        docs.append((no, say(20) + rng.choice(["", " "]) + rng.choice([e, e.upper(), e[at:], e[: len(e) - at], e[:at] + "zz" + e[at:]]) + say(20)))
    docs += [(80, None), (81, ""), (82, "a" * 20_000), (5, "again an\nitem")]
    key = lambda t: "".join((t or "").lower().split())
    want = {}
    for (d, t), (i, e) in itertools.product(docs, items):
        ratio = evaluation._ratio(key(t), key(e))
        if ratio >= 0.6:
            want[d, i] = max(ratio, want.get((d, i), 0))
    rows = evidence.evidence_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): pytest.approx(r.ratio) for r in rows.collect()} == want


def test_evidence_matches_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "some long text")], "doc_id long, text string")
    evidence.evidence_matches(docs, spark.createDataFrame([(1, "long text")], "item_id long, text string")).explain()
    assert "Nested" not in capsys.readouterr().out


# --- segmentation -------------------------------------------------------------------------------
LEXICON = [("钢刀", 5), ("更换", 9), ("周期", 7), ("中华", 4), ("人民", 8), ("共和国", 5), ("中华人民共和国", 6), ("设备", 9), ("维护", 9), ("知识", 5), ("图谱", 4), ("知识图谱", 3)]


def test_segment_known_words(spark):
    costs = segmentation.weighed(spark.createDataFrame(LEXICON, "word string, n long"))
    rows = [(1, "钢刀的更换周期是 20000 次"), (2, "中华人民共和国"), (3, "设备维护，；。！"), (4, ""), (5, None), (6, "用知识图谱做RAG")]
    found = segmentation.segmented_tokens(spark.createDataFrame(rows, "id long, content string"), costs, longest=7)
    got = {r.id: r.tokens for r in found.collect()}
    assert got[1] == ["钢刀", "的", "更换", "周期", "是", "20000", "次"]
    assert got[2] == ["中华", "人民", "共和国", "中华人民共和国"] and got[3] == ["设备", "维护"]
    assert got[4] == [] and got[5] == [] and got[6] == ["用", "知识", "图谱", "知识图谱", "做", "rag"]
    exact = segmentation.segmented_tokens(spark.createDataFrame(rows, "id long, content string"), costs, longest=7, search=False)
    assert {r.id: r.tokens for r in exact.collect()}[2] == ["中华人民共和国"]


def test_best_path_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 9)
        edges = {(e, s): rng.randrange(1, 9) for e in range(1, n + 1) for s in range(1, min(4, e) + 1) if rng.random() < 0.5}
        ends = segmentation.best_path(n, sorted((e, s, c) for (e, s), c in edges.items()), 5)
        cost = lambda path: sum(edges.get((b, b - a), 5 if b - a == 1 else 10**9) for a, b in itertools.pairwise([0, *path]))
        every = [[*inner, n] for k in range(n) for inner in itertools.combinations(range(1, n), k)]
        assert cost(ends) == min(map(cost, every))


def test_a_very_long_run_is_learnt_and_segmented(spark):
    """Neither carries the run beside each of its substrings."""
    text = "天地人日月" * 20_000
    texts = spark.createDataFrame([(1, text)], "id long, content string")
    grams = {r.gram: r.n for r in segmentation.sign_grams(texts, 2).collect()}
    assert grams["天"] == grams["天地"] == 20_000 and grams["月天"] == 19_999 and grams["$天"] == grams["月$"] == 1
    costs = segmentation.weighed(spark.createDataFrame([("天地", 9), ("人日月", 9)], "word string, n long"))
    tokens = segmentation.segmented_tokens(texts, costs, search=False).first().tokens
    assert tokens == ["天地", "人日月"] * 20_000


def test_learnt_lexicon(spark):
    """Words of a made-up language come back from text without blanks."""
    rng = random.Random(6)
    signs = [chr(0x4E00 + i) for i in range(150)]
    words = list({"".join(rng.choice(signs) for _ in range(rng.choice([2, 3]))) for _ in range(60)})
    said = [[rng.choice(words) for _ in range(rng.randrange(3, 9))] for _ in range(600)]
    texts = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(said)], "id long, content string")
    lexicon = segmentation.learn_lexicon(texts)
    found = {r.word for r in lexicon.collect()}
    assert len(found & set(words)) >= 0.9 * len(words)
    told = segmentation.segmented_tokens(texts, segmentation.weighed(lexicon), search=False)
    right = sum(r.tokens == said[r.id] for r in told.collect())
    assert right >= 0.8 * len(said)
    assert segmentation.learn_lexicon(texts.limit(0)).count() == 0


# --- proximity ----------------------------------------------------------------------------------
def test_least_cover_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        terms = [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        at = sorted(rng.sample(range(40), len(terms)))
        wanted = set(terms)
        spans = [at[j] - at[i] + 1 for i in range(len(at)) for j in range(i, len(at)) if set(terms[i : j + 1]) == wanted]
        assert retrieval.least_cover(at, terms) == min(spans, default=0)


def test_rerank_proximity(spark):
    rows = [(1, 1, 1, "pump seal wear", "seal of a pump shows wear"), (1, 2, 2, "pump seal wear", "pump seal wear"), (1, 3, 3, "pump seal wear", "nothing"), (2, 4, 1, "", "text"), (2, 5, 2, "", None)]
    got = retrieval.rerank_proximity(spark.createDataFrame(rows, "query_id long, id long, rank int, question string, content string"), F.col("question"), F.col("content"))
    found = {(r.query_id, r.id): (r.place, r.cover, r.score) for r in got.collect()}
    assert found == {(1, 2): (1, 3, 1.0), (1, 1): (2, 6, 0.65), (1, 3): (3, 0, 0.0), (2, 4): (1, 0, 0.0), (2, 5): (2, 0, 0.0)}


# --- lexical segments -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@pytest.fixture(scope="module")
def asked(spark, sf_dir):
    words = tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(F.split("text", " "), 1, 6).alias("w"))
    return words.select("query_id", F.array_join("w", " ").alias("question"))


def hits(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


def test_lexical_segments(spark, corpus, asked, tmp_path):
    """Added, deleted, merged and reopened, with the weights of what is left each time."""
    index = LexicalIndex(spark, str(tmp_path), block_docs=16, fanout=3)
    with pytest.raises(ValueError):
        index.search(asked)
    index.add(corpus.where("id % 4 = 0"))
    index.add(corpus.where("id % 4 = 1"))
    index.delete(corpus.where("id % 8 = 1 or id = 4").select("id"))
    index.delete(corpus.where("id % 8 = 1").select("id"))
    left = corpus.where("(id % 4 = 0 and id <> 4) or (id % 4 = 1 and id % 8 <> 1)")
    assert len(index.segments()) == 2 and hits(index.search(asked, 10)) == hits(retrieval.bm25(left, asked, 10))
    index.add(corpus.where("id % 4 = 2 or id = 4"))
    again = LexicalIndex(spark, str(tmp_path), block_docs=16, fanout=3)
    left = left.union(corpus.where("id % 4 = 2 or id = 4"))
    assert [s[0] for s in again.segments()] == [1] and hits(again.search(asked, 10)) == hits(retrieval.bm25(left, asked, 10))
    again.delete(corpus.where("id = 2").select("id"))
    again.expire()
    assert hits(LexicalIndex(spark, str(tmp_path)).search(asked, 10)) == hits(retrieval.bm25(left.where("id <> 2"), asked, 10))


def test_block_max_skips_blocks(spark, tmp_path):
    """Blocks whose bound can't reach the last hit are not scored, and a search reads the folders of its terms only."""
    rng = random.Random(8)
    rows = [(i, " ".join(["pump"] * (12 if i % 40 == 0 else 1) + [f"w{rng.randrange(3000)}" for _ in range(30)])) for i in range(1200)]
    corpus = spark.createDataFrame(rows, "id long, content string")
    index = LexicalIndex(spark, str(tmp_path), block_docs=8)
    index.add(corpus)
    asked = spark.createDataFrame([(1, "pump w7 w8 w9 nowhere")], "query_id long, question string")
    assert hits(index.search(asked, 5)) == hits(retrieval.bm25(corpus, asked, 5))
    every, read = index.bounds(asked).count(), index.scored(asked, 5, 4)[1].count()
    assert read < every / 2
    plan = index._read("postings").where(index._asked(asked)[1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan


def test_lexical_given_tokens(spark, tmp_path):
    """Tokens of a segmenter take the place of the plain ones; texts without tokens count in the mean length."""
    rows = spark.createDataFrame([(1, ["知识", "图谱"]), (2, []), (3, None)], "id long, tokens array<string>")
    index = LexicalIndex(spark, str(tmp_path))
    index.add(rows)
    assert index.weights().first().avgdl == pytest.approx(2 / 3)
    assert Counter(r.term for r in index._read("postings").collect()) == {"知识": 1, "图谱": 1}


def test_lexical_add_shuffles_nothing(spark, tmp_path, monkeypatch):
    """Postings are made where the documents lie, and each document is in one block only."""
    index, seen = LexicalIndex(spark, str(tmp_path), block_docs=2), []
    write = LexicalIndex._write
    monkeypatch.setattr(LexicalIndex, "_write", lambda self, rows, *more: seen.append(rows) or write(self, rows, *more))
    index.add(spark.createDataFrame([(i, f"pump {i % 3} seal") for i in range(9)], "id long, content string"))
    assert "Exchange" not in seen[0]._jdf.queryExecution().toString()
    docs = index._read("docs").collect()
    assert sorted(r.id for r in docs) == list(range(9)) and max(Counter((r.seg, r.block) for r in docs).values()) == 2


def test_windows_hash_blocks():
    told = evidence.points("abcabcabc")
    one = evaluation._windows(told, 3)
    assert len(np.unique(one)) == 3 and one[0] == one[3] == one[6]
