"""Golden cases of single operators."""

import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import catalog, chunking, evaluation, interview, layout, retrieval
from ragloom.sources import tables


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


def test_citations(spark):
    cases = {"a [1,3,5]": [1, 3, 5], "b [2-4]": [2, 3, 4], "c [5-2]": [], "d [x]": [], "e [1-40]": [], "f [1][1]": [1]}
    for text, want in cases.items():
        assert one(spark, T.cited_numbers(F.col("v")), text) == want


def test_strip_citations(spark):
    assert one(spark, T.strip_citations(F.col("v"), F.lit(2)), "yes [1] and [9] too.") == "yes [1] and too."
    assert one(spark, T.strip_citations(F.col("v"), F.lit(2)), "yes  [1]") == "yes  [1]"


def test_titles(spark):
    assert one(spark, T.title(F.col("v")), " \n ") == T.EMPTY_TITLE
    long = one(spark, T.title(F.col("v")), "x" * 100)
    assert len(long) == 41 and long.endswith("…")


def test_section_numbers(spark):
    assert one(spark, layout.section_number(F.col("v")), "1333 things") is None
    assert one(spark, layout.section_number(F.col("v")), "3.2 things") == "3.2"


def test_page_numbers(spark):
    for text in ("12", "- 7 -"):
        assert one(spark, layout.drop_page_numbers(F.col("v")), text) == ""


def test_line_merge(spark):
    assert one(spark, layout.merge_broken_lines(F.col("v")), "look at each\nstation in turn") == "look at each station in turn"
    assert one(spark, layout.merge_broken_lines(F.col("v")), "设备维护的说明\n见下页") == "设备维护的说明见下页"


def test_line_merge_cases(spark):
    cases = {
        "Key:\nvalue of it": "Key:\nvalue of it", "abc\ndefghi\njkl": "abc\ndefghi jkl", "one line of\n\ntext": "one line of text", "a sentence.\nnext": "a sentence.\nnext",
        "the list has\n- first item\nof two": "the list has\n- first item of two", "见下文的说明\n第三章 维护": "见下文的说明\n第三章 维护", "long enough\nx\ny": "long enough x y", "  only ": "only", None: None,
    }
    for text, want in cases.items():
        assert one(spark, layout.merge_broken_lines(F.col("v")), text) == want, text


def test_clean_text(spark):
    assert one(spark, layout.tidy_space(F.col("v")), "a\u200bb\ue621\u202a  c\u3000\u3000d\r\n e ") == "ab c d\ne"
    assert [one(spark, layout.drop_page_numbers(F.col("v")), t) for t in ("[12]", "— 3 —", "12345", "p 3")] == ["", "", "12345", "p 3"]
    assert [one(spark, layout.is_cjk(F.col("v")), t) for t in ("a", "。", "㐀", "ＡＢ")] == [False, True, True, True]
    docs = spark.createDataFrame([(1, "3.1 Heading\nThe first line of a text\ngoes on here.\n7\n3.1 Heading\nend.")], "doc_id long, text string")
    rows = layout.clean_documents(docs, tables.paragraphs).orderBy("seq").collect()
    assert [(r.text, r.section_number) for r in rows][0][0].startswith("3.1 Heading The first line")


def page_of(spark, rows, **more):
    return spark.createDataFrame([(1, 1, i, f"b{i}", *map(float, r), 600.0) for i, r in enumerate(rows)], "doc_id long, page_no int, seq int, text string, x0 double, y0 double, x1 double, y1 double, page_width double")


def test_columns_and_spanning_blocks(spark):
    left, right = [(50, y, 280, y + 20) for y in (100, 130, 160)], [(320, y, 550, y + 20) for y in (105, 135, 165, 300)]
    order = lambda rows: [r.seq for r in layout.reading_order(page_of(spark, rows)).orderBy("position").collect()]
    assert order([*right, *left]) == [4, 5, 6, 0, 1, 2, 3]
    assert order([*right[:2], *left]) == [2, 0, 3, 1, 4]  # five blocks: by height
    # a wide block covers the bins of the gutter: one column
    assert order([(50, 250, 550, 260), *right, *left])[:2] == [5, 1]
    found = layout.gutters(page_of(spark, [*right, *left])).first()
    assert 280 < found.gutter < 320
    bare = page_of(spark, [(50, 250, 550, 260), *right, *left]).drop("page_width")
    assert [r.seq for r in layout.reading_order(bare).orderBy("position").collect()] == [5, 6, 7, 1, 2, 3, 0, 4]
    assert layout.gutters(page_of(spark, [(50, y, 290, y + 9) for y in range(0, 60, 10)] + [(320, 0, 500, 9)])).count() == 0


def test_read_blocks(spark):
    def reader():
        def read(content):
            if content == b"bad":
                raise ValueError("broken")
            return {"metadata": {"title": "T", "author": ""}, "pages": [(1, 600.0, [(0, 0, 10, 10, 12.0, content.decode())])]}

        return read

    files = spark.createDataFrame([("a.pdf", bytearray(b"text")), ("b.pdf", bytearray(b"bad"))], "path string, content binary")
    got = {r.doc_id: r for r in tables.read_blocks(files, reader).collect()}
    assert (got["a.pdf"].text, got["a.pdf"].metadata, got["a.pdf"].error) == ("text", {"title": "T"}, None) and got["b.pdf"].error == "ValueError: broken"


def test_sentences(spark):
    assert one(spark, chunking.split_sentences(F.col("v")), "参见 3.2 节关于设备维护的说明") == ["参见 3.2 节关于设备维护的说明"]
    assert one(spark, chunking.split_sentences(F.col("v")), "One. Two! three") == ["One.", "Two!", "three"]


def test_params():
    for wrong in ({"child_size": 2000}, {"overlap": 300}, {"strategy": "x"}, {"separators": ()}):
        with pytest.raises(ValueError):
            chunking.ChunkParams(**wrong).validate()


def test_parent_child(spark):
    docs = spark.createDataFrame([(1, "".join(f"第 {i} 个句子就写在这里。" for i in range(300)))], "doc_id long, text string")
    rows = chunking.parent_child_chunks(chunking.marked_paragraphs(docs), chunking.ChunkParams()).collect()
    children = [r for r in rows if r.chunk_type == "child"]
    assert all(len(r.content) <= 300 + 30 for r in children)  # a short last one joins the one before
    assert "第 299 个句子就写在这里。" in children[-1].content
    assert {r.parent_id for r in children} == {r.id for r in rows if r.chunk_type == "parent"}


def paras(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, seq int, text string, page_no int, is_heading boolean, section_number string")


def test_parent_child_sections_and_pages(spark):
    p = chunking.ChunkParams(parent_size=60, child_size=24, overlap=8, min_size=4)
    rows = paras(spark, [("before any heading.", 1, False, None), ("3 Title", 1, True, "3"), ("One one one. Two two. Three three!", 1, False, None), ("More of it.", 2, False, None), ("3.1 Sub", 2, True, "3.1"), ("x" * 30 + ". " + "Y" * 40 + ".", 3, False, None)])
    got = chunking.parent_child_chunks(rows, p).orderBy("parent_no", "child_no").collect()
    parents = [(r.content, r.page_start, r.page_end, r.section_path) for r in got if r.chunk_type == "parent"]
    assert parents == [
        ("before any heading.", 1, 1, ""), ("3 Title\n\nOne one one. Two two. Three three!\n\nMore of it.", 1, 2, "3 Title"),
        ("3.1 Sub", 2, 2, "3 Title > 3.1 Sub"), ("x" * 30 + ".", 3, 3, "3 Title > 3.1 Sub"), ("Y" * 40 + ".", 3, 3, "3 Title > 3.1 Sub"),
    ]
    second = [(r.content, r.page_start, r.page_end) for r in got if r.chunk_type == "child" and r.parent_no == 1]
    assert second == [("3 TitleOne one one.", 1, 1), ("One one one.Two two.", 1, 1), ("Two two.Three three!", 1, 1), ("Three three!More of it.", 1, 2)]
    assert [r.id for r in got if r.chunk_type == "child"][:2] == ["1_p0000_c000", "1_p0001_c000"]


@given(st.lists(st.integers(1, 40), max_size=30), st.integers(1, 50), st.integers(0, 60))
def test_sentence_runs(sizes, limit, overlap):
    runs = chunking.sentence_runs(sizes, limit, overlap)
    assert sorted({i for a, b in runs for i in range(a, b)}) == list(range(len(sizes)))
    for (a, b), (c, d) in zip(runs, runs[1:], strict=False):
        assert a <= c <= b < d and (c < b) == (overlap > 0)
        assert b - c <= 1 or sum(sizes[c:b]) <= min(overlap, limit // 2)
    runs = chunking.greedy_runs(sizes, limit)
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or sum(sizes[a:b]) <= limit for a, b in runs)
    assert all(sum(sizes[a:b]) + sizes[b] > limit for a, b in runs[:-1])


def test_size_parents(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([" aaaa ", "bbbb", "  ", "cccc", "d" * 30, "ee"])], "doc_id long, no int, content string")
    got = [(r.no, r.parent_no, r.child_no, r.content) for r in chunking.size_parents(rows, 10).orderBy("no").collect()]
    assert got == [(0, 0, 0, "aaaa"), (1, 0, 1, "bbbb"), (3, 1, 0, "cccc"), (4, 2, 0, "d" * 30), (5, 3, 0, "ee")]


def test_short_chunks(spark):
    make = lambda *sizes: spark.createDataFrame([(1, i, chr(97 + i) * n) for i, n in enumerate(sizes)], "doc_id long, no int, content string")
    told = lambda df: [(r.first_no, len(r.content)) for r in chunking.coalesce_short(df, 10).orderBy("no").collect()]
    assert told(make(3, 4, 20, 5, 10)) == [(2, 32), (4, 10)] and told(make(6, 6, 20)) == [(0, 12), (2, 20)] and told(make(3, 2)) == [(0, 5)]


def test_overlap_stays_behind_the_span_before(spark):
    rows = spark.createDataFrame([(1, i, s, s + 100) for i, s in enumerate([0, 10, 20, 200])], "doc_id long, no int, start int, end int")
    assert [r.start for r in chunking.overlap_spans(rows, 50).orderBy("no").collect()] == [0, 1, 2, 150]


def test_separators():
    assert chunking.parse_separators("\\n\\n|\\t||。") == ["\n\n", "\t", "。"] and chunking.parse_separators("") == list(chunking.SEPARATORS)
    assert chunking.format_separators(["\n", "a"]) == "\\n|a"


def test_chunk_reports(spark):
    rows = spark.createDataFrame([(1, "parent", "a" * 100, "", 200), (1, "child", "a" * 70, "S", 300), (1, "child", "a" * 50, "", 300), (2, "child", "", "", 300)], "doc_id long, chunk_type string, content string, section_path string, end int")
    got = {r.doc_id: r for r in chunking.chunk_summary(rows).collect()}
    assert (got[1].parents, got[1].children, got[1].expansion_ratio, got[1].heading_coverage) == (1, 2, 1.2, 0.5) and got[2].expansion_ratio == 0
    assert {r.doc_id: r.alarm for r in chunking.alarms(rows, "section_path").collect()} == {1: "small chunks", 2: "none"}
    headless = spark.createDataFrame([(1, "x" * 100, "", 900), (1, "x" * 100, "S", 900), (1, "x" * 100, None, 900)], "doc_id long, content string, section_path string, end int")
    assert chunking.alarms(headless, "section_path").first().alarm == "no sections" and chunking.alarms(headless).first().alarm == "fine"
    nested = chunking.nested_preview(spark.createDataFrame([("p", "parent", None, None), ("c2", "child", "p", 1), ("c1", "child", "p", 0), ("q", "parent", None, None)], "id string, chunk_type string, parent_id string, child_no int"))
    assert {r.id: r.child_ids for r in nested.collect()} == {"p": ["c1", "c2"], "q": []}


def test_fusion_prefers_what_both_lists_have(spark):
    lists = [spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id long, id string, rank int") for ids in ("abc", "cd")]
    rows = retrieval.fuse([("vector", lists[0]), ("bm25", lists[1])]).orderBy("rank").collect()
    assert rows[0].id == "c" and rows[0].sources == "bm25+vector"


def test_parent_dedupe(spark):
    rows = spark.createDataFrame([(1, "c1", "p1", 0.3, 1), (1, "c3", "p2", 0.5, 2), (1, "c2", "p1", 0.9, 3)], "query_id long, id string, parent_id string, score double, rank int")
    assert [(r.id, r.parent_id) for r in retrieval.dedupe_parents(rows).orderBy("rank").collect()] == [("c2", "p1"), ("c3", "p2")]


def test_empty_filter_matches_nothing(spark):
    rows = spark.createDataFrame([("u", "d")], "user_id string, doc_id string")
    assert rows.where(retrieval.search_filter(user_id="u", doc_ids=[])).count() == 0
    assert rows.where(retrieval.search_filter(user_id="u")).count() == 1


def test_threshold(spark):
    rows = spark.createDataFrame([(True, x) for x in (0.9, 0.85, 0.95)] + [(False, x) for x in (0.2, 0.3, 0.1)], "answerable boolean, top_score double")
    best = evaluation.best_threshold(evaluation.threshold_sweep(rows)).first()
    assert best.threshold == 0.85 and best.loss == 0


def test_refusals(spark):
    rows = spark.createDataFrame([(True, False), (True, True), (False, True), (False, False)], "answerable boolean, refused boolean")
    r = evaluation.refusal_rates(rows).first()
    assert r.false_refusal_rate == r.false_answer_rate == 0.5


def test_spoken(spark):
    cases = {
        "温度 2~10 度 [1-3]": "温度 2到10 度", "# 标题\n- **粗体** 与 `code`": "标题\n粗体 与 code", "看[文档](https://a.b/c)和 https://x.y": "看文档和",
        "a\n```py\nx\n```\nb": "a\nb", "做过吗？→ 说说": "做过吗？说说", "提升 40% → 怎么测": "提升 40%，怎么测", "QPS 与 XQPS": "Q P S 与 XQPS",
        "A & B | C…": "A 和 B ， C。", "好（ ）吗。。。": "好吗。", "***both*** 😀": "both", "|a|b|\n|---|---|\n": "，a，b，", None: "",
    }
    for text, want in cases.items():
        assert one(spark, T.spoken(F.col("v")), text) == want, text
    assert one(spark, T.cut_at_sentence(F.col("v"), 10), "一二三四五。七八，十十一") == "一二三四五。"
    assert one(spark, T.cut_at_sentence(F.col("v"), 10), "ab. defg? ijklm") == "ab. defg?" and one(spark, T.cut_at_sentence(F.col("v"), 10), "a.cdefghijklm") == "a.cdefghij"


def test_terms(spark):
    assert one(spark, T.terms(F.col("v")), "Use Js, go and AI with C# or the Redis-cluster. ml x redis REDIS Redis") == ["AI", "C#", "Js", "redis", "Redis-cluster"]
    found = one(spark, T.traceability(F.col("v"), F.lit("we run redis")), "Why Redis over Kafka?")
    assert (found.ok, found.unknown, found.grounded) == (False, ["Kafka"], ["Redis"]) and one(spark, T.traceability(F.col("v"), F.lit(None).cast("string")), "why?").ok


def test_display_lines(spark):
    assert one(spark, T.display_lines(F.col("v"), 3.0), "日本語日ab") == ["日本語", "日ab"]


def test_audio_rates(spark):
    mp3 = b"ID3\x03" + bytes(20) + b"\xff\xfb\x90\x00" + bytes(10)
    rate = lambda data, name: spark.createDataFrame([(bytearray(data), name)], "v binary, n string").select(T.audio_rate(F.col("v"), F.col("n")).alias("x")).first().x
    assert rate(mp3, "") == 44100 and rate(b"\xff\xf3\x84\x00", "a.mp3") == 24000 and rate(b"\xff\xeb\x90\x00", "a.mp3") is None and rate(b"\xff", "a.mp3") is None and rate(mp3, "a.ogg") == 44100 and rate(b"xxxxxxx", "a.ogg") is None


def test_wav(spark):
    head = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x01\0\x01\0" + (16000).to_bytes(4, "little")
    assert one(spark, T.wav_rate(F.col("v")), bytearray(head), "binary") == 16000
    assert one(spark, T.wav_rate(F.col("v")), bytearray(b"x" * 40), "binary") is None


def test_golden_round_trip(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('// note\n\n{"id": "q1", "question": "?", "evidences": ["a", " "]}\n')
    items = tables.read_golden(spark, str(path))
    assert items.first().evidences == ["a"]
    tables.write_golden(items, str(tmp_path / "out"))
    assert tables.read_golden(spark, str(tmp_path / "out")).first().id == "q1"


def test_golden_errors_tell_the_line(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"question": "?"}\n\nbroken\n')
    with pytest.raises(Exception, match="line 3"):
        tables.read_golden(spark, str(path)).collect()


def test_skill_files(spark, tmp_path):
    told = {"a": "---\nid: one  # note\nname: 'First # kept'\ntags: [x, 'y']\nmax_follow_up: 2\nrequire_evidence: yes\n---\nBody.", "b": "---\nid: one\n---\nAgain.", "c": "no front matter", "d": "---\nname: nameless\n---\nx", "e": "---\nid: five\nmax_turns: many\n---\nx"}
    for name, text in told.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    rows = {r.path.split("/")[-2]: r for r in tables.read_skills(spark, str(tmp_path)).collect()}
    assert {k: r.error for k, r in rows.items()} == {"a": None, "b": "repeated id", "c": "no front matter", "d": "no id", "e": "not a number"}
    a = rows["a"]
    assert (a.id, a.name, a.tags, a.max_follow_up, a.max_turns, a.require_evidence, a.body) == ("one", "First # kept", ["x", "y"], 2, 20, True, "Body.")


def test_overrides(tmp_path):
    path = str(tmp_path / "s.json")
    assert tables.read_overrides(path, {"a"}) == {}
    tables.write_overrides(path, {"a": 1, "b": 2})
    assert tables.read_overrides(path, {"a"}) == {"a": 1}
    (tmp_path / "s.json").write_text("{")
    assert tables.read_overrides(path, {"a"}) == {}


def test_settings():
    base = catalog.Settings()
    assert base.update({"child_size": "200", "overlap": 0, "unknown": 1, "rrf_k": None}).as_dict() | {"child_size": 300, "overlap": 50} == base.as_dict()
    for wrong in ({"child_size": 1500}, {"overlap": 300}, {"final_top_k": 21}):
        with pytest.raises(ValueError):
            base.update(wrong)


def test_write_by_document(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame([(i, f"old {i}") for i in range(20)], "doc_id long, content string")
    tables.write_by_document(rows, path, 4)
    stored = spark.read.parquet(path).drop("bucket")
    new = tables.replace_documents(stored, spark.createDataFrame([(3, "new"), (3, "two")], "doc_id long, content string"))
    tables.write_by_document(spark.createDataFrame(new.collect(), new.schema), path, 4)
    got = spark.read.parquet(path)
    assert got.count() == 21 and {r.content for r in got.where("doc_id = 3").collect()} == {"new", "two"}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0.5, 3), ("a", 1.0, None)], "name string, mrr double, n int")
    assert evaluation.render_report(rows, ["name", "mrr", "n"]).splitlines()[2:] == ["| name | mrr | n |", "|---|---|---|", "| a | 1.000 |  |", "| b | 0.500 | 3 |"]
    evaluation.write_report(rows, str(tmp_path / "r"), ["name", "mrr"])
    assert spark.read.json(str(tmp_path / "r/configs")).count() == 2 and "| a | 1.000 |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "r/report")).collect())


def test_percentiles_and_cumulative(spark):
    values = [(float(x % 37),) for x in range(1000)] + [(None,)]
    rows = spark.createDataFrame(values, "v double")
    got = evaluation.percentiles(rows, "v", (0.0, 0.5, 0.95, 1.0)).first()
    assert list(got) == pytest.approx(np.percentile([v for (v,) in values[:-1]], [0, 50, 95, 100]).tolist())
    assert evaluation.latency(rows.limit(0), "v").first().p50 is None
    cum = evaluation.cumulative(spark.createDataFrame([(i, 1) for i in (5, 1, 1, 9)], "k long, one int"), "k", ["one"])
    assert sorted((r.k, r.before_one, r.all_one) for r in cum.collect()) == [(1, 0, 4), (1, 0, 4), (5, 2, 4), (9, 3, 4)]


def test_encoder_is_called_in_batches(spark):
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(70)], "id long, t string")

    def model():
        return lambda texts: [[float(len(t)), float(len(texts) <= 32)] for t in texts]

    got = {r.id: r.v for r in retrieval.encode(rows, "t", "v", model, prefix="pp").collect()}
    assert got[2] == pytest.approx([4 / 17**0.5, 1 / 17**0.5]) and len(got) == 70
    retrieval.check_cardinality(rows.limit(1), spark.createDataFrame([("child",), ("parent",)], "chunk_type string"))
    with pytest.raises(ValueError):
        retrieval.check_cardinality(rows, rows.limit(0).withColumn("chunk_type", F.lit("child")))


def test_retrieve_and_answer(spark):
    children = spark.createDataFrame([("c1", "p1", "pump seal wear", "u"), ("c2", "p1", "pump motor noise", "u"), ("c3", "p9", "valve seat leak", "u"), ("c4", "p2", "pump seal wear", "other")], "id string, parent_id string, content string, user_id string")
    parents = spark.createDataFrame([("p1", "all of the pump")], "parent_id string, content string")
    queries = spark.createDataFrame([(1, "pump seal"), (2, "valve leak"), (3, "unrelated words")], "query_id long, question string")
    found, outcomes = retrieval.retrieve(children, queries, parents, where=retrieval.search_filter(user_id="u"), min_score=0.2)
    rows = {(r.query_id, r["index"]): (r.id, r.content) for r in found.collect()}
    assert rows[1, 1] == ("c1", "all of the pump") and rows[2, 1] == ("c3", "valve seat leak") and not any(q == 3 for q, _ in rows)
    assert {r.query_id: r.reason for r in outcomes.collect()} == {1: "", 2: "", 3: "low_score"}
    said = retrieval.answer(queries, found, outcomes, generate=lambda p: F.lit("Seal [1], not [7] ."))
    got = {r.query_id: r for r in said.collect()}
    assert got[1].answer == "Seal [1], not." and [c["index"] for c in got[1].citations] == [1] and got[3].answer is None and got[3].refused
    assert "【用户问题】\npump seal" in got[1].prompt
    events = retrieval.answer_events(said).orderBy("query_id", "seq").collect()
    assert [e.event for e in events if e.query_id == 1] == ["conversation", "stage", "sources", "token", "citations", "done"] and [e.event for e in events if e.query_id == 3] == ["conversation", "stage", "token", "done"]
    told = retrieval.answer_events(said.withColumns({"search": F.lit("other"), "error": F.when(F.col("query_id") == 2, "broken")})).orderBy("query_id", "seq").collect()
    assert [e.event for e in told if e.query_id == 2] == ["conversation", "stage", "error"] and '"rewritten":true' in told[1].data
    plain, _ = retrieval.retrieve(children, queries, parents, reranked=False)
    assert plain.count() > 0


def test_interview_texts(spark):
    plan = '```json\n[{"topic": " T ", "angle": "A", "opening": " O? "}, {"topic": "x", "opening": " "}]\n```'
    assert one(spark, interview.rendered_outline(interview.cleaned_outline(F.col("v")), F.lit(0)), plan) == "【面试提纲】\n  1. T（A）  ← 当前"
    assert one(spark, F.size(interview.cleaned_outline(F.col("v"))), "garbage") == 0
    report = one(spark, interview.summary_report(F.col("v")), '```json\n{"overall": "fine", "highlights": ["h"]}\n```')
    assert (report.overall, report.highlights, report.concerns) == ("fine", ["h"], [])
    assert one(spark, interview.summary_report(F.col("v")), " not json ").overall == "not json"
    assert one(spark, interview.rendered_evaluation(F.lit("d"), F.lit(""), F.array(F.lit("a"), F.lit("b")))) == "\n【上一轮回答的评估】\n  - 可疑点：d\n  - 出现了模糊表述：a、b"


def test_history_drops_errors(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", None), (1, 1, "assistant", "b", "broken"), (1, 2, "system", "c", None), (1, 3, "user", " ", None)], "conv_id long, turn int, role string, text string, error string")
    assert [r.turn for r in catalog.last_messages(rows).collect()] == [0]


def test_streams(spark, tmp_path):
    """Windows and sessions with late events, conversation counts and the interview machine, over batches of files."""
    from ragloom.streaming import jobs

    def stream(name, parts, schema, plan, mode):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / name / f"in{i}"))
            for file in (tmp_path / name / f"in{i}").glob("*.json"):
                os.utime(file, (1_700_000_000 + 60 * i,) * 2)  # files come in order of their time
        table, query = f"out_{name}", None
        source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(str(tmp_path / name))
        query = plan(source).writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        query.awaitTermination(120)
        return spark.table(table)

    from datetime import datetime as at

    schema = "event_type string, user_id long, value double, ts timestamp"
    parts = [[("a", 1, 1.0, at(2024, 1, 1, 1)), ("a", 1, 2.0, at(2024, 1, 1, 1, 10))], [("a", 1, 4.0, at(2024, 1, 3))], [("a", 2, 0.5, at(2024, 1, 3, 0, 5))], [("a", 1, 8.0, at(2024, 1, 1, 2))], [("b", 1, 9.0, at(2024, 1, 9))]]
    rows = stream("windows", parts, schema, lambda s: jobs.event_windows(s, "1 day", "1 hour"), "append").orderBy("window_start").collect()
    assert [(r.event_type, r.n, r.total) for r in rows] == [("a", 2, 3.0), ("a", 2, 4.5)]
    rows = stream("sessions", parts, schema, lambda s: jobs.sessions(s, "30 minutes", "1 hour"), "append").orderBy("session_start").collect()
    assert [r.n for r in rows] == [2, 1, 1]
    said = "conv_id long, turn int, role string, text string, ts timestamp"
    rows = stream("convs", [[(1, 1, "user", "later", at(2024, 1, 2))], [(1, 0, "user", "first", at(2024, 1, 1))]], said, jobs.conversation_state, "complete").collect()
    assert [(r.message_count, r.first_text) for r in rows] == [(2, "first")]
    acts = ["FOLLOW_UP", "NEXT_TOPIC", "FOLLOW_UP", "FOLLOW_UP", None, "FOLLOW_UP"]
    turns = [(1, i, a) for i, a in enumerate(acts)]
    rows = stream("interview", [turns[:2], turns[2:5], turns[5:]], "key long, turn int, action string", lambda s: jobs.interview_states(s, 6), "append").orderBy("turn").collect()
    want = interview.states(spark.createDataFrame(turns, "key long, turn int, action string"), "key", "turn", max_turns=6).orderBy("turn").collect()
    assert [(r.topic, r.depth, r.finished) for r in rows] == [(r.topic, r.depth, r.finished) for r in want]


def test_stream_ingest(spark, sf_dir, tmp_path):
    from ragloom.streaming import jobs

    docs = tables.load(spark, sf_dir, "documents").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    jobs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), chunking.ChunkParams(strategy="fixed")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == docs.where("text <> ''").count()


def test_interview_states(spark):
    acts = ["FOLLOW_UP", "NEXT_TOPIC", "FOLLOW_UP", "FOLLOW_UP", None, "FOLLOW_UP"]
    rows = interview.states(spark.createDataFrame([(1, i, a) for i, a in enumerate(acts)], "k long, t int, action string"), "k", "t", max_turns=6).orderBy("t").collect()
    assert [(r.topic, r.depth) for r in rows] == [(0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert [r.finished for r in rows] == [False] * 5 + [True]


def test_match_ratio(spark):
    cases = [("abcdefghijXYZ", "zzabcdefghij__", 10 / 14), ("say ABC here", "abc", 1.0), ("aXbXcX", "abc", 0.0), (None, "abc", 0.0), ("abc", None, 0.0)]
    rows = spark.createDataFrame([c[:2] for c in cases], "content string, evidence string").select(evaluation.match_ratio(F.col("content"), F.col("evidence")).alias("r")).collect()
    assert [r.r for r in rows] == pytest.approx([c[2] for c in cases])


@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_longest_common_equals_brute_force(a, b):
    want = max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    points = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b)]
    assert evaluation.longest_common(*points) == want


def test_evidence_cut_at_a_chunk_edge_is_found(spark):
    evidences = spark.createDataFrame([(1, 1, "abcdefghijklmnopqrst"), (2, 1, "abcdefghijklmnopqrst")], "item_id long, evidence_no int, evidence string")
    texts = [(1, 1, "nothing of it"), (1, 2, "xx ABCDEFGH IJKL"), (1, 3, "abcdefghijklmnopqrst"), (2, 1, "abcdefghijk")]
    retrieved = spark.createDataFrame(texts, "item_id long, rank int, content string")
    ranks = evaluation.evidence_ranks(evidences, retrieved)
    assert {r.item_id: r.hit_rank for r in ranks.collect()} == {1: 2, 2: None}
    scores = {r.item_id: r for r in evaluation.question_scores(ranks, retrieved).collect()}
    assert scores[1].matched == 2 and scores[1].rr == 0.5 and scores[2].matched == 0


def test_rewrite_hints(spark):
    hints = "它 他 她 这个 那个 这些 那些 该 此 上面 上述 前面 刚才 呢 还有 继续 那么 然后".split()
    cases = [(f"设备维护周期{h}钢刀更换周期", True) for h in hints] + [("设备维护周期与钢刀更换周期", False), ("其设备维护周期与钢刀更换周期", False), ("short", True)]
    rows = spark.createDataFrame(cases, "v string, want boolean").select("v", "want", T.needs_rewrite(F.col("v")).alias("got")).collect()
    assert [r.v for r in rows if r.want != r.got] == []


def test_ranks_of_whole_evidence_leave_out_near_copies(spark):
    evidences = spark.createDataFrame([(1, 1, "abcdefghij klmnopqrst")], "item_id long, evidence_no int, evidence string")
    retrieved = spark.createDataFrame([(1, 1, "abcdefghijklmnopqrsX"), (1, 2, "see ABCDEFGHIJ\nklmnopqrst")], "item_id long, rank int, content string")
    assert evaluation.evidence_ranks(evidences, retrieved).first().hit_rank == 1
    assert evaluation.evidence_ranks(evidences, retrieved, whole=True).first().hit_rank == 2


def test_cleaning_holds_few_texts(spark):
    """Only a slice of a batch becomes Python objects; slices, nulls and texts of any script come back in order."""
    import pyarrow as pa

    from ragloom.operators import layout

    texts = [None, "", "ﬁne Ａ１", "plain"] * 100
    held = []
    got = layout._each(pa.array(texts), lambda x: held.append(x) or layout._composed(x))
    assert got.to_pylist() == [None, "", "fine A1", "plain"] * 100 and held == texts
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    found = rows.select("id", layout.merge_broken_lines(layout.nfkc("text")).alias("text")).orderBy("id").collect()
    assert [r.text for r in found] == [None, "", "fine A1", "plain"] * 100
