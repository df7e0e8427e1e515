"""Data sources of skill files and golden sets, in batches and as streams."""

import json

import pytest

from ragloom.sources import formats


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    for name, text in {"a": "---\nid: one\nname: 'First'\n# note: x\n---\nBody of one", "b": "no front", "c": "---\nname: x\n---\nbody"}.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "SKILL.md").write_text(text)
    (tmp_path / "in" / "set.jsonl").write_text('// note\n{"id": 1, "question": "q?", "evidences": ["e", " "], "category": "fact"}\n\n{broken\n{"id": 2}\n')
    (tmp_path / "in" / "bad.jsonl").write_bytes(b"\xff\xfe")
    return tmp_path / "in"


def test_groups():
    files = [("a", 5, 0), ("b", 5, 0), ("c", 20, 0), ("d", 1, 0)]
    assert [g.paths for g in formats.groups(files, 10)] == [["a", "b"], ["c"], ["d"]] and formats.groups([]) == []


def test_read_skills(spark, folder):
    rows = {r.path[len(str(folder)) + 1 :][0]: r for r in spark.read.format("ragloom_skills").load(str(folder)).collect()}
    assert (rows["a"].id, rows["a"].name, rows["a"].body, rows["a"].error) == ("one", "First", "Body of one", None)
    assert rows["b"].error == "no front matter" and rows["c"].error == "no id"


def test_read_golden(spark, folder):
    rows = spark.read.format("ragloom_golden").load(str(folder))
    got = sorted((r.path.rsplit("/", 1)[1], r.line, r.id, r.question, r.evidences, r.error) for r in rows.where("line is not null").collect())
    assert got == [("set.jsonl", 2, "1", "q?", ["e"], None), ("set.jsonl", 4, None, None, [], "line 4: JSONDecodeError"), ("set.jsonl", 5, None, None, [], "line 5: KeyError")]
    assert [r.error for r in rows.where("line is null").collect()] == ["UnicodeDecodeError"]


def test_pushed_filter(spark, folder):
    rows = spark.read.format("ragloom_golden").load(str(folder)).where(f"path = '{folder}/set.jsonl' and line = 2")
    assert rows.count() == 1
    kind = formats._Kind(str(folder), ".jsonl", formats.golden_rows, 7)
    reader = formats.FilesReader(kind)
    left = list(reader.pushFilters([formats.EqualTo(("path",), f"{folder}/set.jsonl"), formats.EqualTo(("line",), 2)]))
    assert [f.attribute for f in left] == [("line",)] and [g.paths for g in reader.partitions()] == [[f"{folder}/set.jsonl"]]


def test_stream(spark, folder, tmp_path):
    def run():
        out = spark.readStream.format("ragloom_golden").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).where("id is not null").collect())

    assert run() == ["1"]
    (folder / "more.jsonl").write_text(json.dumps({"id": "9", "question": "?"}))
    assert run() == ["1", "9"]
