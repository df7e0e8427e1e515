"""Documents from text to answers, and keyed streams."""

import pytest
from pyspark.sql import functions as F

from ragloom.operators import retrieval
from ragloom.operators.chunking import ChunkParams
from ragloom.operators.store import DocumentStore
from ragloom.streaming import jobs

PUMP = "1.1 Pump care\nThe pump seal wears after long use. Change the seal every year!\n\n12\nKeep the motor dry and clean at all times."
VALVE = "1.2 Valve care\nA valve seat leaks when it is worn. Grind the seat with fine paste."


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return DocumentStore(spark, str(tmp_path_factory.mktemp("store")), ChunkParams(child_size=60, overlap=10, min_size=5))


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string, filename string")


def test_store(spark, store):
    told = {r.doc_id: r for r in store.ingest(docs(spark, (1, PUMP, "pump.pdf"), (2, VALVE, "valve.pdf"), (3, "", "empty.pdf"), (4, None, None))).collect()}
    assert told[1].status == "READY" and told[1].children >= 2 and told[3].error == "no text" and told[4].status == "FAILED"
    asked = spark.createDataFrame([(1, "pump seal year"), (2, "valve seat paste"), (3, "unrelated words")], "query_id long, question string")
    contexts, outcomes = store.retrieve(asked, min_score=0.05)
    best = {r.query_id: r for r in contexts.where("index = 1").collect()}
    assert best[1].id.startswith("1_") and best[2].id.startswith("2_") and best[1].content.startswith("1.1 Pump care") and set(best) == {1, 2}
    said = {r.query_id: r for r in store.answer(asked, min_score=0.05).collect()}
    assert "来源: pump.pdf 第 1 页" in said[1].prompt and said[3].refused and said[1].search == "pump seal year"
    scoped, _ = store.retrieve(asked, doc_ids=[2])
    assert {r.id.split("_")[0] for r in scoped.collect()} == {"2"}


def test_store_replaces_and_deletes(spark, store):
    store.ingest(docs(spark, (2, "Gears need oil each month. Use thin oil in winter.", "gears.pdf"), (5, VALVE, "again.pdf")))
    again = DocumentStore(spark, store.path, store.params)
    asked = spark.createDataFrame([(1, "valve seat paste"), (2, "gears oil")], "query_id long, question string")
    found = {r.query_id: r.id.split("_")[0] for r in again.retrieve(asked)[0].where("index = 1").collect()}
    assert found == {1: "5", 2: "2"}
    children = again.chunks().where("chunk_type = 'child'").select("id").distinct()
    left = {r.id for r in children.collect()}
    assert {r.id for r in again.vectors.rows().collect()} == left and again.vectors.count() == len(left)
    assert {r.id for r in again.words._left(again.words._read("docs")).collect()} == left
    gone = again.delete(spark.createDataFrame([(5,), (77,)], "doc_id long")).collect()
    assert [(r.doc_id, r.children > 0) for r in gone] == [(5, True)]
    status = {r.doc_id: (r.status, r.filename) for r in again.catalog().collect()}
    assert status[5] == ("DELETED", "again.pdf") and status[2] == ("READY", "gears.pdf") and status[1][0] == "READY"
    assert not again.retrieve(asked)[0].where("id like '5%'").count()


def test_lost_batch_comes_again(spark, store, monkeypatch):
    """A batch that is lost before its statuses are written leaves nothing behind when its documents come again."""
    monkeypatch.setattr(store.vectors, "append", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.ingest(docs(spark, (9, VALVE, "lost.pdf")))
    monkeypatch.undo()
    assert 9 not in {r.doc_id for r in store.catalog().collect()}
    store.ingest(docs(spark, (9, VALVE, "found.pdf")))
    rows = [r.id for r in store.words._left(store.words._read("docs")).where("id like '9_%'").collect()]
    assert len(rows) == len(set(rows)) == store.vectors.rows().where("id like '9_%'").count() > 0


def test_rewritten(spark):
    rows = spark.createDataFrame([(1, "它呢", [("user", "泵怎样维护")]), (2, "how is the pump kept clean", [("user", "x")]), (3, "它呢", [])], "query_id long, question string, history array<struct<role:string,content:string>>")
    got = {r.query_id: r.search for r in retrieval.rewritten(rows, lambda prompt: F.concat(F.lit("检索查询："), F.regexp_extract(prompt, "用户: (.*)", 1))).collect()}
    assert got == {1: "泵怎样维护", 2: "how is the pump kept clean", 3: "它呢"}
    assert {r.search for r in retrieval.rewritten(rows.drop("history")).collect()} == {"它呢", "how is the pump kept clean"}


def test_stream_into_store(spark, sf_dir, tmp_path):
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 800").limit(12)
    few.where("doc_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    store = DocumentStore(spark, str(tmp_path / "store"))
    jobs.ingest_into(store, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination()
    few.where("doc_id % 2 <> 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.ingest_into(store, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination()
    assert {r.doc_id for r in store.catalog().collect()} == {r.doc_id for r in few.collect()} and len(store._batches("status")) == 2


def test_interval_join_of_streams(spark, tmp_path):
    """Purchases within an hour of a click, a late purchase dropped, and clicks without one told once none can come."""
    schema = "event_id long, user_id long, ts timestamp"
    clicks = [(1, 7, "2024-01-01 10:00:00"), (2, 7, "2024-01-01 10:30:00"), (3, 8, "2024-01-01 10:00:00"), (4, 7, "2024-01-02 10:00:00")]
    buys = [(11, 7, "2024-01-01 10:45:00"), (12, 8, "2024-01-01 11:00:01"), (13, 7, "2024-01-02 10:59:00"), (15, 9, "2024-01-02 11:00:00"), (14, 7, "2024-01-01 10:50:00")]

    def parts(name, rows, cuts):
        for no, (a, b) in enumerate(cuts):
            frame = spark.createDataFrame(rows[a:b], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t as timestamp) as ts")
            frame.coalesce(1).write.json(str(tmp_path / name / f"{no}"))

    parts("clicks", clicks, [(0, 3), (3, 4)])
    parts("buys", buys, [(0, 2), (2, 3), (3, 4), (4, 5)])
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(str(tmp_path / name))
    out = jobs.followed_by(read("clicks"), read("buys"), lateness="10 minutes")
    for _ in range(2):  # the second run starts from the stored state
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.first_id, r.then_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert (1, 11) in got and (2, 11) in got and (4, 13) in got and (1, 14) not in got and (2, 14) not in got and (3, None) in got
