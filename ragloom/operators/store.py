"""Documents from text to answers: ingest, replacement and deletion over stored chunks, word postings and vectors, and
retrieval through both indexes.

A batch of documents is cleaned, cut into parents and children, and its children go into the lexical and the vector
index; its statuses are written last and publish it. A batch that is lost midway was never there: what it left in an index is
taken out when its documents come again. A document that comes again replaces what it was.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.operators import layout, retrieval
from ragloom.operators.chunking import ChunkParams, parent_child_chunks
from ragloom.operators.lexical_index import LexicalIndex
from ragloom.operators.vector_index import VectorIndex
from ragloom.sources.tables import paragraphs

STATUS = "doc_id long, filename string, status string, error string, parents long, children long"


class DocumentStore:
    """``DocumentStore(spark, path)`` opens what is stored under a folder, which may be empty. Document ids are numbers."""

    def __init__(self, spark: SparkSession, path: str, params: ChunkParams | None = None, model: Callable | None = None):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.params = (params or ChunkParams()).validate()
        self.words, self.vectors = LexicalIndex(spark, f"{path}/words"), VectorIndex(spark, f"{path}/vectors")

    # --- what is stored ---
    def _batches(self, table: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{table}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(p.getName().split("-")[1]) for p in found if files.exists(hadoop.Path(p, "_SUCCESS")))

    def _read(self, table: str, batches: list[int]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{table}/batch-{no}").withColumn("batch", F.lit(no)) for no in batches]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def catalog(self) -> DataFrame:
        """The last status of each document: ``doc_id, filename, status, error, parents, children, batch``."""
        rows = self._read("status", self._batches("status"))
        if rows is None:
            return self.spark.createDataFrame([], STATUS + ", batch int")
        last = Window.partitionBy("doc_id").orderBy(F.desc("batch"))
        return rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")

    def chunks(self) -> DataFrame | None:
        """Parents and children of the documents that are READY."""
        rows = self._read("chunks", self._batches("status"))
        return None if rows is None else rows.join(self.catalog().where("status = 'READY'").select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")

    # --- changes ---
    def ingest(self, docs: DataFrame) -> DataFrame:
        """Takes in ``(doc_id, text)``, with a ``filename`` if there is one, and gives their statuses: READY with counts of chunks, or
        FAILED with the reason. Ids must not repeat within a batch."""
        no = max([-1, *self._batches("status")]) + 1
        named = docs.select("doc_id", "text", (F.col("filename") if "filename" in docs.columns else F.col("doc_id")).cast("string").alias("filename"))
        paras = layout.clean_documents(named.select("doc_id", "text"), paragraphs)
        parent_child_chunks(paras, self.params).write.mode("overwrite").parquet(f"{self.path}/chunks/batch-{no}")
        made = self.spark.read.parquet(f"{self.path}/chunks/batch-{no}")
        self._take_out(named.select("doc_id"), no)
        children = made.where("chunk_type = 'child'").select("id", "content")
        if not children.isEmpty():
            self.words.add(children)
            coded = retrieval.encode(children, "content", "v", self.model).select("id", "v")
            self.vectors.append(coded) if self.vectors.built() else self.vectors.build(coded)
        count = made.groupBy("doc_id").agg(F.count_if(F.col("chunk_type") == "parent").alias("parents"), F.count_if(F.col("chunk_type") == "child").alias("children"))
        rows = named.join(count, "doc_id", "left").na.fill(0, ["parents", "children"])
        error = F.when(F.col("children") == 0, F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").otherwise("nothing left after cleaning"))
        status = F.when(error.isNull(), "READY").otherwise("FAILED")
        rows.select("doc_id", "filename", status.alias("status"), error.alias("error"), "parents", "children").write.mode("overwrite").parquet(f"{self.path}/status/batch-{no}")
        return self.spark.read.parquet(f"{self.path}/status/batch-{no}")

    def delete(self, gone: DataFrame) -> DataFrame:
        """Takes documents ``(doc_id)`` out of everything; ``doc_id, parents, children`` that they had."""
        no = max([-1, *self._batches("status")]) + 1
        had = self.catalog().where("status = 'READY'").join(gone.select("doc_id").distinct(), "doc_id", "left_semi")
        had.select("doc_id", "filename", F.lit("DELETED").alias("status"), F.lit(None).cast("string").alias("error"), "parents", "children").write.mode("overwrite").parquet(f"{self.path}/pending/batch-{no}")
        named = self.spark.read.parquet(f"{self.path}/pending/batch-{no}")
        self._take_out(named.select("doc_id"), no)
        self.spark.createDataFrame([], parent_schema(self)).write.mode("overwrite").parquet(f"{self.path}/chunks/batch-{no}")
        named.write.mode("overwrite").parquet(f"{self.path}/status/batch-{no}")
        return self.spark.read.parquet(f"{self.path}/status/batch-{no}").select("doc_id", "parents", "children")

    def _take_out(self, docs: DataFrame, before: int) -> None:
        """Removes what the indexes have of these documents, from batches that were lost too."""
        earlier = [n for n in self._batches("chunks") if n <= before]
        rows = self._read("chunks", earlier)
        if rows is None or not (self.words.segments() and self.vectors.built()):
            return
        ids = rows.join(docs, "doc_id", "left_semi").where("chunk_type = 'child'").select("id").distinct()
        if not ids.isEmpty():
            self.words.delete(ids)
            self.vectors.delete(ids)

    # --- answers ---
    def sources(self) -> DataFrame:
        """``id, filename, page_start, page_end, section_path`` of every child."""
        return self.chunks().where("chunk_type = 'child'").join(self.catalog().select("doc_id", "filename"), "doc_id").select("id", "filename", "page_start", "page_end", "section_path")

    def retrieve(self, queries: DataFrame, top_k: int = 20, final_top_k: int = 5, min_score: float = 0.0, probes: int = 16, scorer: Callable[[Column, Column], Column] | None = None, doc_ids: list | None = None) -> tuple[DataFrame, DataFrame]:
        """``retrieval.retrieve`` over what is stored, through both indexes; with ``doc_ids``, hits of other documents don't count, so it looks
        for more. Contexts and outcomes."""
        own = self.chunks()
        children = own.where("chunk_type = 'child'").select("doc_id", "id", "parent_id", "content")
        children = children if doc_ids is None else children.where(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))
        parents = own.where("chunk_type = 'parent'").select(F.col("id").alias("parent_id"), "content")
        asked = retrieval.encode(queries, "question", "q", self.model, retrieval.QUERY_PREFIX if self.model else "").select("query_id", "q")
        depth = top_k if doc_ids is None else 10 * top_k
        hits = self.vectors.search(asked, depth, probes), self.words.search(queries, depth)
        if doc_ids is not None:
            hits = tuple(retrieval.ranked(h.drop("rank").join(children.select("id"), "id", "left_semi"), top_k) for h in hits)
        return retrieval.retrieve(children.drop("doc_id"), queries, parents, top_k=top_k, final_top_k=final_top_k, min_score=min_score, scorer=scorer, model=self.model, hits=hits)

    def answer(self, queries: DataFrame, generate: Callable[[Column], Column] | None = None, rewrite: Callable[[Column], Column] | None = None, **options) -> DataFrame:
        """Answers to ``(query_id, question)``, with a ``history`` of (role, content) if there is one: rewritten where that is needed,
        retrieved, and told with their sources."""
        asked = retrieval.rewritten(queries, rewrite)
        contexts, outcomes = self.retrieve(asked.select("query_id", F.col("search").alias("question")), **options)
        told = retrieval.answer(queries.select("query_id", "question"), contexts, outcomes, generate, self.sources())
        return told.join(asked.select("query_id", "search"), "query_id")


def parent_schema(store: DocumentStore):
    """The schema of stored chunks, from the first batch."""
    return store.spark.read.parquet(f"{store.path}/chunks/batch-{store._batches('chunks')[0]}").schema
