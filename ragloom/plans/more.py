"""Queries of stored rows, state changes, answers, interviews, skills and scalar functions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import catalog, chunking, evaluation, interview, layout, retrieval
from ragloom.operators.lexical_index import LexicalIndex
from ragloom.plans.extended import ORACLES, QUERIES
from ragloom.plans.registry import BLOCKS, BM25, CHUNKS, FUSED, _blocks, _bm25, _corpus, _golden, _messages, _queries, _rrf, _SCORED, query
from ragloom.session import scratch_folder
from ragloom.sources import tables
from ragloom.sources.tables import load

__all__ = ["ORACLES", "QUERIES"]  # the registry's, with the queries of this module


# --- stored rows ------------------------------------------------------------------------------
#: Chunks as they are stored: children of fixed size, parents of five each.
STORED = f"""{CHUNKS}, stored AS (
  SELECT doc_id, 'child' AS chunk_type, printf('%s_p%04d_c%03d', doc_id::VARCHAR, no // 5, no % 5) AS id, printf('%s_p%04d', doc_id::VARCHAR, no // 5) AS parent_id, no * 2 + 1 AS order_index, content,
         CASE WHEN no % 2 = 0 THEN '' ELSE 'Top > ' || substr(content, 1, 10) END AS section_path FROM chunks
  UNION ALL
  SELECT doc_id, 'parent', printf('%s_p%04d', doc_id::VARCHAR, no // 5), NULL, min(no) * 2, string_agg(content, '' ORDER BY no), '' FROM chunks WHERE no // 5 <> 1 GROUP BY doc_id, no // 5)"""


def _stored(s, d):
    """Every second parent of a document is missing from the second on, so that lookups fail too."""
    rows = chunking.fixed_chunks(load(s, d, "documents")).select("doc_id", "no", "content").withColumn("p", F.floor(F.col("no") / 5).cast("int"))
    parent = chunking.parent_chunk_id(F.col("doc_id"), F.col("p"))
    section = F.when(F.col("no") % 2 == 0, "").otherwise(F.concat(F.lit("Top > "), F.substring("content", 1, 10)))
    children = rows.select("doc_id", F.lit("child").alias("chunk_type"), chunking.chunk_id(F.col("doc_id"), F.col("p"), (F.col("no") % 5).cast("int")).alias("id"), parent.alias("parent_id"), (F.col("no") * 2 + 1).alias("order_index"), "content", section.alias("section_path"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "content"))), lambda x: x["content"]), "")
    parents = rows.where("p <> 1").groupBy("doc_id", "p").agg(whole.alias("content"), F.min("no").alias("no"))
    parents = parents.select("doc_id", F.lit("parent").alias("chunk_type"), parent.alias("id"), F.lit(None).cast("string").alias("parent_id"), (F.col("no") * 2).alias("order_index"), "content", F.lit("").alias("section_path"))
    return children.unionByName(parents)


@query(f"WITH {STORED} SELECT id, order_index FROM stored WHERE doc_id = 1 ORDER BY order_index, chunk_type, id LIMIT 7")
def stored_chunk_scan(s, d):
    return tables.stored_chunks(_stored(s, d), 1, 7, parents=True).select("id", "order_index")


@query(f"""WITH {STORED}, p AS (SELECT id AS pid, length(content) AS n FROM stored WHERE chunk_type = 'parent')
SELECT id, coalesce(n, 0) AS parent_char_count, NOT (section_path = '' OR starts_with(ltrim(content), string_split(section_path, ' > ')[-1])) AS embedding_differs FROM stored LEFT JOIN p ON parent_id = pid""")
def stored_chunk_view(s, d):
    return chunking.stored_view(_stored(s, d)).select("id", "parent_char_count", "embedding_differs")


@query(f"WITH {STORED} SELECT id FROM stored WHERE doc_id IN (1, 3, 5) AND chunk_type = 'child'")
def search_corpus(s, d):
    rows = _stored(s, d).withColumn("user_id", F.lit("u"))
    return rows.where(retrieval.search_filter("u", [1, 3, 5], ["child"])).select("id")


@query("SELECT label AS doc_id, vec_id AS id FROM embeddings WHERE label IN (1, 3) ORDER BY 1, 2")
def vectors_by_document(s, d):
    return tables.vectors_of(load(s, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("id")), [1, 3])


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_lookup(s, d):
    rows = load(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return tables.lookup(rows, load(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id, md5('new ' || lang) AS h FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id % 3 <> 0")
def replace_by_document(s, d):
    docs = load(s, d, "documents")
    new = docs.where("doc_id % 3 = 0").select("doc_id", F.md5(F.concat(F.lit("new "), "lang")).alias("h"))
    return tables.replace_documents(docs.select("doc_id", F.md5("text").alias("h")), new)


@query("""SELECT doc_id, doc_id % 2 = 0 AND starts_with(text, 'T') AND strlen(text) BETWEEN 1 AND 3000 AS valid FROM documents""")
def upload_check(s, d):
    """Texts as uploads: those of even ids are named .PDF, and a leading T is made the magic number."""
    rows = load(s, d, "documents").select("doc_id", F.concat(F.lit("/in/a.b."), F.when(F.col("doc_id") % 2 == 0, "PDF").otherwise("txt")).alias("path"), F.octet_length("text").alias("length"), F.regexp_replace("text", "^T", "%PDF").cast("binary").alias("content"))
    return rows.select("doc_id", (tables.is_pdf(F.col("path"), F.col("content")) & F.col("length").between(1, 3000)).alias("valid"))


@query("""WITH w AS (SELECT doc_id, i, ['pump','valve','motor','sensor','filter','panel','cable','switch','board','frame','wheel','shaft','gear','pipe','tank','lamp'][('0x' || substr(md5('7:' || doc_id || ':' || i), 1, 1))::INT + 1] AS w
  FROM (SELECT unnest(range(500)) AS doc_id), (SELECT unnest(range(1, 41)) AS i)) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM w GROUP BY doc_id""")
def synthetic_documents(s, d):
    return tables.synthetic_documents(s, 500, 7)


@query("""SELECT doc_id, md5(array_to_string(list_sort(list_transform(list_filter([['lang', lang], ['source', CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END], ['size', CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR END]], lambda x: x[2] IS NOT NULL AND trim(x[2]) <> ''), lambda x: x[1] || '=' || x[2])), ',')) AS kept FROM documents""")
def metadata_clean(s, d):
    told = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source")), F.lit("size"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")))
    kept = F.transform(F.map_entries(tables.strip_nulls(told)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return load(s, d, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(kept), ",")).alias("kept"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '400' ELSE '300' END AS child_size, CASE WHEN doc_id % 5 = 0 THEN '0' ELSE '50' END AS overlap FROM documents")
def merged_parameters(s, d):
    """A null keeps the default, and 0 is a value."""
    i = F.col("doc_id")
    given = F.create_map(F.lit("child_size"), F.when(i % 3 == 0, "400"), F.lit("overlap"), F.when(i % 5 == 0, "0"))
    whole = tables.merged_options(F.create_map(F.lit("child_size"), F.lit("300"), F.lit("overlap"), F.lit("50")), given)
    return load(s, d, "documents").select("doc_id", whole.alias("m")).select("doc_id", F.col("m.child_size").alias("child_size"), F.col("m.overlap").alias("overlap"))


# --- layout -----------------------------------------------------------------------------------
@query(f"""WITH {BLOCKS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, seq) AS up, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0 DESC, seq DESC) AS down, lower(regexp_replace(trim(text), '[0-9]+', '#', 'g')) AS norm FROM blocks),
p AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM blocks GROUP BY doc_id HAVING count(DISTINCT page_no) >= 3),
k AS (SELECT doc_id, norm, count(DISTINCT page_no) AS pages FROM r WHERE up <= 3 OR down <= 3 GROUP BY ALL),
h AS (SELECT doc_id, norm FROM k JOIN p USING (doc_id) WHERE length(norm) BETWEEN 1 AND 80 AND pages >= greatest(2, floor(n * 0.5)))
SELECT r.doc_id, r.seq FROM r ANTI JOIN h ON r.doc_id = h.doc_id AND r.norm = h.norm""")
def headers_dropped(s, d):
    return layout.drop_running_headers(_blocks(s, d)).select("doc_id", "seq")


# --- retrieval and answers ----------------------------------------------------------------------
@query(f"WITH {FUSED} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM rrf QUALIFY place <= 5")
def rank_by_score(s, d):
    return retrieval.by_score(_rrf(s, d), 5).select("query_id", "id", "score", "place")


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM bm")
def bm25_stored_index(s, d):
    """As ``bm25_topk``, by an index that gets the documents in two parts."""
    index = LexicalIndex(s, scratch_folder(s, "lexical-index"))
    index.add(_corpus(s, d).where("id % 2 = 0"))
    index.add(_corpus(s, d).where("id % 2 <> 0"))
    return index.search(_queries(s, d)).select("query_id", "id", "score", "rank")


@query(f"WITH {BM25.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE doc_id % 7 <> 3)')} SELECT query_id, id, score, rank FROM bm")
def bm25_blockmax(s, d):
    """Documents come in five parts, of which four are merged; a seventh of all are deleted before and after that."""
    docs = _corpus(s, d)
    index = LexicalIndex(s, scratch_folder(s, "lexical-index"), block_docs=64)
    for part in range(5):
        index.add(docs.where(F.col("id") % 5 == part))
        if part == 2:
            index.delete(docs.where("id % 7 = 3 and id % 5 < 3").select("id"))
    index.delete(docs.where("id % 7 = 3").select("id"))
    return index.search(_queries(s, d)).select("query_id", "id", "score", "rank")


def _retrieved(s, d, **options):
    docs = load(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("text").alias("content"))
    parents = docs.where("false").select(F.col("id").alias("parent_id"), "content")
    return retrieval.retrieve(docs.withColumn("parent_id", F.lit(None).cast("string")).withColumn("id", F.col("id").cast("string")), _queries(s, d), parents.select(F.col("parent_id").cast("string").alias("parent_id"), "content"), **options)


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'))"
#: The chain's ids are texts, and so is their order.
CHAIN = (
    FUSED.replace("doc_id AS id", "doc_id::VARCHAR AS id")
    + f""", pairs AS (
  SELECT query_id, id, rank, d.text AS content, {_WORDS.format("b.text")} AS asked, {_WORDS.format("d.text")} AS have
  FROM rrf JOIN documents d ON d.doc_id = id::BIGINT JOIN benchmark b ON b.item_id = query_id
), judged AS (
  SELECT query_id, id, rank, content, CASE WHEN len(list_distinct(list_concat(asked, have))) > 0 THEN round(len(list_intersect(asked, have)) / len(list_distinct(list_concat(asked, have))), 6) END AS score FROM pairs
), chosen AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, rank) AS place FROM judged QUALIFY place <= 5
), good AS (
  SELECT query_id FROM chosen GROUP BY query_id HAVING max(coalesce(score, 0.0)) >= 0.05
)"""
)


@query(f"""WITH {CHAIN}, told AS (SELECT c.*, regexp_replace(content, '\\s+', ' ', 'g') AS one FROM chosen c JOIN good USING (query_id))
SELECT query_id, place AS "index", id, coalesce(score, 0.0) AS score, CASE WHEN length(one) > 120 THEN substr(one, 1, 120) || '…' ELSE one END AS snippet FROM told""")
def retrieve_chain(s, d):
    contexts, _ = _retrieved(s, d, min_score=0.05)
    return contexts.select("query_id", "index", "id", "score", "snippet")


def _answers(s, d):
    contexts, outcomes = _retrieved(s, d, min_score=0.05)
    return retrieval.answer(_queries(s, d), contexts, outcomes)


@query(f"""WITH {CHAIN}, told AS (
  SELECT query_id, place AS i, id, content, score, regexp_replace(content, '\\s+', ' ', 'g') AS one,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, place) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM chosen JOIN good USING (query_id)
), blocks AS (
  SELECT query_id, string_agg('[' || i || '] 来源: ' || id || ' 第 1 页' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10)
         ORDER BY CASE WHEN n <= 2 THEN i WHEN r = 1 THEN 1 WHEN r = 2 THEN n ELSE r - 1 END) AS block FROM told GROUP BY query_id
), top AS (
  SELECT query_id, id, CASE WHEN length(one) > 120 THEN substr(one, 1, 120) || '…' ELSE one END AS snippet FROM told WHERE i = 1
), best AS (SELECT query_id, count(*) AS n FROM chosen GROUP BY query_id)
SELECT item_id AS query_id, text AS question,
       '【参考资料】' || chr(10) || coalesce(block, '（无参考资料）') || chr(10) || chr(10) || '【用户问题】' || chr(10) || text || chr(10) || chr(10) || '请依据上述参考资料回答，并在每个论断后标注来源编号。' AS prompt,
       regexp_replace(snippet || ' [1]', '^\\s+|\\s+$', '', 'g') AS answer, CASE WHEN snippet IS NOT NULL THEN '1:' || id END AS citations, snippet IS NULL AS refused,
       CASE WHEN snippet IS NOT NULL THEN '' WHEN n IS NULL THEN 'no_hits' ELSE 'low_score' END AS reason
FROM benchmark LEFT JOIN blocks ON blocks.query_id = item_id LEFT JOIN top ON top.query_id = item_id LEFT JOIN best ON best.query_id = item_id""")
def answers(s, d):
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["index"].cast("string"), c["id"])), ",")
    return _answers(s, d).withColumn("citations", cited)


@query()
def answer_events(s, d):
    return retrieval.answer_events(_answers(s, d))


@query(f"""WITH {BM25}, t AS (SELECT query_id, rank, score, source, text, count(*) OVER (PARTITION BY query_id) AS n FROM bm JOIN documents ON doc_id = id WHERE rank <= 4),
p AS (SELECT query_id, CASE WHEN n <= 2 OR rank = 1 THEN rank WHEN rank = 2 THEN n ELSE rank - 1 END AS place, '[' || rank || '] 来源: ' || source || ' 第 ' || rank || CASE WHEN rank % 2 = 0 THEN '-' || (rank + 1) ELSE '' END || ' 页' || CASE WHEN rank % 3 = 0 THEN ' | 章节: S' ELSE '' END || chr(10) || text AS part FROM t)
SELECT query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context_block FROM p GROUP BY query_id""")
def context_block(s, d):
    rows = _bm25(s, d).where("rank <= 4").join(load(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("text").alias("content")), "id")
    rows = rows.withColumns({"page_start": F.col("rank"), "page_end": F.col("rank") + F.when(F.col("rank") % 2 == 0, 1).otherwise(0), "section_path": F.when(F.col("rank") % 3 == 0, "S").otherwise("")})
    return retrieval.context_block(rows.withColumnRenamed("rank", "index"))


@query("""WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
l AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS lines FROM h WHERE back <= 6 GROUP BY conv_id)
SELECT conv_id, md5('【最近的对话】' || chr(10) || lines || chr(10) || chr(10) || '【用户的新问题】' || chr(10) || 'why?' || chr(10) || chr(10) || '请输出改写后的、自包含的检索查询：') AS prompt_md5 FROM l""")
def rewrite_prompts(s, d):
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    rows = _messages(s, d).groupBy("conv_id").agg(history.alias("h"))
    return rows.select("conv_id", F.md5(retrieval.rewrite_prompt(F.lit("why?"), F.col("h"))).alias("prompt_md5"))


# --- evaluation ---------------------------------------------------------------------------------
@query("SELECT item_id, item_id % 4 = 3 AS no_answer FROM benchmark")
def no_answer_items(s, d):
    return _golden(s, d).select("item_id", evaluation.is_no_answer(F.col("category"), F.col("evidences")).alias("no_answer"))


@query(f"WITH {_SCORED} SELECT answerable, count(s) AS count, round(min(s), 3) AS min, round(max(s), 3) AS max, round(avg(s), 3) AS avg FROM sc GROUP BY answerable")
def score_summary(s, d):
    return evaluation.score_summary(_scored(s, d), "top_score", ["answerable"])


def _scored(s, d):
    return load(s, d, "labels").join(load(s, d, "documents"), "doc_id").select((F.col("toxic") == 0).alias("answerable"), F.round(F.col("n_chars") / 1000.0, 1).alias("top_score"))


@query(f"WITH {_SCORED} SELECT min(s) FILTER (WHERE answerable) AS low_answerable, max(s) FILTER (WHERE NOT answerable) AS high_no_answer, coalesce(max(s) FILTER (WHERE NOT answerable) < min(s) FILTER (WHERE answerable), false) AS separable FROM sc")
def separability(s, d):
    return evaluation.separability(_scored(s, d))


@query(f"""WITH {_SCORED}, t AS (SELECT DISTINCT s FROM sc), l AS (SELECT t.s AS threshold, (count(*) FILTER (WHERE answerable AND sc.s < t.s) + 2 * count(*) FILTER (WHERE NOT answerable AND sc.s >= t.s))::DOUBLE AS loss FROM t, sc GROUP BY t.s)
SELECT threshold, loss FROM l ORDER BY loss, threshold LIMIT 1""")
def best_threshold(s, d):
    return evaluation.best_threshold(evaluation.threshold_sweep(_scored(s, d)))


@query("SELECT event_type, round_even(sum(round(value, 2)), 2) AS cost_ms, count(*) AS n FROM events GROUP BY event_type")
def stage_cost(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.bround(F.sum(F.round("value", 2)), 2).alias("cost_ms"), F.count("*").alias("n"))


@query("""WITH j AS (SELECT event_type, event_id % 7 <> 0 AS graded, least(1.0, value / 100.0) AS f, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS c FROM events)
SELECT event_type, count(*) FILTER (WHERE graded) AS graded, round_even(avg(f) FILTER (WHERE graded), 4) AS faithfulness, round_even(avg(c) FILTER (WHERE graded), 4) AS correctness FROM j GROUP BY event_type""")
def generation_means(s, d):
    e = F.col("event_id")
    rows = load(s, d, "events").select("event_type", (e % 7 != 0).alias("graded"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("faithfulness"), F.when(e % 3 == 0, 0).otherwise(1).alias("correctness"))
    return evaluation.generation_means(rows, ["event_type"])


@query("""WITH o AS (SELECT doc_id AS item_id, text, 0 AS late FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text, 1 FROM documents WHERE doc_id % 5 <> 1),
f AS (SELECT item_id, late FROM (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS k FROM o) QUALIFY row_number() OVER (PARTITION BY k ORDER BY late, item_id) = 1)
SELECT item_id, printf('q%03d', row_number() OVER (ORDER BY late, item_id)) AS new_id FROM f""")
def golden_extend(s, d):
    rows = load(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("question"))
    return evaluation.extend_golden(rows.where("item_id % 2 = 0"), rows.where("item_id % 5 <> 1")).select("item_id", "new_id")


@query(f"""WITH {CHUNKS} SELECT printf('%s_p%04d_c%03d', doc_id::VARCHAR, 0, no) AS item_id, CASE WHEN no % 2 = 0 AND substr(content, 5, 20) <> '' THEN substr(content, 5, 20) ELSE substr(content, 1, 120) END AS evidence FROM chunks""")
def golden_generated(s, d):
    """Evidence that a model would name: every second one isn't in the chunk."""
    rows = chunking.fixed_chunks(load(s, d, "documents")).withColumn("id", chunking.chunk_id(F.col("doc_id"), F.lit(0), F.col("no")))
    named = F.when(F.col("no") % 2 == 0, F.substring("content", 5, 20)).otherwise(F.concat(F.substring("content", 1, 20), F.lit("\x00")))
    return evaluation.golden_items(rows, evidence=named).select("item_id", F.col("evidences")[0].alias("evidence"))


@query("""SELECT * FROM (VALUES ('chunk_fixed', 'fixed', 300, 50, NULL, NULL), ('chunk_recursive', 'recursive', 300, 50, NULL, NULL), ('chunk_parent_150', 'parent_child', 150, 30, NULL, NULL), ('chunk_parent_300', 'parent_child', 300, 50, NULL, NULL),
  ('chunk_parent_500', 'parent_child', 500, 80, NULL, NULL), ('pipeline_no_bm25', 'parent_child', 300, 50, 0, NULL), ('pipeline_no_rerank', 'parent_child', 300, 50, NULL, false)) AS t(name, strategy, child_size, overlap, bm25_top_k, rerank_enabled)""")
def presets(s, d):
    return evaluation.presets(s)


@query("SELECT rule, verdict, value::DOUBLE AS value FROM (VALUES ('single', 'vector_only', 0.12), ('fusion', 'hurts', -0.02), ('limit', 'ranking', 0.96), ('step deduped', 'even', -0.004), ('step reranked', 'moves', 0.054), ('step final_parents', 'even', 0.0)) AS t(rule, verdict, value)")
def chain_findings(s, d):
    rows = [("vector_only", 1.0, 0.93), ("bm25_only", 0.927, 0.81), ("rrf_fused", 0.95, 0.91), ("deduped", 0.97, 0.906), ("reranked", 0.97, 0.96), ("final_parents", 1.0, 0.96)]
    return evaluation.chain_findings(s.createDataFrame(rows, "stage string, recall double, mrr double"))


# --- catalog and conversations --------------------------------------------------------------------
def _catalog(s, d):
    m = F.col("doc_id") % 4
    return load(s, d, "documents").select("doc_id", F.col("source").alias("user_id"), F.when(m == 0, "READY").when(m == 1, "PARSING").when(m == 2, "FAILED").otherwise("DELETED").alias("status"))


_CATALOG = "cat AS (SELECT doc_id, source AS user_id, ['READY', 'PARSING', 'FAILED', 'DELETED'][doc_id % 4 + 1] AS status FROM documents)"


@query(f"WITH {_CATALOG}, u AS (SELECT min(user_id) AS u FROM cat) SELECT doc_id, 'all' AS scope FROM cat, u WHERE user_id = u AND status = 'READY' UNION ALL SELECT doc_id, 'listed' FROM cat, u WHERE user_id = u AND status = 'READY' AND doc_id IN (0, 1, 2, 4, 8, 16, 32, 64) UNION ALL SELECT doc_id, 'owned' FROM cat, u WHERE user_id = u AND status <> 'DELETED'")
def document_scopes(s, d):
    rows = _catalog(s, d)
    user = rows.agg(F.min("user_id")).first()[0]
    found = [("all", retrieval.ready_scope(rows, user, [])), ("listed", retrieval.ready_scope(rows, user, [0, 1, 2, 4, 8, 16, 32, 64])), ("owned", catalog.owned(rows, user))]
    parts = [t.select("doc_id", F.lit(name).alias("scope")) for name, t in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_CATALOG} SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND status <> 'READY' THEN 'EMBEDDING' WHEN doc_id % 5 = 1 THEN 'FAILED' ELSE status END AS status, CASE WHEN doc_id % 5 = 1 THEN 2000 ELSE 0 END AS error_chars FROM cat""")
def status_moves(s, d):
    """A step of ingest passes READY documents over; a failure doesn't, and cuts its message."""
    rows = _catalog(s, d).withColumn("error", F.lit(""))
    moved = catalog.move_status(rows, F.col("doc_id") % 5 == 0, "EMBEDDING")
    failed = catalog.move_status(moved, F.col("doc_id") % 5 == 1, "FAILED", F.repeat(F.lit("x"), 3000))
    return failed.select("doc_id", "status", F.char_length("error").alias("error_chars"))


@query(f"""WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id), v AS (SELECT label AS doc_id, count(*) AS v FROM embeddings GROUP BY label)
SELECT doc_id, coalesce(c, 0) AS chunks, coalesce(v, 0) AS vectors FROM (SELECT unnest([1, 3, 5, 100000000]) AS doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN v USING (doc_id)""")
def delete_report(s, d):
    gone = s.createDataFrame([(i,) for i in (1, 3, 5, 5, 100_000_000)], "doc_id long")
    vectors = load(s, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"))
    return catalog.delete_documents(_catalog(s, d), chunking.fixed_chunks(load(s, d, "documents")), vectors, gone)[3]


@query(f"""WITH {_CATALOG} SELECT 'labels' AS store, doc_id, count(*) AS rows FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM cat WHERE status = 'READY') GROUP BY doc_id
UNION ALL SELECT 'vectors', label, count(*) FROM embeddings WHERE label NOT IN (SELECT doc_id FROM cat WHERE status = 'READY') GROUP BY label""")
def orphan_report(s, d):
    stores = {"labels": load(s, d, "labels").select("doc_id"), "vectors": load(s, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"))}
    return catalog.orphan_report(stores, _catalog(s, d).where("status = 'READY'"))


def _conversations(s, d):
    c = F.col("conv_id")
    rows = load(s, d, "conversations").select("conv_id").distinct()
    title = F.when(c % 3 == 0, T.EMPTY_TITLE).otherwise(F.concat(F.lit("Title "), c.cast("string")))
    return rows.select("conv_id", F.when(c % 2 == 0, "a").otherwise("b").alias("user_id"), title.alias("title"), (c % 7 == 0).alias("deleted"), (c % 100).alias("updated_at"))


_CONVS = f"conv AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS user_id, CASE WHEN conv_id % 3 = 0 THEN '{T.EMPTY_TITLE}' ELSE 'Title ' || conv_id END AS title, conv_id % 7 = 0 AS deleted, conv_id % 100 AS updated_at FROM (SELECT DISTINCT conv_id FROM conversations))"


@query(f"WITH {_CONVS} SELECT conv_id, title FROM conv WHERE user_id = 'a' AND NOT deleted AND title ILIKE '%e 1%' ORDER BY updated_at DESC, conv_id LIMIT 20")
def conversation_page(s, d):
    return catalog.listed_conversations(_conversations(s, d), "a", "e 1").select("conv_id", "title").limit(20)


@query(f"WITH {_CONVS} SELECT conv_id, title, count(*) AS n FROM conversations JOIN conv USING (conv_id) WHERE NOT deleted GROUP BY ALL")
def message_counts(s, d):
    return catalog.message_counts(_messages(s, d), _conversations(s, d).where("not deleted"))


@query(f"""WITH {_CONVS}, ch AS (SELECT conv_id, CASE WHEN conv_id % 8 = 1 THEN 'z' ELSE user_id END AS by_user, conv_id % 4 AS k FROM conv)
SELECT conv_id, user_id, CASE WHEN k = 0 AND by_user = user_id THEN 'renamed' ELSE title END AS title, deleted OR (k = 1 AND by_user = user_id) AS deleted, CASE WHEN k < 2 AND by_user = user_id THEN greatest(updated_at, 50) ELSE updated_at END AS updated_at FROM conv JOIN ch USING (conv_id)
UNION ALL SELECT -5, 'n', 'fresh', false, 3""")
def conversation_changes(s, d):
    """Renames and deletions, some by someone else, and a new conversation."""
    rows, c = _conversations(s, d), F.col("conv_id")
    by = F.when(c % 8 == 1, "z").otherwise(F.col("user_id"))
    changes = rows.where("conv_id % 4 < 2").select("conv_id", by.alias("user_id"), F.when(c % 4 == 0, "rename").otherwise("delete").alias("action"), F.when(c % 4 == 0, "renamed").alias("title"), F.lit(50).cast("long").alias("at"))
    new = s.createDataFrame([(-5, "n", "create", "fresh", 3)], "conv_id long, user_id string, action string, title string, at long")
    return catalog.apply_conversation(rows, changes.unionByName(new))


@query(f"""WITH {_CONVS}, m AS (SELECT conv_id, count(*) AS n, max(turn) AS last, trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '[ \\t\\r\\n]+', ' ', 'g')) AS one FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN title = '{T.EMPTY_TITLE}' AND one IS NOT NULL THEN CASE WHEN one = '' THEN '{T.EMPTY_TITLE}' WHEN length(one) > 40 THEN substr(one, 1, 40) || '…' ELSE one END ELSE title END AS title, n AS message_count, greatest(updated_at, last) AS updated_at FROM conv JOIN m USING (conv_id)""")
def appended_messages(s, d):
    rows = catalog.append_messages(_conversations(s, d), _messages(s, d).withColumn("at", F.col("turn").cast("long")), T.EMPTY_TITLE)
    return rows.select("conv_id", "title", "message_count", "updated_at")


@query("SELECT conv_id, unnest([10, 11]) AS turn, unnest(['user', 'assistant']) AS role, unnest(['q', CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE '' END]) AS text, unnest([NULL, CASE WHEN conv_id % 2 = 1 THEN 'broken' END]) AS error FROM (SELECT DISTINCT conv_id FROM conversations)")
def turn_rows(s, d):
    c = F.col("conv_id") % 2
    rows = load(s, d, "conversations").select("conv_id").distinct().select("conv_id", F.lit("q").alias("question"), F.when(c == 0, "a").alias("answer"), F.when(c == 1, "broken").alias("error"))
    return catalog.turn_rows(rows, 10)


# --- interviews and skills ------------------------------------------------------------------------
@query("SELECT user_id, array_to_string(CASE WHEN user_id % 4 = 3 THEN ['s1'] WHEN user_id % 4 = 1 THEN ['s2', 's1'] WHEN user_id % 4 = 0 THEN [] END, ',') AS skills, CASE WHEN user_id % 4 = 2 THEN CASE WHEN user_id % 8 = 2 THEN 'too many skills' ELSE 'unknown skill' END END AS error FROM (SELECT DISTINCT user_id FROM events)")
def skill_requests(s, d):
    """None, two in order, one that comes twice, three with a repeat, and one that isn't known."""
    u = F.col("user_id")
    ids = F.when(u % 4 == 0, F.array().cast("array<string>")).when(u % 4 == 1, F.array(F.lit("s2"), F.lit("s1"))).when(u % 8 == 2, F.array(F.lit("s1"), F.lit("s2"), F.lit("s1"))).when(u % 8 == 6, F.array(F.lit("s1"), F.lit("s9"))).otherwise(F.array(F.lit("s1"), F.lit("s1")))
    asked = load(s, d, "events").select("user_id").distinct().select(u.alias("request_id"), ids.alias("skill_ids"))
    found = catalog.resolve_skills(asked, _skills(s))
    return found.select(F.col("request_id").alias("user_id"), F.array_join("skills", ",").alias("skills"), "error")


def _skills(s):
    return s.createDataFrame([("s1", "First", 3, 20, False, True, "body one"), ("s2", "Second", 2, 30, True, False, "body two")], "id string, name string, max_follow_up int, max_turns int, require_evidence boolean, allow_finish boolean, body string")


@query("SELECT * FROM (VALUES (1, '【首要面试风格】' || chr(10) || 'body two' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '【补充视角 1】' || chr(10) || 'body one', 2, 20, true, false), (2, 'default', 3, 20, false, true)) AS t(request_id, prompt, max_follow_up, max_turns, require_evidence, allow_finish)")
def skill_composition(s, d):
    asked = s.createDataFrame([(1, ["s2", "s1"]), (2, []), (3, ["s9"])], "request_id int, skill_ids array<string>")
    return catalog.compose_skills(catalog.resolve_skills(asked, _skills(s)), _skills(s), "default")


@query("SELECT event_id, array_to_string(list_filter([CASE event_id % 4 WHEN 0 THEN '偏浅' WHEN 1 THEN '中等' WHEN 2 THEN '有深度' END, CASE WHEN event_id % 2 = 0 THEN '有具体数据' END, CASE WHEN event_id % 3 = 0 THEN '讲到了取舍' END, CASE WHEN event_id % 5 = 0 THEN '有模糊表述(可能、大概)' END], lambda x: x IS NOT NULL), ' · ') AS hint FROM events")
def evaluation_hints(s, d):
    e = F.col("event_id")
    depth = F.when(e % 4 == 0, "shallow").when(e % 4 == 1, "medium").when(e % 4 == 2, "deep").otherwise("other")
    vague = F.when(e % 5 == 0, F.array(F.lit("可能"), F.lit("大概"))).otherwise(F.array().cast("array<string>"))
    return load(s, d, "events").select("event_id", interview.evaluation_hint(depth, e % 2 == 0, e % 3 == 0, vague).alias("hint"))


@query(f"""WITH {STORED}, n AS (SELECT *, count(*) FILTER (WHERE chunk_type = 'parent' AND doc_id % 2 = 0) OVER (PARTITION BY doc_id) AS p FROM stored WHERE chunk_type = 'child' OR doc_id % 2 = 0)
SELECT doc_id, md5(substr(string_agg(content, chr(10) || chr(10) ORDER BY order_index), 1, 20000)) AS text_md5 FROM n WHERE (p = 0 OR chunk_type = 'parent') AND trim(content) <> '' GROUP BY doc_id""")
def rebuilt_texts(s, d):
    """Documents of odd ids have no parents."""
    rows = _stored(s, d).where("chunk_type = 'child' or doc_id % 2 = 0")
    return interview.rebuilt_texts(rows).select("doc_id", F.md5("text").alias("text_md5"))


# --- scalar functions -----------------------------------------------------------------------------
@query("SELECT conv_id, turn, trim(text) AS cleaned FROM conversations WHERE role = 'user'")
def question_cleaning(s, d):
    """Quotes and what leads up to a question, in up to three layers."""
    c = F.col("conv_id") % 3
    told = F.concat(F.when(c == 0, '"好的，了解了。那么 ').when(c == 1, "  请问：").otherwise(""), "text", F.when(c == 0, '"').otherwise(" "))
    return _messages(s, d).where("role = 'user'").select("conv_id", "turn", T.clean_question(told).alias("cleaned"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 THEN text ELSE trim(trim(trim(text), '\"“”''')) END AS cleaned FROM conversations WHERE role = 'user'")
def rewrite_cleaning(s, d):
    c = F.col("conv_id") % 3
    told = F.when(c == 0, F.concat(F.lit("“改写后： "), "text", F.lit("”"))).when(c == 1, F.col("text")).otherwise("  \"\" ")
    return _messages(s, d).where("role = 'user'").select("conv_id", "turn", T.clean_rewrite(told, F.col("text")).alias("cleaned"))


_CUT = "CASE WHEN contains(h, '{0}') AND length(h) - strpos(reverse(h), '{0}') >= 48 THEN substr(h, 1, length(h) - strpos(reverse(h), '{0}') + 1) END"


@query("WITH h AS (SELECT conv_id, turn, text, substr(text, 1, 120) AS h FROM conversations) SELECT conv_id, turn, CASE WHEN length(text) <= 120 THEN text ELSE coalesce(" + ", ".join(_CUT.format(c) for c in "。！？；.!?") + ", " + _CUT.format("X").replace("'X'", "chr(10)") + ", h) END AS cut FROM h")
def sentence_cut(s, d):
    return _messages(s, d).select("conv_id", "turn", T.cut_at_sentence(F.col("text"), 120).alias("cut"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'db://u' || doc_id || ':***@host' || doc_id || '/x' WHEN doc_id % 3 = 1 THEN 'db://u:***@h' ELSE 'sqlite:///file.db' END AS masked FROM documents")
def dsn_masking(s, d):
    i = F.col("doc_id").cast("string")
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("db://u"), i, F.lit(":p@ss:w"), i, F.lit("@host"), i, F.lit("/x"))).when(F.col("doc_id") % 3 == 1, "db://u@h").otherwise("sqlite:///file.db")
    return load(s, d, "documents").select("doc_id", T.mask_dsn(url).alias("masked"))


@query("SELECT doc_id, printf('%s_p%04d_c%03d', doc_id::VARCHAR, doc_id % 12, doc_id % 1500) AS id, printf('%s_p%04d', doc_id::VARCHAR, doc_id % 12) AS parent_id FROM documents")
def chunk_ids(s, d):
    i = F.col("doc_id")
    return load(s, d, "documents").select("doc_id", chunking.chunk_id(i, (i % 12).cast("int"), (i % 1500).cast("int")).alias("id"), chunking.parent_chunk_id(i, (i % 12).cast("int")).alias("parent_id"))
