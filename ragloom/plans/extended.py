"""More queries of the engine's own operators: sweeps, states, stored rows and chunk reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import chunking, evaluation, interview, retrieval
from ragloom.plans.registry import BM25, CHUNKS, ORACLES, POSTINGS, QUERIES, RANKS, TOKENS, _bm25, _corpus, _eval_tables, _messages, _queries, query
from ragloom.sources.tables import load, upsert

__all__ = ["ORACLES", "QUERIES"]  # the registry's, with the queries of this module

SWEPT = "swept AS (SELECT k AS top_k, count(*) AS questions, round(avg(coalesce((hit_rank <= k)::INT, 0)), 6) AS recall, round(avg(CASE WHEN hit_rank <= k THEN 1.0::DOUBLE / hit_rank ELSE 0 END), 6) AS mrr FROM ranks, (SELECT unnest([1, 3, 5, 10, 20]) AS k) GROUP BY k)"


# --- evaluation -----------------------------------------------------------------------------
@query(f"WITH {BM25}, {RANKS}, {SWEPT} SELECT * FROM swept")
def config_sweep(s, d):
    return evaluation.sweep_depths(evaluation.evidence_ranks(*_eval_tables(s, d), whole=True), (1, 3, 5, 10, 20))


@query(f"WITH {BM25}, {RANKS}, {SWEPT}, p AS (SELECT *, row_number() OVER (ORDER BY mrr DESC, top_k) AS up, row_number() OVER (ORDER BY mrr, top_k) AS down FROM swept) SELECT max(top_k) FILTER (WHERE up = 1) AS best, max(mrr) AS best_mrr, max(top_k) FILTER (WHERE down = 1) AS worst, min(mrr) AS worst_mrr FROM p")
def sweep_findings(s, d):
    return evaluation.findings(config_sweep(s, d), "top_k", "mrr")


@query()
def evidence_ratio(s, d):
    evidences, retrieved = _eval_tables(s, d)
    pairs = evidences.join(retrieved, "item_id")
    return pairs.select("item_id", "rank", F.round(evaluation.match_ratio(F.col("content"), F.col("evidence")), 6).alias("ratio"))


# --- retrieval ------------------------------------------------------------------------------
@query(f"WITH {POSTINGS} SELECT id, round(ln(sum(tf)::DOUBLE) - sum(tf * ln(tf::DOUBLE)) / sum(tf)::DOUBLE, 6) + 0.0::DOUBLE AS entropy FROM posted GROUP BY id")
def token_entropy(s, d):
    return retrieval.token_entropy(retrieval.postings(_corpus(s, d)))


@query(f"WITH {POSTINGS} SELECT count(*) AS n, round(avg(dl), 4) AS avg_tokens FROM sizes")
def average_tokens(s, d):
    sizes = _corpus(s, d).select(F.size(retrieval.tokens(F.col("content"))).alias("dl"))
    return sizes.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 4).alias("avg_tokens"))


@query(f"""WITH {BM25}, c AS (SELECT bm.query_id, bm.id, bm.rank, list_distinct({TOKENS.format("d.text")}) AS have, list_distinct({TOKENS.format("b.text")}) AS want FROM bm JOIN documents d ON d.doc_id = bm.id JOIN benchmark b ON b.item_id = bm.query_id),
x AS (SELECT query_id, id, rank, round(len(list_intersect(want, have)) / len(list_distinct(list_concat(want, have)))::DOUBLE, 6) AS score FROM c)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM x QUALIFY place <= 5""")
def rerank_lexical(s, d):
    rows = _bm25(s, d).select("query_id", "id", "rank").join(_corpus(s, d), "id").join(_queries(s, d), "query_id")
    return retrieval.rerank(rows, F.col("question"), F.col("content"), 5).select("query_id", "id", "score", "place")


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS vectors FROM embeddings GROUP BY label")
def vector_count(s, d):
    return load(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("vectors"))


@query("SELECT vec_id, CASE WHEN label = 1 THEN 9 ELSE label END::BIGINT AS label FROM embeddings")
def vector_upsert(s, d):
    rows = load(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return upsert(rows, rows.where("label = 1").withColumn("label", F.lit(9).cast("long")), ["vec_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_listed(s, d):
    return load(s, d, "documents").select("doc_id").join(load(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


# --- chunks ---------------------------------------------------------------------------------
@query(f"WITH {CHUNKS} SELECT doc_id, no, CASE WHEN no = 0 THEN s ELSE least(s, greatest(no, s - least(50, floor(min(e - s) OVER (PARTITION BY doc_id) * 0.5)::BIGINT))) END AS start, e AS \"end\" FROM chunks")
def chunk_overlap(s, d):
    return chunking.overlap_spans(chunking.fixed_chunks(load(s, d, "documents")).select("doc_id", "no", "start", "end"), 50)


@query(f"WITH {CHUNKS} SELECT doc_id, no, content, count(*) OVER (PARTITION BY doc_id) > 5 AS truncated FROM chunks QUALIFY no < 5")
def chunk_preview(s, d):
    return chunking.preview(chunking.fixed_chunks(load(s, d, "documents")), 5).select("doc_id", "no", "content", "truncated")


@query(f"WITH {CHUNKS} SELECT doc_id, CASE WHEN max(e) < 200 THEN 'too short' WHEN avg(length(content)) < 80 THEN 'small chunks' WHEN avg(length(content)) > 600 THEN 'large chunks' ELSE 'fine' END AS alarm FROM chunks GROUP BY doc_id")
def chunk_alarms(s, d):
    return chunking.alarms(chunking.fixed_chunks(load(s, d, "documents")))


# --- conversations, catalog, text -------------------------------------------------------------
@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN length(text) < 60 THEN 0 ELSE 1 END AS opens FROM conversations),
t AS (SELECT conv_id, turn, sum(opens) OVER w::BIGINT AS topic, count(*) OVER w >= 20 AS finished FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, topic, finished, row_number() OVER (PARTITION BY conv_id, topic ORDER BY turn) - (topic > 0)::INT AS depth FROM t""".replace("sum(opens) OVER w::BIGINT", "(sum(opens) OVER w)::BIGINT"))
def interview_state(s, d):
    acted = _messages(s, d).withColumn("action", F.when(F.char_length("text") < 60, "FOLLOW_UP").otherwise("NEXT_TOPIC"))
    return interview.states(acted, "conv_id", "turn").select("conv_id", "turn", "topic", "finished", "depth")


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id")
def interview_transcript(s, d):
    return interview.transcript(_messages(s, d), "conv_id", "turn", F.col("role"), F.col("text"))


@query("SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(s, d):
    return _messages(s, d).groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"))


@query("SELECT user_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(s, d):
    return load(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("SELECT doc_id, CASE WHEN length(source) <= 4 THEN '****' ELSE '****' || right(source, 4) END AS hint FROM documents")
def masked_source(s, d):
    return load(s, d, "documents").select("doc_id", T.mask_secret(F.col("source")).alias("hint"))


@query("SELECT page_id, len(regexp_extract_all(html, '[{][A-Za-z_][A-Za-z0-9_]*[}]'))::BIGINT AS n FROM pages")
def placeholder_scan(s, d):
    return load(s, d, "pages").select("page_id", F.size(T.placeholders(F.col("html"))).cast("long").alias("n"))


@query("""SELECT conv_id, turn, regexp_replace(CASE WHEN turn BETWEEN 1 AND 3 THEN text || ' [' || turn || ']'
  ELSE regexp_replace(regexp_replace(text || ' ', '\\s{2,}', ' ', 'g'), '\\s+([，。；：,.!?;])', '\\1', 'g') END, '^\\s+|\\s+$', '', 'g') AS text FROM conversations""")
def citation_strip(s, d):
    cited = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))
    return _messages(s, d).select("conv_id", "turn", T.strip_citations(cited, F.lit(3)).alias("text"))
