"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, embeddings, licenses, lines, packing, phrases, scoring, secrets, simhash, substrings, toxicity
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.chat_digest(rows.unionByName(more))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.round("toxicity.low_quality", 6).alias("p_low_quality"),
        F.round("toxicity.toxic", 6).alias("p_toxic"),
        F.col("toxicity.rejected").alias("toxic"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", substrings.kept_digest(F.col("kept")).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def queries() -> dict:
    found = [op1_chat_format, op2_best_fit_packing, op3_simhash_dedup, op4_embedding_dedup, op5_toxicity]
    found += [op6_license_scan, op7_substring_dedup, op8_line_dedup, op9_secret_scan, op10_decontamination, op11_lm_scoring, op12_filter_audit, op13_phrase_mining]
    return {f.__name__: f for f in found}



#: What RE2 needs for the rules of ``secrets``: kind, pattern, the group that is measured, its least length.
#: Classes spell out both cases, as RE2 would fold signs beyond ASCII to them.
_EITHER_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_SECRETS = [
    ("assign", rf"""({_EITHER_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]


def _secret_pieces() -> str:
    """A select for each kind: its matches, what is measured of them, and the text between them."""
    quoted = [(no, kind, pattern.replace("'", "''"), group, least) for no, (kind, pattern, group, least) in enumerate(_SECRETS)]
    return " UNION ALL ".join(
        f"SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}') AS hit,"
        f" regexp_extract_all(t, '{pattern}', {group}) AS own, string_split_regex(t, '{pattern}') AS gap FROM said"
        for no, kind, pattern, group, least in quoted
    )


#: A-Z lower-cased and nothing else.
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<|im_start|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_sep|>')
             + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS formatted_chars
  FROM said GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM whole
""",
    "op4_embedding_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links,
       (SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id) AS component_id,
       (SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id) = e.vec_id AS kept
FROM embeddings e
""",
    "op7_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM words WHERE len(w) >= 35
), hashed AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM starts
), many AS (
  SELECT h FROM hashed GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS p
  FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM hashed JOIN many USING (h)) GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(p), 0) AS removed,
         CASE WHEN p IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i))), lambda i: w[i]) END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, LOWERED AS k FROM lines
), many AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE doc_id < last)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM keyed LEFT JOIN many USING (k) GROUP BY doc_id
""".replace("LOWERED", _ASCII_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")),
    "op12_filter_audit": r"""
WITH RECURSIVE told AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), masked AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m FROM told
), lab AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM masked LEFT JOIN lab USING (doc_id) GROUP BY ALL
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, (SELECT unnest(string_split('ABCDE', '')) AS x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, step, 1 << (ascii(o[step]) - 65) AS own,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))) AS prior
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5)
), facts AS (
  SELECT part, o, step, own, m, n, good, bad, (m & own) <> 0 AS fails, (m & coalesce(prior, 0)::BIGINT) <> 0 AS gone FROM steps, cells
), walked AS (
  SELECT part, o AS filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE m = own), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost,
         coalesce(sum(bad) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
  FROM facts GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM walked
""",
    "op13_phrase_mining": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(LOWERED, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\t]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, a, c.w, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score, j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 :], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL
), kept AS (
  SELECT b.lang, b.phrase, a, l, r, score FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
""".replace("LOWERED", _ASCII_LOWER.format("coalesce(text, '')")),
    "op9_secret_scan": """
WITH said AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), pieces AS (
  PIECES
), each AS (
  SELECT doc_id, kind_no, kind, least, unnest(hit) AS hit, unnest(own) AS own, unnest(gap[1 : len(hit)]) AS gap, unnest(range(len(hit))) AS i
  FROM pieces WHERE len(hit) > 0
), placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS stop FROM each
), found AS (
  SELECT doc_id, kind_no, kind, stop - length(hit) AS start, kind || ':' || (stop - length(hit))::BIGINT || ':' || stop::BIGINT AS told
  FROM placed WHERE length(own) >= least
)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (WHERE kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (WHERE kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(told, ',' ORDER BY start, kind_no) FILTER (WHERE kind_no < 3), '')) AS base_sha256,
       coalesce(string_agg(told, ',' ORDER BY start, kind_no), '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
""".replace("PIECES", _secret_pieces()),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
