"""Catalog operators: listing, history, statistics, upserts, soft deletes, orphans, skills."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import STATUS_PROGRESS


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_progress(rows: DataFrame) -> DataFrame:
    steps = F.create_map(*[F.lit(x) for kv in STATUS_PROGRESS.items() for x in kv])
    return rows.withColumn("progress", F.coalesce(steps[F.col("status")], F.lit(0)))


def last_messages(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` user and assistant messages of each conversation; blank ones and, where there is a column
    ``error``, those with an error don't count."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = messages.where("role in ('user', 'assistant') and trim(text) <> ''")
    if "error" in messages.columns:
        said = said.where(F.coalesce("error", F.lit("")) == "")
    return said.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def conversation_stats(messages: DataFrame, refusal: str = "^No ") -> DataFrame:
    refused = F.count_if((F.col("role") == "assistant") & F.col("text").rlike(refusal))
    return messages.agg(
        F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("messages"), refused.alias("refused"),
        F.bround(F.coalesce(F.try_divide(refused, F.count("*")), F.lit(0.0)), 3).alias("refused_rate"),
    )


def plan_uploads(uploads: DataFrame, catalog: DataFrame) -> DataFrame:
    """What each upload (user_id, file_md5) does: insert, revive, retry or reuse."""
    rows = uploads.join(catalog.select("user_id", "file_md5", "status").dropDuplicates(["user_id", "file_md5"]), ["user_id", "file_md5"], "left")
    action = F.when(F.col("status").isNull(), "insert").when(F.col("status") == "DELETED", "revive").when(F.col("status") == "FAILED", "retry").otherwise("reuse")
    return rows.withColumn("action", action).withColumn("created", action.isin("insert", "revive", "retry"))


def visible(catalog: DataFrame) -> DataFrame:
    return catalog.where("status <> 'DELETED'")


def orphans(rows: DataFrame, catalog: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(catalog.select(key), key, "left_anti")


def merge_limits(skills: DataFrame, by: list[str]) -> DataFrame:
    """Limits of several skills together: the least, and any or all of the flags."""
    return skills.groupBy(*by).agg(F.min("max_follow_up").alias("max_follow_up"), F.min("max_turns").alias("max_turns"), F.bool_or("require_evidence").alias("require_evidence"), F.bool_and("allow_finish").alias("allow_finish"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def owned(rows: DataFrame, user_id: str) -> DataFrame:
    """The user's rows that aren't deleted; missing, deleted and foreign ones all look absent."""
    return rows.where((F.col("user_id") == user_id) & (F.coalesce("status", F.lit("")) != "DELETED"))


def listed_conversations(conversations: DataFrame, user_id: str, keyword: str | None = None) -> DataFrame:
    """The user's conversations that aren't deleted, by a keyword in the title (wildcards as they stand), newest first."""
    rows = conversations.where((F.col("user_id") == user_id) & ~F.coalesce("deleted", F.lit(False)))
    rows = rows.where(F.col("title").ilike(f"%{keyword}%")) if keyword else rows
    return rows.orderBy(F.desc("updated_at"), "conv_id")


def message_counts(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, title, n``: messages of the conversations that are there."""
    return messages.join(conversations.select("conv_id", "title"), "conv_id").groupBy("conv_id", "title").agg(F.count("*").alias("n"))


# --- state changes: each takes the rows as they are and gives them as they will be --------------
def move_status(rows: DataFrame, which: Column, status: str, error: Column | None = None, now: Column | None = None) -> DataFrame:
    """Sets the status of the rows ``which`` holds for; READY ones that are moved on to a step of ingest stay. A failure's
    message is cut at 2000 characters. ``now`` stamps ``updated_at``."""
    moves = which if status in ("DELETED", "FAILED", "PENDING") else which & (F.col("status") != "READY")
    out = {"status": F.when(moves, status).otherwise(F.col("status"))}
    if error is not None:
        out["error"] = F.when(moves, F.substring(error, 1, 2000)).otherwise(F.col("error"))
    if now is not None:
        out["updated_at"] = F.when(moves, now).otherwise(F.col("updated_at"))
    return rows.withColumns(out)


def delete_documents(catalog: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Marks the documents of ``gone`` (doc_id) as deleted and takes out their chunks and vectors; the fourth table
    has how many there were before (``doc_id, chunks, vectors``)."""
    named = gone.select("doc_id").distinct()
    marked = catalog.join(named.withColumn("hit", F.lit(True)), "doc_id", "left")
    marked = marked.withColumn("status", F.when(F.col("hit"), "DELETED").otherwise(F.col("status"))).select(*catalog.columns)
    counts = [t.join(named, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias(n)) for t, n in ((chunks, "chunks"), (vectors, "vectors"))]
    before = reduce(lambda a, b: a.join(b, "doc_id", "left"), counts, named).na.fill(0, ["chunks", "vectors"])
    return marked, chunks.join(named, "doc_id", "left_anti"), vectors.join(named, "doc_id", "left_anti"), before


def apply_conversation(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Conversations (conv_id, user_id, title, deleted, updated_at) after ``changes`` (conv_id, user_id, action, title,
    at): create, rename, delete, clear. Changes of a conversation apply in order of ``at``; others' and unknown
    ones don't count, and a deleted conversation stays deleted."""
    renames = F.max_by(F.when(F.col("action").isin("create", "rename"), F.col("new_title")), F.when(F.col("action").isin("create", "rename"), F.col("at")))
    asked = changes.select("conv_id", F.col("user_id").alias("by_user"), "action", F.col("title").alias("new_title"), "at")
    known = conversations.select("conv_id", "user_id").unionByName(changes.where("action = 'create'").select("conv_id", "user_id")).groupBy("conv_id").agg(F.min("user_id").alias("owner"))
    valid = asked.join(known, "conv_id").where("owner = by_user")
    told = valid.groupBy("conv_id", "owner").agg(renames.alias("new_title"), F.bool_or(F.col("action") == "delete").alias("gone"), F.max("at").alias("at"))
    rows = conversations.join(told, "conv_id", "full")
    return rows.select(
        "conv_id", F.coalesce("user_id", "owner").alias("user_id"), F.coalesce("new_title", "title").alias("title"),
        (F.coalesce("deleted", F.lit(False)) | F.coalesce("gone", F.lit(False))).alias("deleted"), F.greatest("updated_at", "at").alias("updated_at"),
    )


def append_messages(conversations: DataFrame, messages: DataFrame, placeholder: str) -> DataFrame:
    """``conversations`` with ``message_count``, ``updated_at`` and, while the title is a placeholder, the title as
    ``messages`` (conv_id, turn, role, text, at) make them: derived, not maintained."""
    from ragloom.functions.text import title

    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    seen = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("at").alias("last_at"), first.alias("first_text"))
    rows = conversations.drop("message_count").join(seen, "conv_id", "left")
    named = F.when((F.col("title") == placeholder) & F.col("first_text").isNotNull(), title(F.col("first_text"))).otherwise(F.col("title"))
    return rows.withColumns({"title": named, "updated_at": F.greatest("updated_at", "last_at"), "message_count": F.coalesce("message_count", F.lit(0))}).drop("last_at", "first_text")


def turn_rows(answers: DataFrame, start: int = 0) -> DataFrame:
    """Messages of answered questions (conv_id, question, answer, error): the user's, then the assistant's, which is there
    with its error too if there was one."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(None).cast("string").alias("error")), F.struct(F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("text"), F.col("error").alias("error")))
    return answers.select("conv_id", F.posexplode(said).alias("turn", "m")).select("conv_id", (F.col("turn") + start).alias("turn"), "m.role", "m.text", "m.error")


def orphan_report(tables: dict[str, DataFrame], catalog: DataFrame) -> DataFrame:
    """``store, doc_id, rows`` of what no document of the catalog owns, over several tables; nothing is deleted."""
    parts = [orphans(t, catalog).groupBy("doc_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "doc_id", "rows") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --- configuration ----------------------------------------------------------------------------
@dataclass(frozen=True)
class Settings:
    """Parameters that can be changed while running; ``update`` checks all of a change before any of it counts."""

    parent_size: int = 1500
    child_size: int = 300
    overlap: int = 50
    min_size: int = 30
    vector_top_k: int = 20
    bm25_top_k: int = 20
    rrf_k: int = 60
    final_top_k: int = 5
    rerank_enabled: bool = True
    rerank_min_score: float = 0.0

    def update(self, changes: dict) -> Settings:
        """A new object with the changes; unknown names are left out, nulls keep the value, and an invalid whole raises."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        new = replace(self, **{k: kinds[k](v) for k, v in changes.items() if k in kinds and v is not None})
        wrong = [m for m, bad in (("child_size must be below parent_size", new.child_size >= new.parent_size), ("overlap must be below child_size", not 0 <= new.overlap < new.child_size), ("final_top_k is above what is recalled", new.final_top_k > max(new.vector_top_k, new.bm25_top_k))) if bad]
        if wrong:
            raise ValueError("; ".join(wrong))
        return new

    def as_dict(self) -> dict:
        return asdict(self)


# --- skills -----------------------------------------------------------------------------------
def resolve_skills(asked: DataFrame, skills: DataFrame, most: int = 2) -> DataFrame:
    """Requests (request_id, skill_ids) with their known skills in order, once each. More than ``most`` ids, repeats
    included, or an unknown one make an ``error``."""
    known = skills.select(F.col("id").alias("skill_id"), F.lit(True).alias("known")).dropDuplicates(["skill_id"])
    rows = asked.select("request_id", "skill_ids", F.posexplode_outer(F.array_distinct("skill_ids")).alias("place", "skill_id")).join(known, "skill_id", "left")
    found = F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("place", "skill_id")))), lambda x: x["skill_id"])
    missing = F.count_if(F.col("skill_id").isNotNull() & F.col("known").isNull())
    out = rows.groupBy("request_id").agg(F.first("skill_ids").alias("skill_ids"), found.alias("skills"), missing.alias("missing"))
    error = F.when(F.size("skill_ids") > most, "too many skills").when(F.col("missing") > 0, "unknown skill")
    return out.select("request_id", F.when(error.isNull(), F.col("skills")).alias("skills"), error.alias("error"))


def compose_skills(resolved: DataFrame, skills: DataFrame, default: str = "") -> DataFrame:
    """``request_id, prompt`` and the limits of its skills together: bodies under a line that tells the first from what
    adds to it, the least limits, and any or all of the flags; the defaults for none."""
    rows = resolved.where("error is null").select("request_id", F.posexplode_outer("skills").alias("place", "id")).join(skills, "id", "left")
    head = F.when(F.col("place") == 0, F.lit("【首要面试风格】")).otherwise(F.concat(F.lit("【补充视角 "), F.col("place").cast("string"), F.lit("】")))
    part = F.when(F.col("id").isNotNull(), F.struct("place", F.concat(head, F.lit("\n"), "body").alias("p")))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"]), "\n\n---\n\n")
    return rows.groupBy("request_id").agg(
        F.when(told == "", F.lit(default)).otherwise(told).alias("prompt"), F.coalesce(F.min("max_follow_up"), F.lit(3)).alias("max_follow_up"), F.coalesce(F.min("max_turns"), F.lit(20)).alias("max_turns"),
        F.coalesce(F.bool_or("require_evidence"), F.lit(False)).alias("require_evidence"), F.coalesce(F.bool_and("allow_finish"), F.lit(True)).alias("allow_finish"),
    )


def public_skills(skills: DataFrame) -> DataFrame:
    """Skills as they are listed: by name, without their bodies."""
    return skills.drop("body", "path", "error").orderBy("name", "id")
