"""Structured Streaming twins: incremental ingest, event windows, sessions, interval joins, keyed states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.operators.chunking import ChunkParams, chunk
from ragloom.operators.store import DocumentStore

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, params: ChunkParams | None = None) -> StreamingQuery:
    """Chunks new documents as their files come. A batch overwrites its own folder, so repeats are harmless."""

    def write(batch: DataFrame, no: int) -> None:
        chunk(batch.select("doc_id", "text"), params).write.mode("overwrite").parquet(f"{target}/batch={no}")

    stream = spark.readStream.schema(DOCS).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(store: DocumentStore, source: str, checkpoint: str) -> StreamingQuery:
    """Cleans, cuts and indexes new documents as their files come (``DocumentStore.ingest``). A batch that runs again after a loss
    replaces its own documents."""
    stream = store.spark.readStream.schema(DOCS).parquet(source)
    told = stream.select("doc_id", "text", F.col("source").alias("filename"))
    return told.writeStream.foreachBatch(lambda batch, no: store.ingest(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 day", lateness: str | None = None) -> DataFrame:
    """Count and sum of values by type and tumbling window; with ``lateness`` for a stream."""
    rows = events.withWatermark("ts", lateness) if lateness else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """Events of a user without a gap; with ``lateness`` for a stream."""
    rows = events.withWatermark("ts", lateness) if lateness else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), "n")


def followed_by(first: DataFrame, then: DataFrame, within: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """Each event of ``first`` with every event of ``then`` of its user that comes up to ``within`` later; one without any has a row with
    nulls. Of streams, with ``lateness``, the state holds what may still find a partner, and a row with nulls is given
    once the watermark tells that none can come."""
    side = lambda rows, name: rows.select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
    left, right = side(first, "first"), side(then, "then")
    if lateness:
        left, right = left.withWatermark("first_ts", lateness), right.withWatermark("then_ts", lateness)
    near = (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    joined = left.join(right, (F.col("first_user") == F.col("then_user")) & near, "leftOuter")
    return joined.select(F.col("first_user").alias("user_id"), "first_id", "first_ts", "then_id", "then_ts")


def conversation_state(messages: DataFrame) -> DataFrame:
    """Running state of each conversation of a stream of messages (conv_id, turn, role, text, ts): count, last time
    and first user text, a row for each conversation that a batch changes (update mode)."""
    user = F.col("role") == "user"
    first = F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("ts").alias("last_at"), first.alias("first_text"))


INTERVIEW = "key long, turn int, topic long, depth long, turns long, finished boolean"


def interview_states(turns: DataFrame, max_turns: int = 20) -> DataFrame:
    """The states of ``interview.states`` over a stream of turns (key long, turn int, action string): a keyed state
    machine. Turns of a key within a batch apply in order of ``turn``."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        topic, depth, seen = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("turn")
        out = []
        for turn, action in zip(rows["turn"], rows["action"], strict=True):
            opens = action != "FOLLOW_UP"
            topic, depth, seen = topic + opens, 0 if opens else depth + 1, seen + 1
            out.append((key[0], turn, topic, depth, seen, seen >= max_turns))
        state.update((topic, depth, seen))
        yield pd.DataFrame(out, columns=["key", "turn", "topic", "depth", "turns", "finished"])

    return turns.groupBy("key").applyInPandasWithState(step, INTERVIEW, "topic long, depth long, turns long", "append", GroupStateTimeout.NoTimeout)
