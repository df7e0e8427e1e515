"""Interview operators over ordered turns: states, transcripts, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def states(turns: DataFrame, key: str, order: str, action: str = "action", max_turns: int = 20) -> DataFrame:
    """Adds ``topic``, ``depth`` and ``finished``, the state after each turn's action.

    A follow-up deepens the topic by one, any other action opens the next one at depth
    zero. A null action counts as opening one. Rows that tie on ``order`` share no defined
    place, so callers give it a tie-break. An interview is finished at ``max_turns`` turns.
    """
    seen = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col(action) != "FOLLOW_UP", F.lit(True)).cast("long")
    rows = turns.withColumn("topic", F.sum(opens).over(seen)).withColumn("finished", F.count("*").over(seen) >= max_turns)
    # before the first opening there is a topic zero, whose first turn is a follow-up already
    within = Window.partitionBy(key, "topic").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("depth", F.count("*").over(within) - F.when(F.col("topic") > 0, 1).otherwise(0))


def transcript(turns: DataFrame, key: str, order: str, role: Column, text: Column, last: int = 6) -> DataFrame:
    """``(key, transcript)``: the last turns in order, one line each. A null text is empty."""
    back = Window.partitionBy(key).orderBy(F.col(order).desc())
    rows = turns.select(key, order, F.concat_ws(": ", role, F.coalesce(text, F.lit(""))).alias("line"), F.row_number().over(back).alias("back")).where(F.col("back") <= last)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "line"))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("transcript"))


def cleaned_outline(plan: Column, most: int = 8) -> Column:
    """Of a planner's JSON list the first ``most`` topics, trimmed; those without an opening question go. Garbage: none."""
    body = F.regexp_extract(F.regexp_replace(plan, r"```\w*", ""), r"(?s)(\[.*\])", 1)
    items = F.slice(F.coalesce(F.from_json(body, "array<struct<topic:string,angle:string,opening:string>>"), F.array().cast("array<struct<topic:string,angle:string,opening:string>>")), 1, most)
    bare = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.filter(F.transform(items, lambda x: F.struct(bare(x["topic"]).alias("topic"), bare(x["angle"]).alias("angle"), bare(x["opening"]).alias("opening"))), lambda x: x["opening"] != "")


def rendered_outline(outline: Column, current: Column) -> Column:
    """The topics as numbered lines, the current one marked; empty without any."""
    line = lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["topic"], F.lit("（"), x["angle"], F.lit("）"), F.when(i == current, F.lit("  ← 当前")).otherwise(F.lit("")))
    return F.when(F.coalesce(F.size(outline), F.lit(0)) <= 0, F.lit("")).otherwise(F.concat(F.lit("【面试提纲】\n"), F.array_join(F.transform(outline, line), "\n")))


def rendered_evaluation(doubt: Column, highlight: Column, vague: Column) -> Column:
    """What was noticed of the last answer, a line each; empty if nothing was."""
    told = lambda c, head: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    lines = F.array_compact(F.array(told(doubt, "  - 可疑点："), told(highlight, "  - 亮点："), told(F.array_join(vague, "、"), "  - 出现了模糊表述：")))
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.concat(F.lit("\n【上一轮回答的评估】\n"), F.array_join(lines, "\n")))


def evaluation_hint(depth: Column, numbers: Column, tradeoff: Column, vague: Column) -> Column:
    """The evaluation of an answer in one line."""
    label = F.when(depth == "shallow", "偏浅").when(depth == "medium", "中等").when(depth == "deep", "有深度")
    words = F.array_join(vague, "、")
    parts = F.array(label, F.when(numbers, "有具体数据"), F.when(tradeoff, "讲到了取舍"), F.when(F.coalesce(words, F.lit("")) != "", F.concat(F.lit("有模糊表述("), words, F.lit(")"))))
    return F.array_join(F.array_compact(parts), " · ")


def summary_report(output: Column) -> Column:
    """(overall, highlights, concerns, suggestions, score) of a report's JSON; what is no JSON is ``overall`` as it stands."""
    text = F.trim(F.coalesce(output, F.lit("")))
    spec = "overall string, highlights array<string>, concerns array<string>, suggestions array<string>, score map<string,double>"
    read = F.from_json(F.regexp_replace(F.regexp_replace(text, r"^```\w*\s*", ""), r"\s*```$", ""), spec)
    none = F.array().cast("array<string>")
    lists = [F.coalesce(read[n], none).alias(n) for n in ("highlights", "concerns", "suggestions")]
    whole = F.when(read["overall"].isNull() & F.coalesce(F.size(read["highlights"]) < 0, F.lit(True)), text).otherwise(F.coalesce(read["overall"], F.lit("")))
    return F.struct(whole.alias("overall"), *lists, read["score"].alias("score"))


def rebuilt_texts(chunks: DataFrame, most: int = 20_000) -> DataFrame:
    """``doc_id, text`` from stored chunks (doc_id, chunk_type, order_index, content): the parents in order, all chunks of a
    document that has none, blank ones left out, cut at ``most`` characters."""
    own = Window.partitionBy("doc_id")
    rows = chunks.withColumn("n", F.count_if(F.col("chunk_type") == "parent").over(own)).where("n = 0 or chunk_type = 'parent'").where("trim(content) <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("order_index", "content"))), lambda x: x["content"])
    return rows.groupBy("doc_id").agg(F.substring(F.array_join(parts, "\n\n"), 1, most).alias("text"))
