"""Retrieval evaluation: evidence ranks, recall, precision, reciprocal rank, thresholds, latency."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Depths of the metrics, how much of an evidence `evidence_matches` compares, and how much counts as found.
KS = (1, 3, 5, 10)
CHAIN = ("rrf_fused", "deduped", "reranked", "final_parents")
SINGLE = ("vector_only", "bm25_only")
PRESETS = (
    ("chunk_fixed", "fixed", 300, 50, None, None), ("chunk_recursive", "recursive", 300, 50, None, None),
    ("chunk_parent_150", "parent_child", 150, 30, None, None), ("chunk_parent_300", "parent_child", 300, 50, None, None),
    ("chunk_parent_500", "parent_child", 500, 80, None, None), ("pipeline_no_bm25", "parent_child", 300, 50, 0, None),
    ("pipeline_no_rerank", "parent_child", 300, 50, None, False),
)
PRESET_SCHEMA = "name string, strategy string, child_size int, overlap int, bm25_top_k int, rerank_enabled boolean"
EVIDENCE_CHARS, SHORTEST_MATCH, FOUND_FROM = 800, 8, 0.6


def evidence_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def is_no_answer(category: Column, evidences: Column) -> Column:
    """Whether a golden item has no answer: by its category, or for want of evidence."""
    return F.coalesce(category == "no_answer", F.lit(False)) | (F.coalesce(F.size(evidences), F.lit(0)) <= 0)


def golden_evidences(items: DataFrame) -> DataFrame:
    """``item_id, evidence_no, evidence`` of the golden items (item_id, category, evidences) that have an answer."""
    asked = items.where(~is_no_answer(F.col("category"), F.col("evidences")))
    return asked.select("item_id", F.posexplode("evidences").alias("evidence_no", "evidence")).withColumn("evidence_no", F.col("evidence_no") + 1)


def evidence_ranks(evidences: DataFrame, retrieved: DataFrame, whole: bool = False) -> DataFrame:
    """``item_id, evidence_no, hit_rank`` (null: not found) and ``found_at``, all ranks that found it; a retrieved text finds the evidence from a
    match ratio of 0.6 on, or with ``whole`` only if it holds all of it."""
    pairs = evidences.join(retrieved, "item_id", "left")
    content, evidence = F.col("content"), F.col("evidence")
    hit = F.contains(evidence_key(content), evidence_key(evidence)) if whole else match_ratio(content, evidence) >= FOUND_FROM
    found = pairs.withColumn("found", F.when(hit, F.col("rank")))
    return found.groupBy("item_id", "evidence_no").agg(F.min("found").alias("hit_rank"), F.collect_set("found").alias("found_at"))


def question_scores(ranks: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per item of ``evidence_ranks``: recall, hit and precision at each k, and reciprocal rank."""
    got = retrieved.groupBy("item_id").agg(F.count("*").alias("retrieved"))
    base = ranks.groupBy("item_id").agg(
        *[F.avg(F.coalesce((F.col("hit_rank") <= k).cast("int"), F.lit(0))).alias(f"recall_{k}") for k in KS],
        F.coalesce(1 / F.min("hit_rank"), F.lit(0.0)).alias("rr"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found_at")))).cast("long").alias("matched"),
    )
    rows = base.join(got, "item_id", "left").na.fill(0, ["retrieved"])
    at = lambda k: F.coalesce(F.least("matched", F.lit(k)) / F.nullif(F.least(F.lit(k), F.col("retrieved")), F.lit(0)), F.lit(0.0)).alias(f"precision_{k}")
    return rows.select("*", *[at(k) for k in KS])


def stage_metrics(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the items of ``scores``, which are those with an answer."""
    means = [F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for m in ("recall", "precision") for k in KS]
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("questions"), *means, F.round(F.avg("rr"), 6).alias("mrr"), F.count_if(F.expr("retrieved = 0")).alias("empty_results"))


def refusal_rates(items: DataFrame) -> DataFrame:
    """Of ``(answerable, refused)``: counts and rates of false refusals and false answers."""
    rate = lambda n, d: F.bround(F.coalesce(F.try_divide(n, d), F.lit(0.0)), 4)
    no = ~F.col("answerable")
    fr, fa = F.count_if(F.col("answerable") & F.col("refused")), F.count_if(no & ~F.col("refused"))
    return items.agg(F.count_if("answerable").alias("answerable"), F.count_if(no).alias("no_answer"), fr.alias("false_refusals"), fa.alias("false_answers"), rate(fr, F.count_if("answerable")).alias("false_refusal_rate"), rate(fa, F.count_if(no)).alias("false_answer_rate"))


def cumulative(rows: DataFrame, by: str, sums: list[str], parts: int = 64) -> DataFrame:
    """``rows`` with the sum of each column of ``sums`` over all rows of a smaller number ``by`` (``before_..``) and over
    all rows (``all_..``); equal numbers are one place.

    Not one window over everything: approximate quantiles cut the numbers into ranges, whose totals
    (``parts`` rows, broadcast) are added to windows within them."""
    cuts = rows.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000).alias("cuts")).first().cuts or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in dict.fromkeys(cuts)]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    placed = rows.withColumn("part", part)
    totals = placed.groupBy("part").agg(*[F.sum(c).alias(f"of_{c}") for c in sums])
    ordered = Window.orderBy("part")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", *[F.coalesce(F.sum(f"of_{c}").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"up_{c}") for c in sums], *[F.sum(f"of_{c}").over(every).alias(f"all_{c}") for c in sums])
    smaller = Window.partitionBy("part").orderBy(by)  # up to the rows of an equal number
    inside = placed.select("*", *[F.sum(c).over(smaller).alias(f"to_{c}") for c in sums], *[F.sum(c).over(Window.partitionBy("part", by)).alias(f"at_{c}") for c in sums])
    joined = inside.join(F.broadcast(offsets), "part")
    return joined.select(*rows.columns, *[(F.col(f"up_{c}") + F.col(f"to_{c}") - F.col(f"at_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def threshold_sweep(scores: DataFrame, weight: float = 2.0) -> DataFrame:
    """Loss of each distinct score as the threshold: false refusals + weight * false answers.

    Cumulative counts over the distinct scores, not thresholds times scores."""
    each = scores.groupBy("top_score").agg(F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no"))
    rows = cumulative(each, "top_score", ["yes", "no"])
    fr, fa = F.col("before_yes"), F.col("all_no") - F.col("before_no")
    return rows.select(F.col("top_score").alias("threshold"), fr.alias("false_refusals"), fa.alias("false_answers"), (fr + weight * fa).alias("loss"))


def separability(scores: DataFrame) -> DataFrame:
    """Of ``(answerable, top_score)``: the least score with an answer, the greatest without, and whether they part."""
    low, high = F.min(F.when(F.col("answerable"), F.col("top_score"))), F.max(F.when(~F.col("answerable"), F.col("top_score")))
    return scores.agg(low.alias("low_answerable"), high.alias("high_no_answer"), F.coalesce(high < low, F.lit(False)).alias("separable"))


def score_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``count, min, max, avg`` of scores, rounded; zeros where there are none."""
    at = lambda c, name: F.coalesce(F.round(c, 3), F.lit(0.0)).alias(name)
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("count"), at(F.min(value), "min"), at(F.max(value), "max"), at(F.avg(value), "avg"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.min_by("threshold", F.struct("loss", "threshold")).alias("threshold"), F.min("loss").alias("loss"))


def percentiles(rows: DataFrame, value: str, points: tuple[float, ...]) -> DataFrame:
    """One row with the exact percentiles ``p0, p1, ..`` (linear interpolation) of a number.

    Values are counted first, then found by their cumulative count; no task holds them all."""
    each = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    placed = cumulative(each, "v", ["n"])

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("v")))

    found = []
    for i, p in enumerate(points):
        place = F.lit(p) * (F.col("all_n") - 1)
        part = place - F.floor(place)
        found += [at(F.floor(place)).alias(f"low{i}"), at(F.ceil(place)).alias(f"high{i}"), F.max(part).alias(f"part{i}")]
    return placed.agg(*found).select(*[(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"part{i}")).alias(f"p{i}") for i in range(len(points))])


def latency(rows: DataFrame, value: str) -> DataFrame:
    points = percentiles(rows, value, (0.5, 0.95, 0.99)).select(*[F.round(f"p{i}", 1).alias(p) for i, p in enumerate(("p50", "p95", "p99"))])
    whole = rows.agg(F.count(value).alias("n"), F.round(F.avg(value), 1).alias("avg"), F.round(F.max(value), 1).alias("max"))
    return whole.crossJoin(F.broadcast(points))  # one row each


def ablation(stages: DataFrame) -> DataFrame:
    order = Window.orderBy("stage_no")
    return stages.withColumn("delta", F.round(F.col("mrr") - F.lag("mrr").over(order), 6))


def dedupe_golden(items: DataFrame) -> DataFrame:
    """First item of each question (white space and case aside), renumbered."""
    first = Window.partitionBy(evidence_key(F.col("question"))).orderBy("item_id")
    kept = items.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    numbered = cumulative(kept.withColumn("one", F.lit(1)), "item_id", ["one"])
    return numbered.withColumn("new_id", F.format_string("q%03d", F.col("before_one") + 1)).drop("one", "before_one", "all_one")


def extend_golden(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new items together, of equal questions the first (old ones before new ones), renumbered."""
    both = existing.select("*", F.lit(0).alias("late")).unionByName(new.select("*", F.lit(1).alias("late")))
    first = Window.partitionBy(evidence_key(F.col("question"))).orderBy("late", "item_id")
    kept = both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    # both sides number from their own start: new ones come after the old
    shift = existing.agg(F.coalesce(F.max("item_id"), F.lit(0)).alias("last"))
    placed = kept.crossJoin(F.broadcast(shift)).withColumn("place", F.col("item_id") + F.when(F.col("late") == 1, F.col("last") + 1).otherwise(0))
    numbered = cumulative(placed.withColumn("one", F.lit(1)), "place", ["one"])
    return numbered.withColumn("new_id", F.format_string("q%03d", F.col("before_one") + 1)).drop("one", "before_one", "all_one", "place", "last", "late")


def golden_items(chunks: DataFrame, ask: Callable[[Column], Column] | None = None, evidence: Column | None = None) -> DataFrame:
    """A golden item for each chunk (id, doc_id, content): a question and its evidence, which must stand in the
    chunk, or else is its first 120 characters. ``ask`` makes the question of the content (a model's place)."""
    content = F.col("content")
    question = ask(content) if ask else F.concat(F.lit("What is said of: "), F.substring(content, 1, 40), F.lit("?"))
    told = content if evidence is None else evidence
    held = F.when((F.coalesce(told, F.lit("")) != "") & F.contains(content, told), told).otherwise(F.substring(content, 1, 120))
    return chunks.select(F.col("id").alias("item_id"), "doc_id", question.alias("question"), F.array(held).alias("evidences"), F.lit("fact").alias("category"))


def generation_means(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the graded rows' judge scores; zeros without any."""
    mean = lambda c: F.coalesce(F.bround(F.avg(F.when(F.col("graded"), F.col(c))), 4), F.lit(0.0)).alias(c)
    return scores.groupBy(*(by or [])).agg(F.count_if("graded").alias("graded"), mean("faithfulness"), mean("correctness"))


def presets(spark: SparkSession) -> DataFrame:
    """The seven configurations that are compared; a null keeps the default."""
    return spark.createDataFrame(PRESETS, PRESET_SCHEMA)


def chain_findings(stages: DataFrame, k: int = 5) -> DataFrame:
    """``rule, verdict, value`` from one configuration's stages (stage, recall, mrr): fusion against the best single
    list (0.005 either way), the gain of each further step, and what limits the result."""
    at = lambda name, c: F.coalesce(F.max(F.when(F.col("stage") == name, F.col(c))), F.lit(0.0))
    wide = stages.agg(*[at(n, c).alias(f"{n}_{c}") for n in (*SINGLE, *CHAIN) for c in ("recall", "mrr")])
    gain = F.col("rrf_fused_mrr") - F.greatest(*[F.col(f"{n}_mrr") for n in SINGLE])
    fused = F.when(gain > 0.005, "helps").when(gain < -0.005, "hurts").otherwise("even")
    stronger = F.when(F.col("vector_only_mrr") >= F.col("bm25_only_mrr"), "vector_only").otherwise("bm25_only")
    last_r, last_m = F.col("final_parents_recall"), F.col("final_parents_mrr")
    limit = F.when((last_r >= 0.99) & (last_m < 0.97), "ranking").when(last_r < 0.9, "recall").otherwise("none")
    rows = [("single", stronger, F.col("vector_only_mrr") - F.col("bm25_only_mrr")), ("fusion", fused, gain), ("limit", limit, last_m)]
    rows += [(f"step {b}", F.when(F.abs(F.col(f"{b}_mrr") - F.col(f"{a}_mrr")) >= 0.005, "moves").otherwise("even"), F.col(f"{b}_mrr") - F.col(f"{a}_mrr")) for a, b in zip(CHAIN, CHAIN[1:], strict=False)]
    told = F.array(*[F.struct(F.lit(r).alias("rule"), v.alias("verdict"), F.round(x, 6).alias("value")) for r, v, x in rows])
    return wide.select(F.explode(told).alias("f")).select("f.*")


def render_report(configs: DataFrame, columns: list[str], title: str = "Evaluation") -> str:
    """A Markdown table of a small table of results, one row for each configuration."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in configs.select(*columns).orderBy(columns[0]).collect())]) + "\n"


def write_report(configs: DataFrame, path: str, columns: list[str], by: str = "name") -> None:
    """A JSON file for each configuration, and the table as Markdown, under one folder."""
    configs.write.mode("overwrite").partitionBy(by).json(f"{path}/configs")
    spark = configs.sparkSession
    spark.createDataFrame([(render_report(configs, columns),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def evidence_hits(docs: DataFrame, items: DataFrame, block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id`` of the documents (doc_id, text) that hold an item's text (item_id, text), white space and
    case aside. Documents are scanned where they lie by an automaton of the items, in blocks of bounded size."""
    keyed = items.select("item_id", evidence_key(F.col("text")).alias("e")).where("e <> ''").distinct()
    blocks = (keyed.agg(F.sum(F.char_length("e"))).first()[0] or 0) // block_chars + 1
    rows = docs.select("doc_id", evidence_key(F.col("text")).alias("t"))
    spec = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long"

    def scan(told: list[tuple[int, str]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, of = ahocorasick.Automaton(), {}
            for item, e in told:
                of.setdefault(e, []).append(item)
            for e, own in of.items():
                words.add_word(e, own)
            words.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = sorted({item for _, own in words.iter(text or "") for item in own})
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        return run

    parts = []
    for no in range(blocks):
        told = [(r.item_id, r.e) for r in keyed.where(F.pmod(F.xxhash64("e"), F.lit(blocks)) == no).collect()]
        if told:
            parts.append(rows.mapInArrow(scan(told), spec))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], spec)


def sweep_depths(ranks: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """Recall and reciprocal rank if only the first ``top_k`` results were kept, for each depth."""
    rows = ranks.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in depths])))
    within = F.col("hit_rank") <= F.col("top_k")
    return rows.groupBy("top_k").agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.coalesce(within.cast("int"), F.lit(0))), 6).alias("recall"),
        F.round(F.avg(F.when(within, 1 / F.col("hit_rank")).otherwise(0.0)), 6).alias("mrr"),
    )


def findings(configs: DataFrame, name: str, score: str) -> DataFrame:
    """The best and the worst configuration by a score; of equal ones the first by name."""
    best = F.min_by(name, F.struct(-F.col(score), F.col(name)))
    return configs.agg(best.alias("best"), F.max(score).alias(f"best_{score}"), F.min_by(name, F.struct(score, name)).alias("worst"), F.min(score).alias(f"worst_{score}"))


_FACTOR = 0x9E3779B97F4A7C15 | 1


def _windows(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive points, by doubling."""
    n = len(points) - size + 1
    out, done, power, reach = np.zeros(n, np.uint64), 0, points.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while True:
            if size & reach:
                out = out * np.uint64(pow(_FACTOR, reach, 1 << 64)) + power[done : done + n]
                done += reach
            if reach * 2 > size:
                return out
            power = power[:-reach] * np.uint64(pow(_FACTOR, reach, 1 << 64)) + power[reach:]
            reach *= 2


def _share_run(a: np.ndarray, b: np.ndarray, size: int) -> bool:
    one, two = _windows(a, size), _windows(b, size)
    order = np.argsort(two, kind="stable")
    at = np.minimum(np.searchsorted(two[order], one), len(two) - 1)
    # equal hashes are compared point by point
    return any((a[i : i + size] == b[j : j + size]).all() for i in np.flatnonzero(two[order[at]] == one).tolist() for j in (order[at[i]],))


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common substring of two code point arrays: a shared run of some length has shared
    runs of all smaller ones, so the length is found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if _share_run(a, b, middle):
            low = middle
        else:
            high = middle - 1
    return low


def whole_ratio(content: str | None, evidence: str | None) -> float:
    if not content or not evidence:
        return 0.0
    if evidence in content:
        return 1.0
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = longest_common(points(evidence), points(content))
    return found / len(evidence) if found >= min(SHORTEST_MATCH, len(evidence)) else 0.0


def _ratio(content: str | None, evidence: str | None) -> float:
    """The ratio of ``evidence_matches``, whose SQL compares an evidence's first signs only."""
    return whole_ratio(content, evidence and evidence[:EVIDENCE_CHARS])


def match_ratio(content: Column, evidence: Column) -> Column:
    """1 where the text holds the evidence, else the share of the whole evidence that their longest
    common substring covers. White space and case don't count; null or empty texts match nothing.

    Arrow batches, as there's no built-in for it; pairs come from a bounded list per question.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([whole_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio(evidence_key(content), evidence_key(evidence))
