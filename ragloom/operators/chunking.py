"""Chunking: fixed and recursive spans, sections, parent/child packing, statistics.

Spans and joins are declarative; greedy packing, which resets as it goes, is an Arrow
kernel over whole documents, after the one shuffle that brings their paragraphs together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Default separators in order of preference, and sentence ends.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "…", "，")
SENTENCE_SPLIT = r"(?<=[。！？；!?;])|(?<=\.)(?=\s+[A-Z])|\n+"


def parse_separators(told: str | None, delimiter: str = "|") -> list[str]:
    """Separators of a configuration line, with ``\\n``, ``\\t`` and ``\\r`` spelt out; none: the default ones."""
    spelt = {"\\n": "\n", "\\t": "\t", "\\r": "\r"}
    found = [re.sub(r"\\[ntr]", lambda m: spelt[m[0]], part) for part in (told or "").split(delimiter)]
    return [x for x in found if x] or list(SEPARATORS)


def format_separators(separators: list[str], delimiter: str = "|") -> str:
    spelt = {"\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return delimiter.join("".join(spelt.get(c, c) for c in x) for x in separators)


@dataclass(frozen=True)
class ChunkParams:
    strategy: str = "parent_child"
    parent_size: int = 1500
    child_size: int = 300
    overlap: int = 50
    min_size: int = 30
    separators: tuple[str, ...] = field(default=SEPARATORS)

    def validate(self) -> ChunkParams:
        wrong = []
        if self.strategy not in ("fixed", "recursive", "parent_child"):
            wrong.append("unknown strategy")
        if min(self.parent_size, self.child_size) < 20:
            wrong.append("sizes must be 20 at least")
        if self.child_size >= self.parent_size:
            wrong.append("child_size must be below parent_size")
        if not 0 <= self.overlap < self.child_size:
            wrong.append("overlap must be below child_size")
        if not self.separators:
            wrong.append("no separators")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def chunk(docs: DataFrame, params: ChunkParams | None = None, **changes) -> DataFrame:
    """Chunks by the strategy of ``params``; ``changes`` that are None keep the parameter."""
    p = params or ChunkParams()
    p = ChunkParams(**{**p.__dict__, **{k: v for k, v in changes.items() if v is not None}}).validate()
    if p.strategy == "fixed":
        return fixed_chunks(docs, p.child_size, p.overlap)
    if p.strategy == "recursive":
        return recursive_chunks(docs, p.child_size, p.separators)
    return parent_child_chunks(marked_paragraphs(docs), p)


def fixed_chunks(docs: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """Span i starts at i * step; the last one reaches the end. ``doc_id, no, start, end, content``.

    A text is cut into groups of spans first: each span that is cut from a text looks through all that is before it."""
    step = max(1, size - overlap)
    last = F.ceil(F.greatest(F.lit(0), F.col("n") - size) / step).cast("int")
    rows = docs.where("text <> ''").select("doc_id", "text", F.char_length("text").alias("n")).select("*", last.alias("last"))
    groups = rows.select("doc_id", "n", "last", "text", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / SPANS).cast("int"))).alias("g"))
    groups = groups.select("doc_id", "n", "last", (F.col("g") * SPANS).alias("first"), F.expr(f"substring(text, g * {SPANS * step} + 1, {(SPANS - 1) * step + size})").alias("part"))
    spans = groups.select("doc_id", "n", "first", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(SPANS - 1), F.col("last") - F.col("first")))).alias("i"))
    no = F.col("first") + F.col("i")
    return spans.select("doc_id", no.alias("no"), (no * step).alias("start"), F.least(no * step + size, F.col("n")).alias("end"), F.expr(f"substring(part, i * {step} + 1, {size})").alias("content"))


#: Spans that are cut from one piece of a text.
SPANS = 32


def recursive_chunks(docs: DataFrame, size: int = 300, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Pieces over ``size`` are split after each separator in turn, and what is left over by length.
    Small pieces are not merged. ``doc_id, no, content``."""
    rows = docs.where("text <> ''").select("doc_id", F.array(F.lit(0)).alias("path"), F.col("text").alias("piece"))
    for separator in separators:
        # a regular expression splits after every separator and keeps it
        after = f"(?<={''.join(chr(92) + c if c in '.|' else c for c in separator)})"
        cut = F.filter(F.split("piece", after, -1), lambda x: x != "")
        parts = F.when(F.char_length("piece") > size, cut).otherwise(F.array("piece"))
        rows = rows.select("doc_id", "path", F.posexplode(parts).alias("i", "piece")).select("doc_id", F.concat("path", F.array("i")).alias("path"), "piece")
    n = F.char_length("piece")
    rows = rows.select("doc_id", "path", "piece", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.lit(0), n - size) / size).cast("int"))).alias("i"))
    rows = rows.select("doc_id", F.concat("path", F.array("i")).alias("path"), F.expr(f"substring(piece, i * {size} + 1, {size})").alias("content"))
    order = Window.partitionBy("doc_id").orderBy("path")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("no"), "content")


def sections(paras: DataFrame) -> DataFrame:
    """Adds ``level`` and ``section_path`` to paragraphs with ``is_heading, section_number``.

    A heading of level L clears those of its level and below; a level's last heading counts
    if it comes after the last one of every shallower level."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("is_heading"), F.least(F.lit(4), F.coalesce(F.size(F.split("section_number", r"\.")), F.lit(1))))
    rows = paras.withColumn("level", level)
    tops = [F.max(F.when(F.col("level") == k, F.struct("seq", "text"))).over(order).alias(f"h{k}") for k in range(1, 5)]
    rows = rows.select("*", *tops)
    parts = []
    for k in range(1, 5):
        newer = [F.coalesce(F.col(f"h{k}.seq") > F.col(f"h{j}.seq"), F.lit(True)) for j in range(1, k)]
        valid = F.col(f"h{k}").isNotNull()
        for c in newer:
            valid = valid & c
        parts.append(F.when(valid, F.col(f"h{k}.text")))
    path = F.substring(F.array_join(F.array_compact(F.array(*parts)), " > "), 1, 500)
    return rows.select(*paras.columns, "level", path.alias("section_path"))


def coalesce_short(chunks: DataFrame, min_size: int = 30) -> DataFrame:
    """Chunks ``doc_id, no, content`` under ``min_size`` join the one before, without anything between. What a
    short first one has gathered joins the next, if it is still short, under the next one's number."""
    doc = Window.partitionBy("doc_id")
    size = F.char_length("content")
    rows = chunks.withColumn("g", F.sum((size >= min_size).cast("int")).over(doc.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.sum(F.when(F.col("g") == 0, size).otherwise(0)).over(doc)
    rows = rows.withColumn("to", F.when((F.col("g") == 0) & (head < min_size) & (F.max("g").over(doc) > 0), 1).otherwise(F.col("g")))
    merged = rows.groupBy("doc_id", "to").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "content"))), lambda x: x["content"]), "").alias("content"),
        F.min(F.when(F.col("g") == F.col("to"), F.col("no"))).alias("first_no"), F.count("*").alias("n_merged"),
    )
    order = Window.partitionBy("doc_id").orderBy("to")
    return merged.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("no"), "first_no", "n_merged", "content")


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_SPLIT), lambda s: F.trim(s)), lambda s: s != "")


def marked_paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs of plain texts with ``is_heading`` and ``section_number``: short lines that are numbered or end no sentence."""
    from ragloom.operators.layout import SENTENCE_END, section_number
    from ragloom.sources.tables import paragraphs

    text = F.col("text")
    number = section_number(text)
    short = F.char_length(text) <= 60
    return paragraphs(docs).withColumn("section_number", number).withColumn("is_heading", short & ~text.rlike(SENTENCE_END) & (number.isNotNull() | (F.char_length(text) <= 30)))


def greedy_runs(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive runs (start, end) whose sizes add up to ``limit`` at most, or that have one element."""
    runs, start, load = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and load + size > limit:
            runs.append((start, i))
            start, load = i, 0
        load += size
    return [*runs, (start, len(sizes))] if sizes else []


def sentence_runs(sizes: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of sentences of ``limit`` characters at most, each starting with the last whole sentences of
    the run before: as many as ``overlap`` holds (half of ``limit`` at most), and one in any case."""
    carry = min(overlap, limit // 2) if overlap > 0 else -1
    runs, start, load = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and load + size > limit:
            runs.append((start, i))
            start, load = i, 0
            while carry >= 0 and start > runs[-1][0] and (start == i or load + sizes[start - 1] <= carry):
                start -= 1
                load += sizes[start]
        load += size
    return [*runs, (start, len(sizes))] if sizes else []


_SENTENCES = re.compile(r"(?<=[。！？；!?;])|(?<=\.)(?=\s+[A-Z])|\n+")


def _sentences(text: str) -> list[str]:
    return [x for x in (piece.strip() for piece in _SENTENCES.split(text)) if x]


def _parents(paragraphs: list[dict], parent_size: int) -> Iterator[tuple[str | None, list[tuple[str, int]]]]:
    """(section path, paragraphs (text, page)) of each parent: sections are cut apart, then packed; a paragraph
    over the size is cut by sentences into parents of its own."""
    cuts = [i for i, p in enumerate(paragraphs) if i == 0 or p["section"] != paragraphs[i - 1]["section"]]
    for a, b in zip(cuts, [*cuts[1:], len(paragraphs)], strict=True):
        part, path = paragraphs[a:b], paragraphs[a]["path"]
        loose: list[tuple[str, int]] = []
        for p in [*part, None]:
            if p is not None and len(p["text"]) <= parent_size:
                loose.append((p["text"], p["page"]))
                continue
            for x, y in greedy_runs([len(t) for t, _ in loose], parent_size):
                yield path, loose[x:y]
            loose = []
            if p is not None:
                pieces = _sentences(p["text"]) or [p["text"]]
                for x, y in greedy_runs([len(t) for t in pieces], parent_size):
                    yield path, [("".join(pieces[x:y]), p["page"])]


def _children(parent: list[tuple[str, int]], p: ChunkParams) -> list[tuple[int, str, int, int]]:
    """(number, content, first page, last page) of a parent's children; short ones are merged, keeping the number."""
    units = [(s, page) for text, page in parent for s in _sentences(text)]
    found = [("".join(s for s, _ in units[a:b]), units[a:b]) for a, b in sentence_runs([len(s) for s, _ in units], p.child_size, p.overlap)]
    if len(found) > 1 and found[-1][0].strip() == found[-2][0].strip():
        found.pop()  # nothing but what was carried over
    out: list[tuple[int, str, int, int]] = []
    for no, (content, own) in enumerate(found):
        pages = [page for _, page in own]
        if out and len(content) < p.min_size:
            before = out.pop()
            out.append((before[0], before[1] + content, min(before[2], *pages), max(before[3], *pages)))
        else:
            out.append((no, content, min(pages), max(pages)))
    if len(out) > 1 and len(out[0][1]) < p.min_size:
        one, two = out[:2]
        out[:2] = [(two[0], one[1] + two[1], min(one[2], two[2]), max(one[3], two[3]))]
    return out


CHUNK_FIELDS = [("chunk_type", pa.string()), ("parent_no", pa.int32()), ("child_no", pa.int32()), ("content", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("section_path", pa.string())]


def parent_child_chunks(paras: DataFrame, p: ChunkParams) -> DataFrame:
    """Parents and their overlapping children of ``paras`` (doc_id, seq, text, page_no, is_heading, section_number):
    ``doc_id, chunk_type, parent_no, child_no (null for parents), content, page_start, page_end, section_path, id,
    parent_id``. A parent is its paragraphs with an empty line between; children are sentences one after another."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = sections(paras).withColumn("section", F.sum(F.coalesce(F.col("is_heading"), F.lit(False)).cast("int")).over(order))
    row = F.struct("seq", "text", F.col("page_no").alias("page"), "section", F.col("section_path").alias("path"))
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = paras.schema["doc_id"].dataType
    fields = pa.schema([("doc_id", to_arrow_type(kind)), *CHUNK_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = []
                for no, (path, parent) in enumerate(_parents(batch.column(1)[i].as_py(), p.parent_size)):
                    pages = [page for _, page in parent]
                    made.append(("parent", no, None, "\n\n".join(t for t, _ in parent), min(pages), max(pages), path))
                    made += [("child", no, k, content, first, last, path) for k, content, first, last in _children(parent, p)]
                columns = [pa.array([m[k] for m in made], t) for k, (_, t) in enumerate(CHUNK_FIELDS)]
                ids = pa.repeat(batch.column(0)[i], len(made))
                yield pa.RecordBatch.from_arrays([ids, *columns], schema=fields)

    made = whole.mapInArrow(run, f"doc_id {kind.simpleString()}, chunk_type string, parent_no int, child_no int, content string, page_start int, page_end int, section_path string")
    parent = parent_chunk_id(F.col("doc_id"), F.col("parent_no"))
    child = F.col("chunk_type") == "child"
    return made.withColumn("id", F.when(child, chunk_id(F.col("doc_id"), F.col("parent_no"), F.col("child_no"))).otherwise(parent)).withColumn("parent_id", F.when(child, parent))


def parent_chunk_id(doc_id: Column, parent: Column) -> Column:
    return F.format_string("%s_p%04d", doc_id.cast("string"), parent)


def size_parents(chunks: DataFrame, parent_size: int = 1500) -> DataFrame:
    """Chunks ``doc_id, no, content`` of any strategy with the parent they are packed into, ``parent_no`` and
    ``child_no``: consecutive chunks up to ``parent_size`` characters. Blank chunks go, others are stripped."""
    rows = chunks.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).where("content <> ''")
    sizes = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", F.char_length("content").alias("size")))).alias("s"))
    kind = {f: chunks.schema[f].dataType.simpleString() for f in ("doc_id", "no")}
    number = to_arrow_type(chunks.schema["no"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py()
                places = [(own[k]["no"], no, k - a) for no, (a, b) in enumerate(greedy_runs([x["size"] for x in own], parent_size)) for k in range(a, b)]
                columns = [pa.repeat(batch.column(0)[i], len(places)), *(pa.array([x[k] for x in places], t) for k, t in enumerate((number, pa.int32(), pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "no", "parent_no", "child_no"])

    places = sizes.mapInArrow(run, f"doc_id {kind['doc_id']}, no {kind['no']}, parent_no int, child_no int")
    return rows.join(places, ["doc_id", "no"])


def chunk_id(doc_id: Column, parent: Column, child: Column) -> Column:
    return F.format_string("%s_p%04d_c%03d", doc_id.cast("string"), parent, child)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.char_length("content")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
        F.bround(F.avg(n), 1).alias("avg_chars"), F.median(n).alias("median_chars"),
    )


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Of parents and children together: counts, sizes, how much longer the children are than the parents, and
    the share of the children with a section (``expansion_ratio`` and ``heading_coverage``; 0 where there is nothing)."""
    n, child = F.char_length("content"), F.col("chunk_type") == "child"
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    headed = F.count_if(child & (F.coalesce("section_path", F.lit("")) != ""))
    return chunks.groupBy("doc_id").agg(
        F.count_if(~child).alias("parents"), F.count_if(child).alias("children"), F.bround(F.avg(F.when(child, n)), 1).alias("avg_chars"),
        ratio(F.sum(F.when(child, n)), F.sum(F.when(~child, n))).alias("expansion_ratio"), ratio(headed, F.count_if(child)).alias("heading_coverage"),
    )


def embedding_text(content: Column, section_path: Column) -> Column:
    """The section path before the content, unless that already starts with the leaf heading."""
    leaf = F.element_at(F.split(section_path, " > "), -1)
    return F.when((F.coalesce(section_path, F.lit("")) == "") | F.startswith(F.ltrim(content), leaf), content).otherwise(F.concat_ws("\n", section_path, content))


def page_ranges(spans: DataFrame, paras: DataFrame) -> DataFrame:
    """Pages of the paragraphs that each span overlaps: ``doc_id, no, page_start, page_end``."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("text") + 1).over(order), F.lit(0))
    placed = paras.select("doc_id", "page_no", at.alias("p_start"), (at + F.char_length("text")).alias("p_end"))
    hit = spans.join(placed, "doc_id").where("start < p_end and p_start < end")
    return hit.groupBy("doc_id", "no").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))


def overlap_spans(spans: DataFrame, overlap: int = 50, ratio: float = 0.5) -> DataFrame:
    """Spans ``doc_id, no, start, end`` but the first start earlier, by ``overlap`` or by ``ratio`` of the
    shortest span of the document, whichever is less, but each after the one before it."""
    doc = Window.partitionBy("doc_id")
    back = F.least(F.lit(overlap).cast("long"), F.floor(F.min(F.col("end") - F.col("start")).over(doc) * ratio))
    rank = F.row_number().over(doc.orderBy("no")) - 1
    rows = spans.select("*", back.alias("back"), rank.cast("long").alias("at"))
    wished = F.when(F.col("at") == 0, F.col("start").cast("long")).otherwise(F.col("start") - F.col("back"))
    # each start is one after the last at least: a running maximum of what is left when that one is taken off
    bound = F.max(wished - F.col("at")).over(doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) + F.col("at")
    return rows.withColumn("start", F.least(bound, F.col("start").cast("long"))).drop("back", "at")


def preview(chunks: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` chunks of each document and whether there are more (``truncated``)."""
    whole = Window.partitionBy("doc_id")
    return chunks.withColumn("truncated", F.max("no").over(whole) >= limit).where(F.col("no") < limit)


def nested_preview(chunks: DataFrame) -> DataFrame:
    """Parents of ``parent_child_chunks`` with the ordered ids of their children."""
    children = chunks.where("chunk_type = 'child'").groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("child_no", "id"))), lambda x: x["id"]).alias("child_ids"))
    parents = chunks.where("chunk_type = 'parent'").drop("parent_id", "child_no")
    nothing = F.array().cast("array<string>")
    return parents.join(children, parents["id"] == children["parent_id"], "left").drop("parent_id").withColumn("child_ids", F.coalesce("child_ids", nothing))


def stored_view(chunks: DataFrame) -> DataFrame:
    """Stored chunks as they are shown: whether the text that is embedded differs, and the size of the parent (0 without one)."""
    parents = chunks.where("chunk_type = 'parent'").select(F.col("id").alias("parent_id"), F.char_length("content").alias("parent_char_count"))
    differs = embedding_text(F.col("content"), F.col("section_path")) != F.col("content")
    rows = chunks.join(parents, "parent_id", "left").withColumn("parent_char_count", F.coalesce("parent_char_count", F.lit(0)))
    return rows.withColumn("embedding_differs", differs)


def alarms(chunks: DataFrame, sectioned: str | None = None) -> DataFrame:
    """``doc_id, alarm``: no chunk with a text, a text under 200 characters, chunks under 80 or over 600 on average,
    or, with the column ``sectioned``, over 60 % without a section."""
    mean = F.avg(F.char_length("content"))
    alarm = F.when(F.count_if(F.col("content") != "") == 0, "none").when(F.max("end") < 200, "too short").when(mean < 80, "small chunks").when(mean > 600, "large chunks")
    if sectioned:
        alarm = alarm.when(F.avg((F.coalesce(F.col(sectioned), F.lit("")) == "").cast("int")) > 0.6, "no sections")
    return chunks.groupBy("doc_id").agg(alarm.otherwise("fine").alias("alarm"))
