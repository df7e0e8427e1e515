"""Sources and sinks: Parquet tables, derived paragraphs and blocks, golden sets, keyed upserts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.session import ship_package

GOLDEN_SCHEMA = "id string, question string, reference_answer string, evidences array<string>, category string, source_pages array<int>, doc_ids array<string>"
#: Lines that stand for one page where a table has no pages of its own.
LINES_PER_PAGE = 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Non-empty lines of texts: ``doc_id, seq, text, page_no``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    rows = lines.select("doc_id", "seq", F.trim("line").alias("text"), (F.floor(F.col("seq") / LINES_PER_PAGE) + 1).cast("int").alias("page_no"))
    return rows.where("text <> ''")


def blocks(docs: DataFrame) -> DataFrame:
    """A layout block for each paragraph, two columns from the tenth line of a page on."""
    row = F.col("seq") % LINES_PER_PAGE
    right = (row >= 10).cast("int")
    return paragraphs(docs).select(
        "doc_id", "page_no", "seq", "text",
        (50.0 + 270.0 * right).alias("x0"), (60.0 + 30.0 * (row - 10 * right)).alias("y0"),
        (290.0 + 270.0 * right).alias("x1"), (80.0 + 30.0 * (row - 10 * right)).alias("y1"),
        F.when(F.char_length("text") <= 20, 14.0).when(F.char_length("text") <= 60, 11.0).otherwise(10.0).alias("font_size"),
    )


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSONL golden items; blank and ``//`` lines are skipped, a broken line fails the read and is told with its number."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line"))
    rows = whole.select((F.col("i") + 1).alias("no"), F.trim("line").alias("v")).where("v <> '' and not startswith(v, '//')")
    read = F.from_json("v", GOLDEN_SCHEMA)
    broken = F.raise_error(F.concat(F.lit("golden set, line "), F.col("no").cast("string"), F.lit(" is no item")))
    named = F.from_json("v", "map<string,string>")
    items = rows.select(F.when(named.isNull() | named["question"].isNull(), broken).otherwise(read).alias("g")).select("g.*")
    return items.withColumn("evidences", F.filter(F.coalesce("evidences", F.array().cast("array<string>")), lambda e: F.trim(e) != ""))


def write_golden(items: DataFrame, path: str) -> None:
    items.select(F.to_json(F.struct(*items.columns)).alias("value")).write.mode("overwrite").text(path)


def read_uploads(spark: SparkSession, path: str, max_bytes: int = 50 << 20) -> DataFrame:
    """Binary files with content hash and validity: extension, magic number, size."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", "content", F.md5("content").alias("file_md5"))
    return rows.withColumn("valid", is_pdf(F.col("path"), F.col("content")) & F.col("length").between(1, max_bytes))


def pdf_reader() -> Callable[[bytes], dict]:
    """A reader for ``read_blocks``, where a PDF library is installed (PyMuPDF); raises ImportError elsewhere."""
    import fitz

    def read(content: bytes) -> dict:
        with fitz.open(stream=content, filetype="pdf") as document:
            if document.needs_pass:
                raise ValueError("encrypted")
            pages = []
            for page in document:
                try:
                    told = page.get_text("dict")
                except Exception:  # noqa: BLE001, S112 - one bad page is passed over
                    continue
                blocks = []
                for b in told["blocks"]:
                    spans = [span for line in b.get("lines", []) for span in line["spans"]]  # image blocks have no lines
                    text = "\n".join("".join(span["text"] for span in line["spans"]) for line in b.get("lines", []))
                    if text.strip():
                        blocks.append((*b["bbox"], max(span["size"] for span in spans), text))
                pages.append((page.number + 1, told["width"], blocks))
            return {"metadata": dict(document.metadata or {}), "pages": pages}

    return read


BLOCKS = "doc_id string, page_no int, page_width double, seq int, x0 double, y0 double, x1 double, y1 double, font_size double, text string, metadata map<string,string>, error string"


def read_blocks(files: DataFrame, reader: Callable[[], Callable[[bytes], dict]] = pdf_reader) -> DataFrame:
    """Layout blocks of binary files (path, content), by a ``reader`` that is made once for each task and gives
    ``{"metadata": .., "pages": [(page_no, width, [(x0, y0, x1, y1, font_size, text), ..]), ..]}``. A file that can't be
    read has one row with its ``error``; metadata keeps what isn't empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    told = read(bytes(content))
                except Exception as e:  # noqa: BLE001 - told in the row
                    yield pd.DataFrame([(path, *[None] * 10, f"{type(e).__name__}: {e}"[:2000])], columns=names)
                    continue
                metadata = {k: str(v) for k, v in told["metadata"].items() if v}
                rows, seq = [], 0
                for page_no, width, blocks in told["pages"]:
                    for x0, y0, x1, y1, size, text in blocks:
                        rows.append((path, page_no, width, seq, x0, y0, x1, y1, size, text, metadata, None))
                        seq += 1
                yield pd.DataFrame(rows or [(path, *[None] * 9, metadata, "no text")], columns=names)

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def is_pdf(path: Column, content: Column) -> Column:
    return (F.lower(F.element_at(F.split(path, r"\."), -1)) == "pdf") & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


FRONT = r"(?s)\A\x{feff}?---\s*\n(.*?)\n---[^\n]*\n?(.*)\z"


def front_matter(text: Column) -> Column:
    """``key: value`` lines of a front matter as a map, comments cut off; null without one."""
    head = F.regexp_extract(text, FRONT, 1)
    lines = F.filter(F.transform(F.split(head, "\n"), lambda x: F.trim(x)), lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(":")))

    def entry(line: Column) -> Column:
        value = F.trim(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
        bare = F.when(value.rlike("^['\"]"), F.regexp_replace(value, "^(['\"])(.*)\\1.*$", "$2")).otherwise(F.trim(F.regexp_extract(value, r"^([^#]*)", 1)))
        return F.struct(F.trim(F.regexp_extract(line, r"^([^:]*)", 1)).alias("k"), bare.alias("v"))

    last = F.transform(lines, entry)
    # of repeated keys the last one counts
    kept = F.filter(last, lambda x, i: ~F.exists(F.slice(last, i + 2, F.greatest(F.lit(1), F.size(last))), lambda y: y["k"] == x["k"]))
    return F.when(text.rlike(FRONT), F.map_from_entries(kept))


def list_of(value: Column) -> Column:
    """Items of ``[a, b]`` or ``a, b``, without quotes and blanks."""
    inner = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, "[,，]"), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """``SKILL.md`` files: path, id, name, description, tags, max_follow_up, max_turns, require_evidence, allow_finish,
    body, error. A file that can't be read as a skill keeps its row and says why; of equal ids the first path is good."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="SKILL.md").withColumn("path", F.input_file_name())
    m = F.col("m")
    pick = lambda key: F.coalesce(m[key], F.lit(""))
    rows = rows.select("path", "value", front_matter(F.col("value")).alias("m"))
    number = lambda key, default: F.when(pick(key) == "", F.lit(default)).otherwise(pick(key).try_cast("int")).alias(key)
    flag = lambda key, default: F.when(pick(key) == "", F.lit(default)).when(F.lower(pick(key)).isin("true", "yes", "on", "1"), True).when(F.lower(pick(key)).isin("false", "no", "off", "0"), False).alias(key)
    rows = rows.select(
        "path", pick("id").alias("id"), pick("name").alias("name"), pick("description").alias("description"), list_of(m["tags"]).alias("tags"),
        number("max_follow_up", 3), number("max_turns", 20), flag("require_evidence", False), flag("allow_finish", True),
        F.trim(F.regexp_extract("value", FRONT, 2)).alias("body"), m.isNull().alias("bare"),
    )
    first = Window.partitionBy(F.when(F.col("id") != "", F.col("id")).otherwise(F.col("path"))).orderBy("path")
    again = F.row_number().over(first) > 1
    error = (
        F.when(F.col("bare"), "no front matter").when(F.col("id") == "", "no id").when(again, "repeated id").when(F.col("body") == "", "no body")
        .when(F.col("max_follow_up").isNull() | F.col("max_turns").isNull(), "not a number").when(F.col("require_evidence").isNull() | F.col("allow_finish").isNull(), "not a flag")
        .when(~F.col("max_follow_up").between(1, 10), "max_follow_up out of range").when(~F.col("max_turns").between(3, 100), "max_turns out of range")
    )
    return rows.withColumn("error", error).drop("bare")


def good_skills(skills: DataFrame) -> DataFrame:
    return skills.where("error is null")


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with their keys."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def vectors_of(vectors: DataFrame, doc_ids: list) -> DataFrame:
    """The vectors of some documents, in order of their ids."""
    return vectors.where(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False)).orderBy("doc_id", "id")


def lookup(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows with the ids that are asked for, once each."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def stored_chunks(chunks: DataFrame, doc_id, limit: int | None = None, parents: bool = False) -> DataFrame:
    """A document's chunks in order; the parents among them only if asked for."""
    rows = chunks.where(F.col("doc_id") == doc_id)
    rows = rows if parents else rows.where("chunk_type = 'child'")
    rows = rows.orderBy("order_index", "chunk_type", "id")
    return rows if limit is None else rows.limit(limit)


def replace_documents(current: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``current`` with all rows of the documents of ``new`` replaced by theirs."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_by_document(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes rows in folders by a hash of their document; folders that the rows touch are replaced, so the rows
    must hold all of such a folder (see ``replace_documents``)."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def strip_nulls(metadata: Column) -> Column:
    """A map without its null and empty entries."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def merged_options(defaults: Column, given: Column) -> Column:
    """Options with those that are given (not null) in place of the defaults."""
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.map_filter(F.coalesce(given, nothing), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)


def read_overrides(path: str, known: set[str]) -> dict:
    """A JSON file of settings: unknown names are left out, and a missing or broken file is empty."""
    try:
        told = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in told.items() if k in known} if isinstance(told, dict) else {}


def write_overrides(path: str, settings: dict) -> None:
    """Replaces the file in one step."""
    fresh = Path(f"{path}.new")
    fresh.write_text(json.dumps(settings, ensure_ascii=False, indent=2), encoding="utf-8")
    fresh.replace(path)


def synthetic_documents(spark: SparkSession, n: int, seed: int, words: int = 40) -> DataFrame:
    """``doc_id, text``: sentences whose words are picked by a hash of seed, row and place; the same for every run."""
    nouns = ("pump", "valve", "motor", "sensor", "filter", "panel", "cable", "switch", "board", "frame", "wheel", "shaft", "gear", "pipe", "tank", "lamp")
    pick = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), i.cast("string"))), 1, 1), 16, 10).cast("int")
    told = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.get(F.array(*[F.lit(w) for w in nouns]), pick(i)))
    return spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(told, " ").alias("text"))


def zipped(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows with what stands at the same place of another table: joined by the place's number, one to one."""
    return rows.join(vectors, key)
