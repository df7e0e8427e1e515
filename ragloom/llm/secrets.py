"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger
keeps which path has which blob, which (blob, rule version) pairs have been scanned and
what was found; a new batch of versions scans only the pairs it hasn't, once for each
blob however many paths have it, and findings are joined back to all paths. It is
reopened from its folder: only what Spark committed counts as there.

Positions come from two scans with one regular expression: the matches, and the
pieces between them; a running sum of their lengths is a window over the few rows
that matches make, so a text with very many matches isn't folded in one cell.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import committed, hot_blocks, join_dealt, scratch_path, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and without overlaps; those whose ``group`` has fewer
    than ``min_chars`` characters fail. ``hint``: a text without this literal has none."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    hint: str = ""


# The kinds that are asked for, then those that this scanner adds.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "eyJ"),
)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = field(default=BASE_RULES + MORE_RULES)

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self.rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(no: int, rule: Rule) -> Column:
    """Array of (kind_no, gap, length, own): the text before each match, the match, and what is measured."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all("text", pattern, F.lit(0))
    held = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else hits

    def row(z: Column) -> Column:
        return F.struct(
            F.lit(no).alias("kind_no"),
            F.char_length(z["g"]).alias("gap"),
            F.char_length(z["h"]).alias("length"),
            F.char_length(z["o"]).alias("own"),
        )

    rows = F.transform(F.arrays_zip(hits.alias("h"), F.split("text", rule.pattern, -1).alias("g"), held.alias("o")), row)
    may = F.contains("text", F.lit(rule.hint)) if rule.hint else F.lit(True)
    return F.when(may & F.col("text").rlike(rule.pattern), rows)


def scan_blobs(blobs: DataFrame, rules: RuleSet) -> DataFrame:
    """``(blob, kind_no, start, end)`` of each finding in ``(blob, text)``; code points, end exclusive."""
    found = [_hits(no, rule) for no, rule in enumerate(rules.rules)]
    nothing = F.array().cast("array<struct<kind_no:int,gap:int,length:int,own:int>>")
    rows = blobs.select("blob", F.concat(*[F.coalesce(x, nothing) for x in found]).alias("rows")).where(F.size("rows") > 0)
    rows = rows.dropDuplicates(["blob"])  # a path's row may come repeatedly
    rows = rows.select("blob", F.posexplode("rows").alias("no", "r")).select("blob", "no", "r.*").where("length is not null")
    past = Window.partitionBy("blob", "kind_no").orderBy("no")
    least = F.create_map(*[F.lit(x) for no, rule in enumerate(rules.rules) for x in (no, rule.min_chars)])
    return (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(past))
        .where(F.col("own") >= least[F.col("kind_no")])
        .select("blob", "kind_no", (F.col("end") - F.col("length")).alias("start"), "end")
    )


class BlobLedger:
    """Scanned (blob, rule version) pairs and findings, appended batch by batch under one folder;
    ``BlobLedger(spark, path)`` goes on with what is there.

    A batch is a folder of its rule version. Its findings are written first and its pairs, whose
    commit publishes both, last: a batch that is lost between the two was never there, and its number
    is used again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rules: RuleSet | None = None):
        self.spark, self.path, self.rules = spark, path or scratch_path(spark, "blob-ledger"), rules or RuleSet()

    @property
    def _home(self) -> str:
        return f"{self.path}/{self.rules.version}"

    def batches(self) -> list[int]:
        """Numbers of the batches that this rule version has scanned."""
        return sorted(int(name.split("-")[1]) for name in committed(self.spark, f"{self._home}/scanned"))

    def scanned(self) -> DataFrame:
        """The blobs that this rule version has scanned."""
        paths = [f"{self._home}/scanned/batch-{no}" for no in self.batches()]
        return self.spark.read.schema("blob string").parquet(*paths) if paths else self.spark.createDataFrame([], "blob string")

    def findings(self) -> DataFrame:
        """``(blob, kind_no, start, end)`` of this rule version."""
        kind = "blob string, kind_no int, start long, end long"
        paths = [f"{self._home}/findings/batch-{no}" for no in self.batches()]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def paths(self) -> DataFrame:
        """``(path, blob)``: every content that any batch had at a path, each once, whatever the rule version."""
        kind = self._path_kind()
        if kind is None:
            return self.spark.createDataFrame([], "path string, blob string")
        stored = [p for _, p in sorted(committed(self.spark, f"{self.path}/paths").items())]
        return self.spark.read.schema(f"path {kind}, blob string").parquet(*stored).distinct()

    def _path_kind(self) -> str | None:
        stored = committed(self.spark, f"{self.path}/paths")
        return self.spark.read.parquet(next(iter(stored.values()))).schema["path"].dataType.simpleString() if stored else None

    def path_findings(self) -> DataFrame:
        """``(path, blob, kind_no, start, end)``: this rule version's findings at every path that ever had the blob. The paths of
        a blob that very many have are dealt over several tasks."""
        paths, found = self.paths(), self.findings()
        held = found.groupBy("blob").agg(F.collect_list(F.struct("kind_no", "start", "end")).alias("found"))
        hot = hot_blocks(paths.groupBy("blob").agg(F.count("*").alias("n")), "blob")
        return join_dealt(paths, held, "blob", hot, ["path"]).select("path", "blob", F.explode("found").alias("f")).select("path", "blob", "f.*")

    def add(self, versions: DataFrame, path_col: str, text_col: str, addresses: DataFrame | None = None) -> int:
        """Scans the blobs of a batch of versions that this rule version hasn't; returns their number.

        ``addresses``, ``(path, blob)`` of the same versions, saves reading their texts to address them."""
        rows = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        rows = rows.withColumn("blob", blob_id(F.col("text")))
        addresses = rows.select("path", "blob") if addresses is None else addresses.select("path", "blob")
        no = len(committed(self.spark, f"{self.path}/paths"))
        addresses.where("path is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/paths/batch-{no}")
        # one path stands for the blob; equal rows of one path are the same content
        first = addresses.groupBy("blob").agg(F.min(F.struct("path")).alias("path"))
        first = first.join(self.scanned(), "blob", "left_anti")
        no = max(self.batches(), default=-1) + 1
        pending = f"{self._home}/pending/batch-{no}"
        first.select(F.col("blob").alias("new_blob"), F.col("path.path").alias("new_path")).write.mode("overwrite").parquet(pending)
        first = self.spark.read.parquet(pending)
        unseen = rows.join(first, (F.col("blob") == F.col("new_blob")) & F.col("path").eqNullSafe(F.col("new_path")), "left_semi")
        scan_blobs(unseen, self.rules).write.mode("overwrite").parquet(f"{self._home}/findings/batch-{no}")
        first.select(F.col("new_blob").alias("blob")).write.mode("overwrite").parquet(f"{self._home}/scanned/batch-{no}")
        return first.count()


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 2,
    rules: RuleSet | None = None,
    ledger: BlobLedger | None = None,
) -> DataFrame:
    """``(doc_id, blob, spans)`` for each row of ``docs``; ``spans`` is an array of (kind, start, end)
    by start, then kind in the order of the rules. With a ``ledger``, what it has scanned isn't
    scanned again; the documents are added to it in ``batches`` by a hash of the id.

    Null text is empty and has no spans; a null id is a path like others; equal rows
    are returned as often as they come. Other columns of ``docs`` are not read.
    """
    ledger = ledger or BlobLedger(docs.sparkSession, rules=rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    paths = written(rows.select("doc_id", blob_id(F.col("text")).alias("blob"), batch.alias("batch")), "blob-paths")
    for no in range(batches):
        own = paths.where(F.col("batch") == no).select(F.col("doc_id").alias("path"), "blob")
        ledger.add(rows.where(batch == no), "doc_id", "text", own)
    names = F.array(*[F.lit(r.kind) for r in ledger.rules.rules])
    spans = ledger.findings().groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("s"))
    spans = spans.select("blob", F.transform("s", lambda x: F.struct(F.get(names, x["kind_no"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    hot = hot_blocks(paths.groupBy("blob").agg(F.count("*").alias("n")), "blob")
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    found = join_dealt(paths.drop("batch"), spans, "blob", hot, ["doc_id"], "left")
    return found.select("doc_id", "blob", F.coalesce("spans", nothing).alias("spans"))


def secrets_digest(found: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
