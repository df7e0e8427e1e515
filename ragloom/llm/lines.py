"""Line de-duplication with a levelled ledger of sorted runs, in DataFrame functions only.

A run is an immutable table ``(key, n_docs, max_doc, seen)`` of line hashes, sorted by hash
within its files. A new batch of documents is merge-anti-joined with the runs: lines that
no run has are new there, and the others are counted on as ``seen``. Both make the batch's
run, of level 0; when a level has ``fanout`` runs they are merged into one of the next level,
so a batch meets a number of runs that grows with the logarithm of the batches. Runs
are published by Spark's commit, and merged runs replace their parts only afterwards, so
a job that is lost midway leaves the ledger as it was.

A line that was never seen again has all its count in the one row of its first batch; only
lines that an anti-join found again are added up over the runs.

Hot lines are counted with partial aggregates, and where lines meet the condemned keys
the rows of a common line are dealt over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import checkpointed, committed, free_name, hot_blocks, join_dealt, scratch_path

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(lines: Column) -> Column:
    """Each line without white space at its ends, A-Z lower-cased (``lower`` is that for ASCII).

    One array step after the other, as a lambda evaluates each mention of its expressions."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(WHITE)))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """128-bit hashes of the lines' keys, null for keys shorter than ``min_chars``."""
    return F.transform(line_keys(lines), lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k))))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: str) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


class LineLedger:
    """Levelled sorted runs under one folder; ``LineLedger(spark, path)`` reopens what is there."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3, min_chars: int = 20):
        self.spark, self.path, self.fanout, self.min_chars = spark, path or scratch_path(spark, "line-ledger"), fanout, min_chars

    def runs(self) -> list[tuple[int, int, int, str]]:
        """(level, first batch, last batch, path) of the committed runs that no committed merge has replaced."""
        found = [(*map(int, name.split("-")[1:]), path) for name, path in committed(self.spark, self.path).items() if name.startswith("run-")]
        alive = [r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]
        return sorted(alive, key=lambda r: r[1])

    def entries(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, row, pos, key)`` of the lines that are long enough."""
        hashes = line_hashes(split_lines(F.col(text_col).cast("string")), self.min_chars)
        rows = docs.select(F.col(id_col).alias("doc_id"), _row(text_col).alias("row"), F.posexplode(hashes).alias("pos", "key"))
        return rows.where("key is not null")

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds a batch of documents; its doc_ids must not be in earlier batches."""
        self.add_entries(self.entries(batch, id_col, text_col))

    def add_entries(self, entries: DataFrame) -> None:
        counted = self._counted(entries)
        if runs := self.runs():
            known = self._read(runs).select("key")
            fresh = counted.join(known, "key", "left_anti").withColumn("seen", F.lit(False))
            again = counted.join(known, "key", "left_semi").withColumn("seen", F.lit(True))
            counted = fresh.union(again)
        else:
            counted = counted.withColumn("seen", F.lit(False))
        no = max((r[2] for r in runs), default=-1) + 1
        counted.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/run-0-{no}-{no}")
        self._compact()

    def fresh(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(key, n_docs, max_doc)`` of a batch's lines that no run has yet."""
        counted, runs = self._counted(self.entries(batch, id_col, text_col)), self.runs()
        return counted.join(self._read(runs).select("key"), "key", "left_anti") if runs else counted

    def condemned(self, min_docs: int) -> DataFrame:
        """``(key, n_docs, max_doc)`` of the keys that at least ``min_docs`` documents hold."""
        rows = self._read(self.runs())
        again = rows.where("seen").select("key").distinct()
        alone = rows.where(F.col("n_docs") >= min_docs).join(again, "key", "left_anti").select("key", "n_docs", "max_doc")
        summed = self._merged(rows.join(again, "key", "left_semi")).where(F.col("n_docs") >= min_docs)
        return alone.union(summed.select("key", "n_docs", "max_doc"))

    @staticmethod
    def _counted(entries: DataFrame) -> DataFrame:
        """Documents that hold a key, counted by partial aggregates; a line that stands twice in one counts once."""
        held = entries.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        return held.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))

    def _read(self, runs: list[tuple[int, int, int, str]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(r[3]) for r in runs])

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        """One row for each key; it is ``seen`` if the key's first row isn't among ``rows``."""
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.min("seen").alias("seen"))

    def _compact(self) -> None:
        level = 0
        while len(same := [r for r in self.runs() if r[0] == level]) >= self.fanout:
            merged = self._merged(self._read(same)).sortWithinPartitions("key")
            merged.write.mode("overwrite").parquet(f"{self.path}/run-{level + 1}-{same[0][1]}-{same[-1][2]}")
            for r in same:
                old = self.spark._jvm.org.apache.hadoop.fs.Path(r[3])
                old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
            level += 1


def _mask(places: Column) -> Column:
    """Binary signs 0 and 1, 1 at each of the sorted ``places``."""
    gap = lambda p, k, own: p - F.when(k > 0, F.get(own, k - 1)).otherwise(F.lit(-1)) - 1
    signs = lambda own: F.array_join(F.transform(own, lambda p, k: F.concat(F.repeat(F.lit("0"), gap(p, k, own)), F.lit("1"))), "")
    # bound to a lambda's variable, the places are sorted once and not for each of them
    return F.get(F.transform(F.array(places), signs), F.lit(0)).cast("binary")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """``docs`` with the text's repeated lines gone and columns ``n_lines``, ``n_dropped`` added.

    Lines whose key has ``min_chars`` code points and stands in ``min_docs`` documents go from all
    documents but the one with the largest id. Rows of one id are one document; rows with a null id
    are never counted and lose nothing; a null or empty text is one empty line (and becomes an empty
    text). Repeated rows stay repeated. Columns of ``docs`` that are named like the added ones are
    replaced; all others are kept. The ledger takes the documents in ``batches`` by a hash of the id;
    the texts are read once for it and once for the result.
    """
    spark = docs.sparkSession
    ledger = LineLedger(spark, fanout=fanout, min_chars=min_chars)
    place = f"{ledger.path}/entries"
    entries = ledger.entries(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    entries.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(place)
    entries = spark.read.schema(entries.schema.add("batch", IntegerType())).parquet(place)
    for no in range(batches):
        ledger.add_entries(entries.where(F.col("batch") == no))
    condemned = checkpointed(ledger.condemned(min_docs))
    hot = hot_blocks(condemned.withColumnRenamed("n_docs", "n"), "key")
    lost = join_dealt(entries.drop("batch"), condemned.select("key", "max_doc"), "key", hot, ["doc_id", "pos"]).where("doc_id < max_doc")
    lost = lost.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("places"))
    whose, which, mask, count = (free_name(docs, stem) for stem in ("lost_from", "lost_row", "lost_mask", "lost_count"))
    lost = lost.select(F.col("doc_id").alias(whose), F.col("row").alias(which), _mask(F.array_sort("places")).alias(mask), F.size("places").alias(count))
    lines = split_lines(F.col(text_col).cast("string"))
    stays = F.filter(lines, lambda x, i: F.substring(mask, i + 1, F.lit(1)) != F.unhex(F.lit("31")))
    kept = F.array_join(F.when(F.col(mask).isNull(), lines).otherwise(stays), "\n")
    joined = docs.join(lost, (F.col(id_col) == F.col(whose)) & (_row(text_col) == F.col(which)), "left")
    added = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(count, F.lit(0)).cast("long"), text_col: kept}
    return joined.withColumns(added).drop(whose, which, mask, count)
