"""Helpers every operator of this subpackage shares: tables, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a folder of its own, which is
    recorded in the session so that later calls agree; on a cluster it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ragloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/ragloom/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    For narrow rows only (ids, hashes, labels): checkpoint files are not compressed.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name and path of the tables under ``folder`` whose writing job was committed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = [status.getPath() for status in files.listStatus(root)]
    return {path.getName(): path.toString() for path in found if files.exists(hadoop.Path(path, "_SUCCESS"))}


def hot_blocks(counts: DataFrame, key: str, most: int = 1024, total: int | None = None) -> DataFrame | None:
    """``(key, blocks)`` of the keys that have over ``most`` rows and over a thousandth of all by ``(key, n)``; None without any.

    Under a thousand keys can, so the list is bounded: it is collected and broadcast. ``total``: all rows, if known."""
    total = total if total is not None else counts.agg(F.sum("n")).first()[0] or 0
    most = max(most, -(-total // 1000))
    hot = counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def join_dealt(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, spread: list[str], how: str = "inner") -> DataFrame:
    """Join of ``many`` with ``one``, which has one row for a key; the rows of a key of ``hot`` are dealt
    over its blocks by the columns ``spread``, and the other side's row goes to each of them."""
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    block = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("blocks")), F.lit(0)).cast("int")
    dealt = many.join(hot, key, "left").withColumn("block", block).drop("blocks")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return dealt.join(one.join(hot, key, "left").withColumn("block", every).drop("blocks"), [key, "block"], how).drop("block")


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that few long texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
