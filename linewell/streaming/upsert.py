"""Followed lines stored so that an open line gives way at once to its longer version.

Complete lines never change: each batch adds them.  Open lines, at most one a file and
epoch, live in buckets by file and epoch; a batch rewrites the buckets that it touches, as new
versions beside the last ones.  So a batch costs what it brings and the open lines of its
buckets, whatever was received before.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from linewell.streaming.jobs import LOG
from linewell.streaming.source import POLL, SCHEMA

BUCKETS = 32
_VERSIONED = f"{SCHEMA}, bucket int, batch bigint"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*LOG), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers N of the folders ``prefix=N`` in a folder, in order; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = (status.getPath().getName() for status in system.listStatus(folder))
    return sorted(int(name.partition("=")[2]) for name in names if name.startswith(f"{prefix}="))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _open_lines(spark: SparkSession, out: str, newest: dict[int, int]) -> DataFrame:
    """The open lines in the given version of each bucket."""
    paths = [f"{out}/open/bucket={b}/batch={v}" for b, v in newest.items()]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    # An empty bucket has a row without a file, as Spark stores no empty partitions.
    return spark.read.schema(_VERSIONED).option("basePath", f"{out}/open").parquet(*paths).filter(
        "file IS NOT NULL").drop("bucket", "batch")


def upsert_batch(batch: DataFrame, batch_id: int, out: str, buckets: int = BUCKETS) -> None:
    """Store one batch of followed lines (``emit_partial``); running it again replaces what it stored."""
    spark = batch.sparkSession
    columns = [f.name for f in batch.schema]
    touched = sorted(r[0] for r in batch.select(_bucket(buckets)).distinct().collect())  # at most ``buckets``
    if not touched:
        return
    # Rows of ranges that were gone (``losses``) are kept among the complete lines.
    batch.filter("terminated IS NULL OR terminated").write.mode("overwrite").parquet(f"{out}/lines/batch={batch_id}")
    newest = {}
    for b in touched:
        versions = [v for v in _folders(spark, f"{out}/open/bucket={b}", "batch") if v < batch_id]
        for old in versions[:-1]:  # the batch after them is committed
            _delete(spark, f"{out}/open/bucket={b}/batch={old}")
        if versions:
            newest[b] = versions[-1]
    ends = batch.filter("terminated").groupBy(*LOG).agg(F.max("byte_end").alias("_done"))
    candidates = _open_lines(spark, out, newest).select(columns).unionByName(batch.filter("NOT terminated"))
    longest = candidates.groupBy(*LOG).agg(F.max_by(F.struct(*columns), "byte_end").alias("_row")).join(ends, [*LOG], "left")
    still = longest.filter(F.col("_row.byte_start") >= F.coalesce("_done", F.lit(0))).select("_row.*").withColumn("bucket", _bucket(buckets))
    empty = spark.createDataFrame([(b,) for b in touched], "bucket int")
    rows = still.unionByName(empty, allowMissingColumns=True).withColumn("batch", F.lit(batch_id).cast("bigint"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket", "batch").parquet(f"{out}/open")


def follow_upsert(stream: DataFrame, out: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Writer that keeps the current lines of a stream with partial lines below ``out``; read them with ``upserted``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the plans use it four times
        try:
            upsert_batch(batch, batch_id, out, buckets)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(store).trigger(processingTime=POLL)


def upserted(spark: SparkSession, out: str) -> DataFrame:
    """One row a line of everything stored: ``latest_lines``, without reading what was replaced."""
    received = _stored(spark, out, _folders(spark, f"{out}/lines", "batch"))
    newest = {}
    for b in _folders(spark, f"{out}/open", "bucket"):
        newest[b] = _folders(spark, f"{out}/open/bucket={b}", "batch")[-1]
    return received.filter("terminated").unionByName(_open_lines(spark, out, newest))


def upserted_losses(spark: SparkSession, out: str) -> DataFrame:
    """(file, epoch, byte_start, byte_end) of ranges that were gone before they were read."""
    received = _stored(spark, out, _folders(spark, f"{out}/lines", "batch"))
    return received.filter("line IS NULL").select(*LOG, "byte_start", "byte_end")


def _stored(spark: SparkSession, out: str, batches: Iterable[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{out}/lines").drop("batch")
