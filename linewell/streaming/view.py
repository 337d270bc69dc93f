"""The filtered view of followed logs: matches and marked lines, as they arrive.

Marks name lines by (file, epoch, byte_start), so the marks of a log that was truncated
or replaced drop out by themselves.  They are read anew for every batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from linewell.functions.patterns import Term, as_term, check_pattern, line_matches
from linewell.streaming.jobs import LOG, current_epoch, epochs_of
from linewell.streaming.source import POLL, SCHEMA

PLACE = [*LOG, "byte_start"]


def batch_view(batch: DataFrame, pattern: Term | str, marks: DataFrame, **options) -> DataFrame:
    """Lines that match or are marked, with ``item_type``; a line that is both is a MARK.

    ``batch`` holds followed lines, streaming or stored; marks are joined by key, on the
    side that Spark finds small.
    """
    term = as_term(pattern, **options)
    check_pattern(batch.sparkSession, term)
    flags = marks.select(*PLACE).distinct().withColumn("_marked", F.lit(True))
    flagged = batch.join(flags, PLACE, "left")
    marked, hit = F.col("_marked").isNotNull() & F.col("line").isNotNull(), line_matches("line", term)
    return flagged.filter(marked | hit).select(
        *batch.columns, F.when(marked, "MARK").otherwise("MATCH").alias("item_type"))


def follow_view(stream: DataFrame, pattern: Term | str, marks_path: str, out: str, **options) -> DataStreamWriter:
    """Writer that adds each batch's view below ``out``; read it with ``view_of``.

    ``marks_path`` is a Parquet folder of (file, epoch, byte_start) that others may write
    to meanwhile; it must exist.  A line gets the marks that are there when it arrives.  A batch that
    runs again replaces what it stored.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("file string, epoch bigint, byte_start bigint").parquet(marks_path)
        batch.persist()
        try:
            batch_view(batch, pattern, marks, **options).write.mode("overwrite").parquet(f"{out}/view/batch={batch_id}")
            epochs_of(batch).write.mode("overwrite").parquet(f"{out}/epochs/batch={batch_id}")
        finally:
            batch.unpersist()

    check_pattern(stream.sparkSession, as_term(pattern, **options))
    return stream.writeStream.foreachBatch(store).trigger(processingTime=POLL)


def view_of(spark: SparkSession, out: str) -> DataFrame:
    """The stored view of every log's current epoch, in the columns of followed lines and ``item_type``."""
    stored = spark.read.schema(f"{SCHEMA}, item_type string").parquet(f"{out}/view").drop("batch")
    epochs = spark.read.schema("file string, epoch bigint").parquet(f"{out}/epochs").drop("batch")
    return current_epoch(stored, epochs_of(epochs))
