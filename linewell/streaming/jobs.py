"""Jobs on followed lines: search, running counts, numbering, batch status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from linewell.functions.patterns import Term, as_term, check_pattern, line_matches
from linewell.functions.text import visible_length
from linewell.operators.ordered import chunk_of, dense_index
from linewell.operators.search import search
from linewell.streaming.source import POLL

LOG = ("file", "epoch")
# Bytes of a file per numbering chunk of a micro-batch.
CHUNK_BYTES = 256 << 20

COUNTER = "file string, epoch bigint, lines bigint"


def follow_search(stream: DataFrame, pattern: Term | str, **options) -> DataFrame:
    """Matching lines as they arrive.  Stateless; use append mode."""
    return search(stream, pattern, **options)


def follow_counts(stream: DataFrame, pattern: Term | str, **options) -> DataFrame:
    """Running lines, matches and longest line per (file, epoch).

    Use update or complete mode.  Counts are combined per task before the
    state store sees them.  Feed it complete lines, not partial ones.
    """
    term = as_term(pattern, **options)
    check_pattern(stream.sparkSession, term)
    return stream.groupBy(*LOG).agg(
        F.count("line").alias("n_lines"),
        F.count_if(line_matches("line", term)).alias("n_matches"),
        F.max(visible_length("line")).alias("max_length"),
    )


def latest_lines(received: DataFrame) -> DataFrame:
    """One row per line of everything received: partial versions give way to longer ones.

    Complete lines arrive once and pass through unshuffled.  A file has at most
    one open line, behind its last complete one.
    """
    complete = received.filter("terminated")
    ends = complete.groupBy(*LOG).agg(F.max("byte_end").alias("_done"))
    row = F.struct(*received.columns)
    newest = (
        received.filter("NOT terminated")
        .groupBy(*LOG).agg(F.max_by(row, "byte_end").alias("_row"))
        .join(ends, [*LOG], "left")
    )
    is_open = F.col("_row.byte_start") >= F.coalesce("_done", F.lit(0))
    return complete.unionByName(newest.filter(is_open).select("_row.*"))


def losses(received: DataFrame) -> DataFrame:
    """(file, epoch, byte_start, byte_end) of planned ranges that were gone before they were read."""
    return received.filter("line IS NULL").select(*LOG, "byte_start", "byte_end")


def current_epoch(df: DataFrame, epochs: DataFrame) -> DataFrame:
    """Rows (lines, matches, marks) of each file's current epoch only.

    ``epochs`` has one (file, epoch) row per file, see ``epochs_of``.  The join is
    on both columns, so earlier epochs drop out.  Rows with a ``byte_start`` are joined
    chunk by chunk, so that a file that holds most rows spreads over tasks.
    """
    if "byte_start" not in df.columns:
        return df.join(epochs.select(*LOG), [*LOG], "left_semi")
    keyed = df.withColumn("_chunk", chunk_of("byte_start", CHUNK_BYTES))
    current = keyed.select(*LOG, "_chunk").distinct().join(epochs.select(*LOG), [*LOG], "left_semi")
    return keyed.join(current, [*LOG, "_chunk"], "left_semi").drop("_chunk")


def epochs_of(received: DataFrame) -> DataFrame:
    """The newest epoch of each file."""
    return received.groupBy("file").agg(F.max("epoch").alias("epoch"))


def number_batch(batch: DataFrame, before: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Add ``line_no`` to a batch, given the (file, epoch, lines) already numbered."""
    ranked = dense_index(batch, "_rank", by=LOG, order="byte_start", chunk=chunk)
    # The counters are repeated per chunk, so one hot file spreads over tasks.
    keyed = ranked.withColumn("_chunk", chunk_of("byte_start", chunk))
    known = keyed.select(*LOG, "_chunk").distinct().join(before, [*LOG], "left")
    return (
        keyed.join(known, [*LOG, "_chunk"], "left")
        .withColumn("line_no", F.col("_rank") + F.coalesce("lines", F.lit(0)))
        .drop("_rank", "_chunk", "lines")
    )


def follow_numbered(stream: DataFrame, out: str, counters: str) -> DataStreamWriter:
    """Writer that stores every batch with running line numbers per (file, epoch).

    Lines go to ``out/batch=<id>``, the counters after that batch to
    ``counters/batch=<id>``.  Both are overwritten when a batch is retried, so
    each line is stored once.  Read the lines with ``spark.read.parquet(out)``.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            before = spark.createDataFrame([], COUNTER)
        else:  # counters that are gone must fail: numbers would begin again at 0
            before = spark.read.schema(COUNTER).parquet(f"{counters}/batch={batch_id - 1}")
        batch.persist()  # the plan uses it thrice
        try:
            number_batch(batch.filter("line IS NOT NULL"), before).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()
        written = spark.read.schema("file string, epoch bigint").parquet(f"{out}/batch={batch_id}")
        added = written.groupBy(*LOG).agg(F.count("*").alias("lines"))
        after = before.unionByName(added).groupBy(*LOG).agg(F.sum("lines").alias("lines"))
        after.write.mode("overwrite").parquet(f"{counters}/batch={batch_id}")

    return stream.writeStream.foreachBatch(store).trigger(processingTime=POLL)


# What a batch brought.
OLD_DATA, NEW_DATA, NEW_FILTERED_DATA = "OLD_DATA", "NEW_DATA", "NEW_FILTERED_DATA"


def follow_status(stream: DataFrame, pattern: Term | str, out: str, **options) -> DataStreamWriter:
    """Writer that stores one row (batch_id, status) for every batch, below ``out``.

    New matches outrank new lines.  A retried batch overwrites its row, and no row is
    ever dropped.  Read them with ``batch_status``.
    """
    term = as_term(pattern, **options)
    check_pattern(stream.sparkSession, term)

    def store(batch: DataFrame, batch_id: int) -> None:
        seen = batch.agg(
            F.count("line").alias("lines"), F.count_if(line_matches("line", term)).alias("matches"))
        status = F.when(F.col("matches") > 0, NEW_FILTERED_DATA).when(
            F.col("lines") > 0, NEW_DATA).otherwise(OLD_DATA)
        row = seen.select(F.lit(batch_id).cast("bigint").alias("batch_id"), status.alias("status"))
        row.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(store).trigger(processingTime=POLL)


def batch_status(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, status) of all batches that ``follow_status`` has stored in ``out``."""
    stored = spark.read.schema("batch_id bigint, status string").parquet(out)
    return stored.select("batch_id", "status")
