"""Lines from table columns, and the stored lines table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewell.operators.ordered import CHUNK, RANGE, chunk_of


def lines_from_table(df: DataFrame, key: Column | str, text: Column | str) -> DataFrame:
    """Split a text column at LF: one (file, line_no, line) row per line.

    ``key`` becomes the file name.  Text after the last LF is a line of its own
    unless it is empty; an empty text has no lines.  A narrow operation.
    """
    key = F.col(key) if isinstance(key, str) else key
    text = F.col(text) if isinstance(text, str) else text
    closed = F.endswith(text, F.lit("\n"))
    body = F.when(closed, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    whole = F.when(text != "", F.split(body, "\n", -1))
    return df.select(
        key.cast("string").alias("file"), F.posexplode(whole).alias("line_no", "line")
    ).select("file", F.col("line_no").cast("bigint").alias("line_no"), "line")


def write_lines_table(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store numbered lines as Parquet, in line order inside each output file.

    Scan tasks already hold consecutive lines, so there is no shuffle; the sort
    within a task keeps (file, line_no) row-group ranges narrow, which is what
    lets page and range reads skip row groups.
    """
    lines.sortWithinPartitions("file", "line_no").write.mode(mode).parquet(path)


def read_lines_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_ranged_table(lines: DataFrame, path: str, width: int = CHUNK) -> None:
    """Store numbered lines by ranges of ``width`` line numbers, or add lines to such a table.

    ``path/lines`` is partitioned by range and append, sorted by (file, line_no) in each
    file; ``path/ranges`` has a row for each file and range of an append.  Lines are not
    shuffled: scan tasks hold consecutive lines, so each writes few ranges.  Add complete
    lines only, each once.  An existing table keeps its width.
    """
    spark = lines.sparkSession
    batch = 0
    if (index := _ranges(spark, path)) is not None:
        last = index.agg(F.max("batch").alias("batch"), F.max("width").alias("width")).first()
        batch, width = last["batch"] + 1, last["width"]
        if not spark.read.parquet(f"{path}/lines").filter(F.col("batch") >= batch).isEmpty():
            raise ValueError(f"an append to {path} was cut off: remove its batch={batch} folders")
    placed = lines.withColumn(RANGE, chunk_of("line_no", width)).withColumn("batch", F.lit(batch))
    placed.sortWithinPartitions(RANGE, "file", "line_no").write.mode("append").partitionBy(RANGE, "batch").parquet(f"{path}/lines")
    added = spark.read.parquet(f"{path}/lines").filter(F.col("batch") == batch)
    added.groupBy("file", F.col(RANGE).cast("bigint").alias(RANGE)).agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"),
    ).select("*", F.lit(width).cast("bigint").alias("width"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{path}/ranges")


def _ranges(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/ranges")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_ranged_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a ranged table, with their range; pages and ranges of lines read the partitions they need."""
    index = _ranges(spark, path)
    if index is None:
        raise ValueError(f"no ranged table in {path}")
    width = index.select("width").first()
    lines = spark.read.parquet(f"{path}/lines").drop("batch")
    number = F.col(RANGE).cast("bigint").alias(RANGE, metadata={"width": width["width"] if width else CHUNK})
    return lines.select(*[c for c in lines.columns if c != RANGE], number)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_range, first_line, last_line, n_lines) of a ranged table."""
    return spark.read.parquet(f"{path}/ranges").groupBy("file", RANGE).agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("n_lines").alias("n_lines"))
