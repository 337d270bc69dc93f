"""Generated corpora: numbered lines from a format string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def format_lines(df: DataFrame, number: str, fmt: str, file: str) -> DataFrame:
    """A line per row: ``fmt`` (printf style, one integer) of its ``number`` column."""
    return df.select(
        F.lit(file).alias("file"),
        F.col(number).cast("bigint").alias("line_no"),
        F.format_string(fmt, F.col(number)).alias("line"),
    )


def synth_lines(
    spark: SparkSession, n: int, fmt: str, file: str = "synthetic", partitions: int | None = None
) -> DataFrame:
    """``n`` generated lines, the i-th being ``fmt`` of i."""
    return format_lines(spark.range(0, n, 1, partitions), "id", fmt, file)
