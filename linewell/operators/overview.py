"""Density overview: matches and marks counted in ``height`` buckets over a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.operators.ordered import CHUNK, attach_per_file

# Fixed value: a bucket has this many shades.
WEIGHT_STEPS = 3


def overview(
    items: DataFrame, total: int | DataFrame, height: int, chunk: int = CHUNK
) -> DataFrame:
    """(file, kind, bucket, n, weight, opacity, first_line) of a filtered view.

    ``total`` is the number of lines: one number for all files, or a
    (file, n_lines) table.  Files of no lines give nothing.
    """
    if isinstance(total, int):
        sized = items.withColumn("n_lines", F.lit(total).cast("bigint"))
    else:
        per_file = total.select("file", F.col("n_lines").cast("bigint").alias("n_lines"))
        sized = attach_per_file(
            items, per_file.filter("n_lines > 0").withColumn("_last", F.col("n_lines") - 1),
            "_last", chunk=chunk,
        )
    height_col = F.lit(height).cast("bigint")
    bucket = F.call_function("div", F.col("line_no") * height_col, F.col("n_lines"))
    counted = (
        sized.filter("n_lines > 0")
        .groupBy("file", F.col("item_type").alias("kind"), bucket.cast("int").alias("bucket"))
        .agg(F.count("*").alias("n"), F.max("n_lines").alias("n_lines"))
    )
    weight = F.least(F.col("n"), F.lit(WEIGHT_STEPS)) - 1
    first = F.call_function("div", F.col("bucket") * F.col("n_lines"), height_col)
    return counted.select(
        "file", "kind", "bucket", "n", weight.cast("int").alias("weight"),
        ((weight + 1) / F.lit(float(WEIGHT_STEPS))).alias("opacity"),
        first.alias("first_line"),
    )
