"""Running totals and nearest-neighbour lookups along the line order of a file.

A window over a whole file would put that file into one task.  Here each file
is cut into chunks of ``CHUNK`` consecutive order values.  Rows are shuffled by
(file, chunk); a window works inside a chunk, and one summary row per chunk,
pre-aggregated before its shuffle, carries the result across chunks.  A file of
10^11 lines has some 10^5 summary rows, so the carry window stays small while
no task sees more than one chunk of lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.shared import fresh_path

# Order values per chunk; the size bound of every window partition over lines.
CHUNK = 1 << 20

FILE = ("file",)


def chunk_of(order: Column | str, size: int = CHUNK) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.call_function("div", order, F.lit(size))


def _keys(df: DataFrame, by: Sequence[str], order: str, size: int) -> DataFrame:
    return df.withColumn("_chunk", chunk_of(order, size))


def running_total(
    df: DataFrame,
    value: Column,
    out: str,
    by: Sequence[str] = FILE,
    order: str = "line_no",
    tie: Sequence[Column] = (),
    total_out: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its file.

    ``tie`` orders rows with equal ``order``.  ``total_out`` adds the sum over the
    whole file.
    """
    by = list(by)
    keyed = _keys(df.withColumn("_value", value.cast("bigint")), by, order, chunk)
    inside = (
        Window.partitionBy(*by, "_chunk").orderBy(order, *tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = keyed.withColumn("_local", F.sum("_value").over(inside))

    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = keyed.groupBy(*by, "_chunk").agg(F.sum("_value").alias("_sum"))
    added = [F.sum("_sum").over(earlier).alias("_carry")]
    if total_out:
        added.append(F.sum("_sum").over(Window.partitionBy(*by)).alias(total_out))
    carry = carry.select(*by, "_chunk", *added)

    zero = F.lit(0).cast("bigint")
    total = F.coalesce(F.col("_local"), zero) + F.coalesce(F.col("_carry"), zero)
    same = [local[c].eqNullSafe(carry[c]) for c in (*by, "_chunk")]
    extra = [total_out] if total_out else []
    return local.join(carry, same).select(*[local[c] for c in df.columns], *extra, total.alias(out))


def dense_index(
    df: DataFrame,
    out: str,
    by: Sequence[str] = FILE,
    order: str = "line_no",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... along ``order`` within each file."""
    return running_total(df, F.lit(1), out, by, order, chunk=chunk)


# Partition column of lines tables laid out by ranges of line numbers.
RANGE = "line_range"


def in_ranges(lines: DataFrame, lo: int, hi: int) -> Column:
    """True for the partitions of a table laid out by ranges that can hold lines ``lo .. hi``; else always true."""
    width = range_width(lines)
    return F.col(RANGE).between(lo // width, hi // width) if width else F.lit(True)


def range_width(lines: DataFrame) -> int:
    """Lines a range of a table laid out by ranges; 0 for any other table."""
    return lines.schema[RANGE].metadata.get("width", 0) if RANGE in lines.columns else 0


# Order values per piece of the summary of ``total_in_place``.
PIECE = 1 << 14


def total_in_place(
    df: DataFrame,
    out: str,
    value: Column | None = None,
    by: Sequence[str] = FILE,
    order: str = "line_no",
    chunk: int = PIECE,
) -> DataFrame:
    """``running_total`` that moves no row: add ``out``, the sum of ``value`` (none: the count) before this row.

    For tables whose tasks hold stretches of consecutive rows, as scans and stored tables
    do.  The rows are stored once, sorted within their tasks, with their running total
    inside the task; only counts by (file, piece, task) are shuffled.  Their prefix sums, one row a
    stretch, are joined to the rows.  Where two tasks hold rows of a file in turn, the
    rows are shuffled by ``running_total`` instead; the answer is the same.

    ``value`` must not be negative; ``order`` is unique within a file.
    """
    by, spark = list(by), df.sparkSession
    path = fresh_path(spark, "in-place")
    placed = df if value is None else df.withColumn("_value", value.cast("bigint"))
    placed = placed.sortWithinPartitions(*by, order)
    if value is not None:
        placed = _with_running_sum(placed)
    # The upper bits of the row id name the task, the lower ones count its rows.
    placed.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright("_id", 33))
    position = F.col("_id") if value is None else F.col("_running")
    pieces = rows.groupBy(*by, "_task", chunk_of(order, chunk).alias("_piece")).agg(
        F.count("*").alias("_n") if value is None else F.sum("_value").alias("_n"), F.min(position).alias("_first"),
        F.min(order).alias("_low"), F.max(order).alias("_high"))
    along = Window.partitionBy(*by).orderBy("_low", "_high")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    marked = pieces.select(
        *by, "_task", "_first", "_low", "_high", F.coalesce(F.sum("_n").over(earlier), zero).alias("_before"),
        (F.max("_high").over(earlier) >= F.col("_low")).alias("_crossed"),
        F.coalesce(F.lag("_task").over(along) != F.col("_task"), F.lit(True)).cast("int").alias("_new"))
    stretched = marked.withColumn("_stretch", F.sum("_new").over(along))
    stretches = stretched.groupBy(*by, "_task", "_stretch").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_first").alias("_first"),
        F.min("_before").alias("_before"), F.bool_or("_crossed").alias("_crossed"))
    table = fresh_path(spark, "stretches")
    stretches.drop("_stretch").write.parquet(table)
    stretches = spark.read.parquet(table)
    if stretches.filter("_crossed").head(1):
        total = F.lit(1) if value is None else F.col("_value")
        return running_total(rows.drop("_task"), total, out, by, order).select(*df.columns, out)
    sums = stretches.select(*by, "_task", "_low", "_high", (F.col("_before") - F.col("_first")).alias("_shift"))
    inside = [rows[c].eqNullSafe(sums[c]) for c in by] + [
        rows["_task"] == sums["_task"], rows[order].between(sums["_low"], sums["_high"])]
    return rows.join(sums, inside).select(*[rows[c] for c in df.columns], (position + F.col("_shift")).alias(out))


def _with_running_sum(df: DataFrame) -> DataFrame:
    """Add ``_running``: the sum of ``_value`` over the task's rows before this one."""
    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = 0
        for batch in batches:
            total = pc.add(pc.cumulative_sum(pc.fill_null(batch.column("_value"), 0)), carry)
            before = pc.subtract(total, pc.fill_null(batch.column("_value"), 0))
            carry = total[-1].as_py() if batch.num_rows else carry
            yield pa.RecordBatch.from_arrays([*batch.columns, before], names=[*batch.schema.names, "_running"])

    return df.mapInArrow(running, T.StructType([*df.schema.fields, T.StructField("_running", T.LongType())]))


def nearest(
    df: DataFrame,
    present: Column,
    payload: Sequence[str],
    direction: str,
    out: str,
    by: Sequence[str] = FILE,
    order: str = "line_no",
    tie: Column | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``out``: ``struct(order, *payload)`` of the nearest item row of the file.

    Item rows are those where ``present`` holds.  ``direction`` is "before" or
    "after"; the row itself never counts.  Rows of equal ``order`` are visited in
    ascending ``tie`` (a boolean or number) when looking before, and in the same
    sense when looking after, so an item with a higher tie than the row is not
    yet seen in either direction.
    """
    if direction not in ("before", "after"):
        raise ValueError("direction must be 'before' or 'after'")
    by, payload = list(by), list(payload)
    before = direction == "before"
    keyed = _keys(df.withColumn("_present", present), by, order, chunk)
    item = F.struct(order, *payload)

    # "After" sorts downwards: a frame that starts at the partition's edge grows
    # by one row per step, while one that ends there would be rescanned per row.
    def sense(c: Column) -> Column:
        return c.asc() if before else c.desc()

    ordering = [sense(F.col(order))] + ([tie.asc()] if tie is not None else [])
    seen = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*by, "_chunk").orderBy(*ordering).rowsBetween(*seen)
    local = keyed.withColumn(
        "_local", F.last(F.when(F.col("_present"), item), True).over(inside)
    )

    pick, pick_by = (F.max, F.max_by) if before else (F.min, F.min_by)
    at = F.when(F.col("_present"), F.col(order))
    ends = keyed.groupBy(*by, "_chunk").agg(
        pick(at).alias(order), *[pick_by(F.col(p), at).alias(p) for p in payload]
    )
    across = Window.partitionBy(*by).orderBy(sense(F.col("_chunk"))).rowsBetween(*seen)
    carry = ends.select(
        *by, "_chunk",
        F.last(F.when(F.col(order).isNotNull(), item), True).over(across).alias("_carry"),
    )
    return (
        local.join(carry, [*by, "_chunk"])
        .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry")))
        .drop("_present", "_local", "_carry", "_chunk")
    )


def as_of(
    anchors: DataFrame,
    items: DataFrame,
    payload: Sequence[str],
    direction: str,
    out: str,
    by: Sequence[str] = FILE,
    order: str = "line_no",
    chunk: int = CHUNK,
) -> DataFrame:
    """For each anchor the nearest item strictly before/after it in its file.

    Anchors keep all their columns and gain ``out`` (a struct, or NULL).  Items
    are unique per (file, order).  Each anchor position is looked up once, however
    many anchors share it, so a window partition holds at most two rows per
    order value of its chunk.
    """
    places = anchors.select(*by, order).distinct().withColumn("_item", F.lit(0))
    right = items.select(*by, order, *payload, F.lit(1).alias("_item"))
    both = places.unionByName(right, allowMissingColumns=True)
    # Anchors come first among equal positions in both directions: strictness.
    found = nearest(
        both, F.col("_item") == 1, payload, direction, out, by, order,
        tie=F.col("_item"), chunk=chunk,
    )
    answers = found.filter("_item = 0").select(*by, order, out)
    return anchors.join(answers, [*by, order], "left").select(*anchors.columns, out)


def attach_per_file(
    df: DataFrame,
    per_file: DataFrame,
    last_line: str,
    by: Sequence[str] = FILE,
    order: str = "line_no",
    how: str = "inner",
    chunk: int = CHUNK,
) -> DataFrame:
    """Join one row per file onto its lines without gathering a file in one task.

    ``last_line`` names the column of ``per_file`` with the highest line number
    that needs the row; it is repeated once per chunk and joined on (file, chunk).
    """
    chunks = F.sequence(F.lit(0).cast("bigint"), chunk_of(last_line, chunk))
    spread = per_file.withColumn("_chunk", F.explode(chunks))
    return _keys(df, by, order, chunk).join(
        spread, [*by, "_chunk"], how
    ).drop("_chunk")
