"""Pages, tails, surroundings and ranges of lines, and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions.text import expand_tabs, portion, visible_length
from linewell.operators.ordered import CHUNK, chunk_of, in_ranges
from linewell.operators.search import KEY
from linewell.sources.text_sink import write_logs


def page(
    lines: DataFrame, first: int, n: int, expanded: bool = False, by: str = "line_no"
) -> DataFrame:
    """Lines ``first .. first+n-1`` of each file; as many of them as exist.

    Use ``by="idx"`` on an indexed filtered view.  On a stored lines table the
    range filter skips row groups, on a ranged one whole partitions.
    """
    out = lines.filter(F.col(by).between(first, first + n - 1))
    if by == "line_no":
        out = out.filter(in_ranges(lines, first, first + n - 1))
    return out.withColumn("line", expand_tabs("line")) if expanded else out


def tail(lines: DataFrame, n: int, by: str = "line_no", chunk: int = CHUNK) -> DataFrame:
    """The last ``n`` lines of each file.

    Ranked in two steps, per (file, chunk) and then per file; Spark prunes each
    task to n rows per group before either shuffle, so a huge file leaves only
    n rows per task.
    """
    last = F.col(by).desc()
    keyed = lines.withColumn("_chunk", chunk_of(by, chunk))
    for keys in (["file", "_chunk"], ["file"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(last))
        keyed = keyed.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return keyed.drop("_chunk")


def context(lines: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Lines at most ``k`` away from an anchor, each once.

    Files are cut into chunks of k + 1 lines.  An anchor covers its whole chunk; into
    the chunk above or below only the nearest anchor reaches farthest.  So one row a
    touched chunk (at most three an anchor, whatever k is) decides its lines.
    """
    ends = anchors.groupBy("file", chunk_of("line_no", k + 1).alias("c")).agg(
        F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    none = F.lit(None).cast("bigint")

    def reach(shift: int, up: Column, down: Column) -> Column:
        return F.struct((F.col("c") + shift).alias("_chunk"), F.lit(shift == 0).alias("own"), up.alias("up"), down.alias("down"))

    touched = ends.select("file", F.inline(F.array(
        reach(0, none, none), reach(1, F.col("high"), none), reach(-1, none, F.col("low")))))
    touched = touched.groupBy("file", "_chunk").agg(
        F.bool_or("own").alias("_own"), F.max("up").alias("_up"), F.min("down").alias("_down"))
    near = F.col("_own") | (F.col("line_no") - F.col("_up") <= k) | (F.col("_down") - F.col("line_no") <= k)
    return lines.withColumn("_chunk", chunk_of("line_no", k + 1)).join(
        touched, ["file", "_chunk"]).filter(near).select(*lines.columns)


def select_range(lines: DataFrame, lo: int, hi: int) -> DataFrame:
    """Lines ``lo .. hi`` (inclusive, in either order) of each file."""
    lo, hi = min(lo, hi), max(lo, hi)
    return lines.filter(F.col("line_no").between(lo, hi) & in_ranges(lines, lo, hi))


def range_max_length(lines: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per file: the longest displayed line within a range."""
    return select_range(lines, lo, hi).groupBy("file").agg(
        F.max(visible_length("line")).alias("max_length")
    )


def export_lines(
    lines: DataFrame, lo: int, hi: int, path: str,
    columns: tuple[int, int] | None = None, per_file: bool = False,
) -> None:
    """Write the text of a range as LF-terminated text files.

    The range is sorted by (file, line_no) across the part files, so reading
    the parts in name order gives the lines in order.  ``per_file`` writes the files of a
    set apart, a text file for each of them and ``CHUNK`` lines (``read_logs`` reads them);
    only the rows of one such part meet in a task.  ``columns`` (first, last) writes only
    that part of each line, as displayed.
    """
    chosen = select_range(lines, lo, hi)
    if columns is not None:
        chosen = chosen.withColumn("line", portion("line", min(columns), max(columns)))
    if per_file:
        write_logs(chosen, path, CHUNK)
    else:
        chosen.select(*KEY, "line").orderBy(*KEY).select("line").write.text(path)
