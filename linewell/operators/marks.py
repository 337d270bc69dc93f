"""Marks: a set of (file, line_no) kept next to a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.functions.text import visible_length
from linewell.operators.ordered import CHUNK, as_of
from linewell.operators.search import KEY


def add_marks(marks: DataFrame, new: DataFrame, lines: DataFrame) -> DataFrame:
    """Marks plus the new ones that exist as lines; doubles collapse."""
    # This way round a small selection is broadcast and the lines' keys stay where they are.
    real = lines.select(*KEY).join(new.select(*KEY), KEY, "left_semi")
    return marks.select(*KEY).unionByName(real).dropDuplicates(KEY)


def delete_marks(marks: DataFrame, gone: DataFrame) -> DataFrame:
    """Marks without ``gone``; absent ones are no error."""
    return marks.select(*KEY).join(gone.select(*KEY), KEY, "left_anti")


def clear_marks(marks: DataFrame, file: str | None = None) -> DataFrame:
    """Marks without those of one file, or no marks at all."""
    return marks.filter(F.lit(False) if file is None else F.col("file") != file)


def toggle_marks(marks: DataFrame, selected: DataFrame, lines: DataFrame) -> DataFrame:
    """Marked lines of the selection lose their mark, the others gain one."""
    real = lines.select(*KEY).join(selected.select(*KEY), KEY, "left_semi")
    sides = marks.select(*KEY, F.lit(1).alias("marked"), F.lit(0).alias("chosen")).unionByName(
        real.select(*KEY, F.lit(0).alias("marked"), F.lit(1).alias("chosen"))
    )
    both = sides.groupBy(*KEY).agg(F.max("marked").alias("marked"), F.max("chosen").alias("chosen"))
    return both.filter("marked <> chosen").select(*KEY)


def mark_after(anchors: DataFrame, marks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Anchors with ``mark_line``: the first mark strictly below, or NULL."""
    return _mark(anchors, marks, "after", chunk)


def mark_before(anchors: DataFrame, marks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Anchors with ``mark_line``: the last mark strictly above, or NULL."""
    return _mark(anchors, marks, "before", chunk)


def _mark(anchors: DataFrame, marks: DataFrame, direction: str, chunk: int) -> DataFrame:
    found = as_of(anchors, marks.select(*KEY).distinct(), [], direction, "_mark", chunk=chunk)
    return found.select(*anchors.columns, F.col("_mark.line_no").alias("mark_line"))


def marks_stats(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """Per file with marks: how many, and the longest displayed marked line."""
    return lines.join(marks.select(*KEY), KEY, "left_semi").groupBy("file").agg(
        F.count("*").alias("n_marks"), F.max(visible_length("line")).alias("max_length")
    )
