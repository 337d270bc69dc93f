"""The filtered view: matches, marks or both, in line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.patterns import Term, as_term, check_pattern, line_matches
from linewell.functions.text import visible_length
from linewell.operators.ordered import CHUNK, PIECE, nearest, running_total, total_in_place
from linewell.operators.search import KEY
from linewell.shared import fresh_path

VISIBILITIES = ("MATCHES", "MARKS", "BOTH")


def _check(visibility: str) -> None:
    if visibility not in VISIBILITIES:
        raise ValueError(f"visibility must be one of {VISIBILITIES}")


def filtered(
    lines: DataFrame, matches: DataFrame, marks: DataFrame, visibility: str = "BOTH"
) -> DataFrame:
    """Rows of ``lines`` that are matches and/or marks, with ``item_type``.

    A line that is both shows once, as MARK (as MATCH where only matches are
    visible).  ``matches`` is any subset of ``lines`` with all its columns; the
    text of a match is not looked up again.
    """
    _check(visibility)
    marked = marks.select(*KEY).distinct()
    as_match = F.lit("MATCH").alias("item_type")
    if visibility == "MATCHES":
        return matches.select(*lines.columns, as_match)
    on_marks = lines.join(marked, KEY, "left_semi").select(
        *lines.columns, F.lit("MARK").alias("item_type")
    )
    if visibility == "MARKS":
        return on_marks
    rest = matches.join(marked, KEY, "left_anti").select(*lines.columns, as_match)
    return on_marks.unionByName(rest)


def filtered_search(
    lines: DataFrame, pattern: Term | str, marks: DataFrame, visibility: str = "BOTH", **options
) -> DataFrame:
    """``filtered`` straight from a pattern, in one pass over the lines."""
    _check(visibility)
    term = as_term(pattern, **options)
    check_pattern(lines.sparkSession, term)
    hit = line_matches("line", term)
    if visibility == "MATCHES":
        return lines.filter(hit).withColumn("item_type", F.lit("MATCH"))
    marked = marks.select(*KEY).distinct()
    if visibility == "MARKS":
        return lines.join(marked, KEY, "left_semi").withColumn("item_type", F.lit("MARK"))
    # Searched ahead of the join: where the text is not asked for, it stays with the scan.
    flagged = lines.withColumn("_hit", hit).join(marked.withColumn("_marked", F.lit(True)), KEY, "left")
    is_mark = F.col("_marked").isNotNull()
    return (
        flagged.filter(is_mark | F.col("_hit"))
        .withColumn("item_type", F.when(is_mark, "MARK").otherwise("MATCH"))
        .drop("_marked", "_hit")
    )


def filtered_index(items: DataFrame, chunk: int = PIECE) -> DataFrame:
    """Add ``idx``: the position 0, 1, ... of each item in its file's filtered view.

    The items are computed and stored once, where they are; no text is shuffled.
    """
    return total_in_place(items, "idx", chunk=chunk)


def index_to_line(indexed: DataFrame, idx: int | DataFrame) -> DataFrame:
    """(file, idx, line_no) for one index in every file, or for a (file, idx) table."""
    if isinstance(idx, int):
        return indexed.filter(F.col("idx") == idx).select("file", "idx", "line_no")
    return idx.join(indexed.select("file", "idx", "line_no"), ["file", "idx"], "left")


def line_to_index(anchors: DataFrame, items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Anchors with ``idx``: the first item at or below the line.

    Past the last item it is the last index; NULL when the file has no items.  The
    places of both are computed and stored once; they are read twice.
    """
    # Each line is counted once, however many anchors name it.
    places = anchors.select(*KEY).distinct().withColumn("_item", F.lit(0))
    both = places.unionByName(items.select(*KEY, F.lit(1).alias("_item")))
    path = fresh_path(anchors.sparkSession, "places")
    both.write.parquet(path)
    both = anchors.sparkSession.read.parquet(path)
    # Anchors first among equals: the total before an anchor counts smaller lines only.
    counted = running_total(
        both, F.col("_item"), "_below", tie=[F.col("_item").asc()], total_out="_all", chunk=chunk
    )
    index = F.when(F.col("_all") > 0, F.least("_below", F.col("_all") - 1))
    answers = counted.filter("_item = 0").select(*KEY, index.alias("idx"))
    return anchors.join(answers, KEY, "left").select(*anchors.columns, "idx")


def filtered_stats(items: DataFrame) -> DataFrame:
    """Per file: number of items and the longest displayed one."""
    return items.groupBy("file").agg(
        F.count("*").alias("n_items"), F.max(visible_length("line")).alias("max_length")
    )


def line_types(lines: DataFrame, matches: DataFrame, marks: DataFrame) -> DataFrame:
    """Every line with ``line_type``: MARKED, else MATCH, else NORMAL.

    Both sets are reduced to one flag per key first, so the lines are joined once.
    """
    flags = (
        matches.select(*KEY, F.lit(1).alias("_flag"))
        .unionByName(marks.select(*KEY, F.lit(2).alias("_flag")))
        .groupBy(*KEY).agg(F.max("_flag").alias("_flag"))
    )
    return _typed(lines.join(flags, KEY, "left"), F.col("_flag") == 2, F.col("_flag") == 1).drop(
        "_flag"
    )


def _typed(df: DataFrame, marked: Column, matched: Column) -> DataFrame:
    kind = F.when(marked, "MARKED").when(matched, "MATCH").otherwise("NORMAL")
    return df.withColumn("line_type", kind)


def next_marked(indexed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each item of an indexed view with ``marked_idx``, the next MARK's index, or NULL."""
    return _marked(indexed, "after", chunk)


def prev_marked(indexed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each item of an indexed view with ``marked_idx``, the previous MARK's index, or NULL."""
    return _marked(indexed, "before", chunk)


def _marked(indexed: DataFrame, direction: str, chunk: int) -> DataFrame:
    places = indexed.select("file", "idx", "line_no", "item_type")
    is_mark = F.col("item_type") == "MARK"
    found = nearest(places, is_mark, [], direction, "_stop", order="idx", chunk=chunk)
    return found.select(*places.columns, F.col("_stop.idx").alias("marked_idx"))
