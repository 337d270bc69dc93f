"""Searching lines: regex or literal text, full and incremental."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.functions.patterns import Term, any_matches, as_term, check_pattern, line_matches
from linewell.functions.text import visible_length
from linewell.operators.ordered import CHUNK, RANGE, attach_per_file, range_width
from linewell.shared import fresh_path

KEY = ["file", "line_no"]


def search(
    lines: DataFrame, pattern: Term | str, ignore_case: bool = False, syntax: str = "regex"
) -> DataFrame:
    """The lines in which the pattern occurs.  A narrow filter over raw lines.

    An empty pattern matches nothing; an invalid regex raises here, before any
    data is read.
    """
    term = as_term(pattern, ignore_case, syntax)
    check_pattern(lines.sparkSession, term)
    return lines.filter(line_matches("line", term))


def search_any(lines: DataFrame, terms: Iterable[Term | str]) -> DataFrame:
    """Lines matching at least one term; every term keeps its own syntax and case rule."""
    terms = list(terms)
    for term in terms:
        check_pattern(lines.sparkSession, term)
    return lines.filter(any_matches("line", terms))


def match_count(lines: DataFrame, pattern: Term | str, **options) -> DataFrame:
    """Per file: lines read and lines matched, files without a match included."""
    term = as_term(pattern, **options)
    check_pattern(lines.sparkSession, term)
    return lines.groupBy("file").agg(
        F.count("*").alias("n_lines"),
        F.count_if(line_matches("line", term)).alias("n_matches"),
    )


def is_match(lines: DataFrame, matches: DataFrame, out: str = "is_match") -> DataFrame:
    """Flag each line that is in ``matches``.  (file, line_no) keys spread evenly."""
    hits = matches.select(*KEY).distinct().withColumn(out, F.lit(True))
    return lines.join(hits, KEY, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def matches_max_length(matches: DataFrame) -> DataFrame:
    """Per file: number of matches and the longest displayed matching line."""
    return matches.groupBy("file").agg(
        F.count("*").alias("n_matches"), F.max(visible_length("line")).alias("max_length")
    )


def search_update(
    previous: DataFrame, lines: DataFrame, processed: int | DataFrame, pattern: Term | str,
    chunk: int = CHUNK, ranges: DataFrame | None = None, **options,
) -> DataFrame:
    """Matches after growth, searching only what is new.

    ``processed`` is the number of lines already searched: one number, or a
    (file, processed) table.  The last of them may have been incomplete, so it
    is tested again and its old match dropped.  Files missing from the table
    are searched from their start.

    With ``lines`` of a ranged table and its ``ranges`` only partitions that hold new
    lines of some file are read: a small table of ranges prunes them while the query runs.
    """
    term = as_term(pattern, **options)
    cols = previous.columns
    if isinstance(processed, int):
        limit = F.lit(processed - 1)
        kept = previous.filter(F.col("line_no") < limit)
        fresh = lines.filter(F.col("line_no") >= limit)
        if width := range_width(lines):
            fresh = fresh.filter(F.col(RANGE) >= max(0, processed - 1) // width)
    else:
        done = processed.filter("processed > 0").select(
            "file", (F.col("processed") - 1).alias("_from")
        )
        old = attach_per_file(previous, done, "_from", how="inner", chunk=chunk)
        kept = old.filter(F.col("line_no") < F.col("_from"))
        if ranges is not None and range_width(lines):
            new = _unsearched(lines, ranges, done)
        else:
            # Chunks past the last searched line have no partner: all new.
            new = attach_per_file(lines, done, "_from", how="left", chunk=chunk)
        fresh = new.filter(F.col("_from").isNull() | (F.col("line_no") >= F.col("_from")))
    return kept.select(*cols).unionByName(search(fresh, term).select(*cols))


def _unsearched(lines: DataFrame, ranges: DataFrame, done: DataFrame) -> DataFrame:
    """The lines of all ranges that end at or behind a file's ``_from``, with it (null: from the start).

    The wanted ranges are stored, so that Spark knows how small they are: their numbers, one
    for each range of line numbers, are broadcast and prune the partitions of ``lines``.
    """
    spark = lines.sparkSession
    wanted, numbers = fresh_path(spark, "wanted"), fresh_path(spark, "wanted-ranges")
    ranges.join(done, "file", "left").filter(
        F.col("last_line") >= F.coalesce("_from", F.lit(0))).select("file", RANGE, "_from").write.parquet(wanted)
    spark.read.parquet(wanted).select(RANGE).distinct().coalesce(1).write.parquet(numbers)
    # The comparison is always true; Spark prunes at run time only by tables that are filtered.
    some = spark.read.parquet(numbers).filter(F.col(RANGE) >= 0)
    return lines.join(some, RANGE, "left_semi").join(spark.read.parquet(wanted), ["file", RANGE]).select(*lines.columns, "_from")
