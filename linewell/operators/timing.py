"""Durations between start and end lines of a log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.patterns import Term, body_of, check_pattern, flags_of, line_matches
from linewell.operators.ordered import CHUNK, nearest
from linewell.operators.search import KEY


# Fixed value: parts the groups of one regex run.
_GAP = "\x1f"


def clock_seconds(line: Column, ts_re: str, weights: Sequence[float]) -> Column:
    """Time of a line: the groups 1.. of ``ts_re``, each times its weight, summed.

    NULL if the line does not match or a group is no number.  The regex runs once.
    """
    term = Term(ts_re)
    whole = f"{flags_of(False)}^(?s:.*?)(?:{body_of(term)})(?s:.*)\\z"
    groups = _GAP + _GAP.join(f"${n}" for n in range(1, len(weights) + 1))
    parts = F.split(F.regexp_replace(line, F.lit(whole), F.lit(groups)), _GAP, -1)

    def total(p: Column) -> Column:
        terms = [F.get(p, F.lit(n)).try_cast("double") * F.lit(w) for n, w in enumerate(weights, start=1)]
        return F.when((F.size(p) == len(weights) + 1) & (F.get(p, F.lit(0)) == ""), reduce(add, terms, F.lit(0.0)))

    # A lambda over the one-element array evaluates the split once.
    return F.element_at(F.transform(F.array(parts), total), 1)


def pair_durations(
    lines: DataFrame,
    start: Term | str,
    end: Term | str,
    ts_re: str | None = None,
    weights: Sequence[float] = (1.0,),
    time: Column | None = None,
    guard: Column | None = None,
    positive_only: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """For each end line the time since the last qualifying start line of its file.

    Gives (file, line_no, start_line, duration).  A start line that fails
    ``guard`` (an expression over ``line``) neither starts nor ends anything.
    A start stays open, so several ends may pair with it.  ``positive_only``
    drops durations of zero or less.  The time of a line is ``time`` (seconds, an
    expression over ``line``), or else what ``clock_seconds`` reads with ``ts_re``; a
    clock time has no date, so pairs over its turn need ``time``.  Lines without a
    time take no part.
    """
    if (time is None) == (ts_re is None):
        raise ValueError("give either ts_re or time")
    for term in (start, end, *([ts_re] if ts_re else [])):
        check_pattern(lines.sparkSession, term)
    at = clock_seconds(F.col("line"), ts_re, weights) if time is None else time
    begins = line_matches("line", start)
    counts = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    wanted = F.when(begins, counts).otherwise(line_matches("line", end))
    # Only start and end lines go on, as numbers.
    events = lines.filter(wanted).select(
        *KEY, begins.alias("starts"), at.cast("double").alias("at")).filter("at IS NOT NULL")
    paired = nearest(events, F.col("starts"), ["at"], "before", "_start", chunk=chunk)
    out = paired.filter("NOT starts AND _start IS NOT NULL").select(
        *KEY, F.col("_start.line_no").alias("start_line"),
        (F.col("at") - F.col("_start.at")).alias("duration"),
    )
    return out.filter("duration > 0") if positive_only else out


def duration_histogram(durations: DataFrame, width: float, value: str = "duration") -> DataFrame:
    """(bin, n): values counted in bins of ``width``, each named by its lower end."""
    low = F.floor(F.col(value) / F.lit(width)) * F.lit(width)
    return durations.groupBy(low.cast("double").alias("bin")).agg(F.count("*").alias("n"))
