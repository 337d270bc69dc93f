"""Column functions on one line of text.  All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tab stops are eight columns apart.
TAB_STOP = 8

# The word characters a text ends in, tried once per run of word characters.
_WORD_TAIL = "(?<![A-Za-z0-9_])[A-Za-z0-9_]*+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def expand_tabs(line: Column | str, stop: int = TAB_STOP) -> Column:
    """The line as displayed: tabs padded to the next stop, NUL as a space."""
    line = F.replace(_col(line), F.lit("\x00"), F.lit(" "))
    # A cell plus one stop of spaces, cut to whole stops, ends at the next stop.  \G
    # and possessive quantifiers keep the regex linear in the length of the line.
    spaced = F.replace(line, F.lit("\t"), F.lit(" " * stop + "\t"))
    padded = F.regexp_replace(spaced, f"\\G((?:[^\t]{{{stop}}})*+)[^\t]*+\t", "$1")
    # Lines without a tab (nearly all) skip the regex.
    return F.when(F.contains(line, F.lit("\t")), padded).otherwise(line)


def visible_length(line: Column | str) -> Column:
    """Length in characters of the displayed line."""
    return F.length(expand_tabs(line))


def portion(line: Column | str, start: Column | int, end: Column | int) -> Column:
    """Columns ``start..end`` (inclusive, in either order) of the displayed line."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    low = F.least(start, end)
    return F.substring(expand_tabs(line), low + 1, F.abs(end - start) + 1)


def word_at(line: Column | str, column: Column | int) -> Column:
    """``struct(word, start, end)`` of the word under a 0-based display column.

    A word is a run of ``[A-Za-z0-9_]``; NULL when that character is no part
    of one, or when the column lies outside the line.
    """
    column = F.lit(column) if isinstance(column, int) else column
    shown = expand_tabs(line)
    left = F.regexp_extract(F.substring(shown, F.lit(1), column), _WORD_TAIL, 0)
    rest = F.substring(shown, column + 1, F.length(shown))
    right = F.regexp_extract(rest, "^[A-Za-z0-9_]*", 0)
    start = column - F.length(left)
    found = F.struct(
        F.concat(left, right).alias("word"),
        start.cast("int").alias("start"),
        (column + F.length(right) - 1).cast("int").alias("end"),
    )
    return F.when((column >= 0) & (F.length(right) > 0), found)
