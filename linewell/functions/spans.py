"""All matches in a line: where they start and how long they are.

One ``regexp_replace`` puts a marker character before and after a match (empty
matches included); positions are then read off the marked string with built-in
string functions, so a regex runs once per line.  The markers are Unicode
noncharacters; should a line hold them, they are replaced by a third one first.

Each function has a ``mark_*`` half and a half that reads the marked string.
DataFrame code keeps the marked string in a column of its own, because an
expression used twice inside one column would be evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewell.functions.patterns import Term, as_term, body_of, flags_of, regex_of, shift_backrefs

# Noncharacters used as "match begins", "match ends", "was a marker".
OPEN, CLOSE, NEUTRAL = "\ufdd0", "\ufdd1", "\ufdd2"

# Spans per block while they are collected.
BLOCK = 128

SPAN_TYPE = "struct<start:int,len:int>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"


def _clean(line: Column) -> Column:
    for mark in (OPEN, CLOSE):
        line = F.replace(line, F.lit(mark), F.lit(NEUTRAL))
    return line


def mark_all(line: Column, term: Term | str | Column) -> Column:
    """The line with every match marked.  A Column is a full Java regex per row."""
    if not isinstance(term, Column):
        term = as_term(term)
        if term.text == "":
            return _clean(line)
        term = F.lit(regex_of(term))
    return F.regexp_replace(_clean(line), term, F.lit(f"{OPEN}$0{CLOSE}"))


def mark_first(line: Column, term: Term | str, at: Column | int = 0) -> Column:
    """The line up to and including the first match that starts at or after ``at``.

    Only that match is marked.  A line without one stays as it is.  The regex
    is applied to the whole line, so ``^`` and lookbehind see what lies before.
    """
    term = as_term(term)
    if term.text == "":
        return _clean(line)
    body = shift_backrefs(body_of(term), 2)
    before, after = f"{flags_of(term.ignore_case)}^((?s:.{{", f",}}?))({body})(?s:.*)\\z"
    if isinstance(at, int):
        regex = F.lit(f"{before}{at}{after}")
    else:
        regex = F.concat(F.lit(before), at.cast("string"), F.lit(after))
    return F.regexp_replace(_clean(line), regex, F.lit(f"$1{OPEN}$2{CLOSE}"))


def has_mark(marked: Column) -> Column:
    return F.contains(marked, F.lit(OPEN))


def _span(marked: Column, start: Column, length: Column) -> Column:
    found = F.struct(start.cast("int").alias("start"), length.cast("int").alias("len"))
    return F.when(has_mark(marked), found)


def first_of(marked: Column) -> Column:
    """``struct(start, len)`` from ``mark_first``, NULL when nothing is marked."""
    begin = F.instr(marked, OPEN)
    return _span(marked, begin - 1, F.length(marked) - begin - 1)


def last_of(marked: Column) -> Column:
    """``struct(start, len)`` of the last match from ``mark_all``, NULL when none."""
    before = F.length(marked) - F.length(F.substring_index(marked, OPEN, -1)) - 1
    others = F.length(marked) - F.length(F.replace(marked, F.lit(OPEN), F.lit(""))) - 1
    # Every earlier match put two markers before this one.
    length = F.instr(F.substring_index(marked, OPEN, -1), CLOSE) - 1
    return _span(marked, before - 2 * others, length)


def all_of(marked: Column) -> Column:
    """``array<struct(start, len)>`` of all matches from ``mark_all``."""
    parts = F.split(marked, OPEN, -1)
    # Each later part is "match CLOSE gap"; (length - 1) is what it adds to the position.
    rest = F.slice(parts, F.lit(2), F.size(parts))

    def add_span(acc: Column, part: Column) -> Column:
        span = F.struct(
            acc["pos"].alias("start"), (F.instr(part, CLOSE) - 1).alias("len")
        )
        return F.struct(
            (acc["pos"] + F.length(part) - 1).alias("pos"),
            F.concat(acc["spans"], F.array(span)).alias("spans"),
        )

    # Appending copies an array, so spans grow in short blocks that are joined at the end.
    def in_blocks(array: Column) -> Column:
        last = F.floor((F.size(array) - 1) / BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK))
        )

    # A lambda over the one-element array evaluates the split once.
    blocks = F.element_at(F.transform(F.array(rest), in_blocks), 1)

    def add_block(acc: Column, block: Column) -> Column:
        return F.aggregate(
            block, F.struct(acc["pos"].alias("pos"), _none().alias("spans")), add_span,
            lambda inner: F.struct(
                inner["pos"].alias("pos"),
                F.concat(acc["blocks"], F.array(inner["spans"])).alias("blocks"),
            ),
        )

    begin = F.struct(
        F.length(F.element_at(parts, 1)).alias("pos"),
        F.array().cast(f"array<{SPANS_TYPE}>").alias("blocks"),
    )
    folded = F.aggregate(blocks, begin, add_block, lambda acc: F.flatten(acc["blocks"]))
    return F.when(has_mark(marked), folded.cast(SPANS_TYPE)).when(marked.isNotNull(), _none())


def _none() -> Column:
    return F.array().cast(SPANS_TYPE)


def match_spans(line: Column | str, term: Term | str) -> Column:
    """``array<struct<start,len>>`` of all non-overlapping matches, left to right.

    Pass the tab-expanded line when columns should be display columns.
    """
    return all_of(mark_all(F.col(line) if isinstance(line, str) else line, term))


def first_span(line: Column, term: Term | str, at: Column | int = 0) -> Column:
    """``struct(start, len)`` of the first match starting at or after ``at``, or NULL."""
    return first_of(mark_first(line, term, at))


def last_span(line: Column, term: Term | str) -> Column:
    """``struct(start, len)`` of the last match in the line, or NULL."""
    return last_of(mark_all(line, term))


def span_count(line: Column | str, term: Term | str) -> Column:
    """Number of non-overlapping matches in the line."""
    term = as_term(term)
    line = F.col(line) if isinstance(line, str) else line
    if term.text == "":
        return F.lit(0)
    return F.regexp_count(line, F.lit(regex_of(term)))
