"""Match spans per line, and the next or previous occurrence from a position.

Columns are display columns (tabs expanded), 0-based; a hit is
(line_no, start, end) with ``end`` inclusive, so an empty match ends one before
its start.  Finding does not wrap around.  All functions take any DataFrame
with file, line_no and line, the filtered view included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.patterns import Term, as_term, check_pattern, line_matches
from linewell.functions.spans import all_of, first_of, has_mark, last_of, mark_all, mark_first
from linewell.functions.text import expand_tabs, portion, word_at
from linewell.operators.ordered import CHUNK, as_of, attach_per_file
from linewell.operators.search import KEY


def _shown(lines: DataFrame, term: Term) -> DataFrame:
    check_pattern(lines.sparkSession, term)
    return lines.select(*KEY, expand_tabs("line").alias("line"))


def _matching(lines: DataFrame, term: Term) -> DataFrame:
    """Displayed lines with a match; the marking regex then runs on these only."""
    return _shown(lines, term).filter(line_matches("line", term))


def spans(lines: DataFrame, pattern: Term | str, **options) -> DataFrame:
    """Lines with ``spans``, the array of all matches in the displayed line."""
    term = as_term(pattern, **options)
    check_pattern(lines.sparkSession, term)
    marked = lines.withColumn("_marked", mark_all(expand_tabs("line"), term))
    return marked.withColumn("spans", all_of(F.col("_marked"))).drop("_marked")


def explode_spans(lines: DataFrame, pattern: Term | str, **options) -> DataFrame:
    """One row per occurrence: file, line_no, nth, start, len, text."""
    term = as_term(pattern, **options)
    hits = _matching(lines, term).withColumn("_marked", mark_all(F.col("line"), term))
    each = hits.select(
        *KEY, "line", F.posexplode(all_of(F.col("_marked"))).alias("nth", "span")
    )
    text = F.substring("line", F.col("span.start") + 1, F.col("span.len"))
    return each.select(*KEY, "nth", "span.start", "span.len", text.alias("text"))


def _end(span: Column) -> Column:
    return span["start"] + span["len"] - 1


def _hits(df: DataFrame, spans_found: Column) -> DataFrame:
    """One row per span.  A generator, since a filter on a computed span would be
    pushed down and so compute it twice."""
    each = df.select(*KEY, F.explode(spans_found).alias("span"))
    return each.select(
        *KEY, F.col("span.start").alias("start"), _end(F.col("span")).alias("end")
    )


def _one(marked: Column, span: Column) -> Column:
    return F.when(has_mark(marked), F.array(span))


def find_next(
    lines: DataFrame, pattern: Term | str, line_no: int, column: int = 0, **options
) -> DataFrame:
    """First hit of each file at or after (line_no, column): at most one row per file.

    The rest of the anchor line is searched from the column on, then the lines
    below from their start.
    """
    term = as_term(pattern, **options)
    line, marked = F.col("line"), F.col("_marked")
    below = _matching(lines.filter(F.col("line_no") >= line_no), term)
    found = below.withColumn(
        "_marked",
        F.when(F.col("line_no") > line_no, mark_first(line, term))
        .otherwise(mark_first(line, term, column)),
    )
    hits = _hits(found, _one(marked, first_of(marked)))
    return _nearest_per_file(hits, F.min, F.min_by)


def find_prev(
    lines: DataFrame, pattern: Term | str, line_no: int, column: int = 0, **options
) -> DataFrame:
    """Last hit of each file before (line_no, column): at most one row per file.

    On the anchor line a hit must end strictly before the column.
    """
    term = as_term(pattern, **options)
    above = _matching(lines.filter(F.col("line_no") <= line_no), term)
    found = above.withColumn("_marked", mark_all(F.col("line"), term))
    return _nearest_per_file(
        _hits(found, _last_up_to(line_no, F.lit(column))), F.max, F.max_by
    )


def _last_up_to(line_no: int, column: Column) -> Column:
    marked = F.col("_marked")
    return F.when(F.col("line_no") < line_no, _one(marked, last_of(marked))).otherwise(
        all_before(marked, column)
    )


def _nearest_per_file(hits: DataFrame, pick, pick_by) -> DataFrame:
    # Fixed-width aggregates: combined per task before a row per file is shuffled.
    return hits.groupBy("file").agg(
        pick("line_no").alias("line_no"),
        pick_by("start", "line_no").alias("start"),
        pick_by("end", "line_no").alias("end"),
    )


def all_before(marked: Column, column: Column) -> Column:
    """Array of the last marked span that ends strictly before ``column``; or empty."""
    earlier = F.filter(all_of(marked), lambda s: s["start"] + s["len"] < column)
    return F.when(column > 0, F.slice(earlier, F.lit(-1), F.lit(1)))


def find_next_bulk(
    anchors: DataFrame, lines: DataFrame, pattern: Term | str, chunk: int = CHUNK, **options
) -> DataFrame:
    """``find_next`` for every row of ``anchors`` (file, line_no, col)."""
    return _bulk(anchors, lines, as_term(pattern, **options), "after", chunk)


def find_prev_bulk(
    anchors: DataFrame, lines: DataFrame, pattern: Term | str, chunk: int = CHUNK, **options
) -> DataFrame:
    """``find_prev`` for every row of ``anchors`` (file, line_no, col)."""
    return _bulk(anchors, lines, as_term(pattern, **options), "before", chunk)


def _bulk(anchors, lines, term, direction, chunk) -> DataFrame:
    line, marked = F.col("line"), F.col("_marked")
    if direction == "after":
        every, elsewhere = mark_first(line, term), first_of(marked)
        here, own = mark_first(line, term, F.col("col")), first_of(marked)
    else:
        every, elsewhere = mark_all(line, term), last_of(marked)
        here, own = mark_all(line, term), F.get(all_before(marked, F.col("col")), F.lit(0))
    # Only matching lines, as three numbers each, take part in the ordered lookup.
    hits = _hits(
        _matching(lines, term).withColumn("_marked", every), _one(marked, elsewhere)
    )
    found = as_of(anchors, hits, ["start", "end"], direction, "_next", chunk=chunk)
    # The few lines that anchors stand on are picked before any text moves.
    stood_on = lines.join(anchors.select(*KEY).distinct(), KEY, "left_semi")
    placed = found.join(_shown(stood_on, term), KEY, "left").withColumn("_marked", here)
    found = placed.withColumn("_own", own)
    own_hit = F.col("_own").isNotNull()

    def either(mine: Column, name: str) -> Column:
        return F.when(own_hit, mine).otherwise(F.col(f"_next.{name}"))

    return found.select(
        *anchors.columns,
        either(F.col("line_no"), "line_no").alias("hit_line"),
        either(F.col("_own.start"), "start").alias("hit_start"),
        either(_end(F.col("_own")), "end").alias("hit_end"),
    )


def find_selected(
    lines: DataFrame, line_no: int, column: int, end_column: int | None = None,
    direction: str = "next", chunk: int = CHUNK,
) -> DataFrame:
    """Next or previous occurrence, in each file, of the text selected there.

    The selection is the word under (line_no, column), or the portion up to
    ``end_column``; files without one give no row.  It is searched as literal
    text from just after (next) or just before (previous) the selection.
    """
    if direction not in ("next", "prev"):
        raise ValueError("direction must be 'next' or 'prev'")
    onward = direction == "next"
    here = lines.filter(F.col("line_no") == line_no)
    if end_column is None:
        picked = here.select("file", word_at("line", column).alias("w")).select("file", "w.*")
    else:
        low, high = sorted((column, end_column))
        picked = here.select(
            "file", portion("line", low, high).alias("word"),
            F.lit(low).alias("start"), F.lit(high).alias("end"),
        )
    picked = picked.filter("word != ''")
    quoted = F.replace("word", F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    wanted = picked.select(
        "file", "word", F.concat(F.lit("(?dU)\\Q"), quoted, F.lit("\\E")).alias("_regex"),
        (F.col("end") + 1 if onward else F.greatest(F.col("start") - 1, F.lit(0))).alias("_col"),
    )
    # The selection travels to its file's lines chunk by chunk, not file by file.
    if onward:
        ends = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
        wanted = wanted.join(ends, "file")
    else:
        wanted = wanted.withColumn("_last", F.lit(line_no).cast("bigint"))
    beyond = F.col("line_no") >= line_no if onward else F.col("line_no") <= line_no
    shown = lines.filter(beyond).select(*KEY, expand_tabs("line").alias("line"))
    tried = attach_per_file(shown, wanted, "_last", chunk=chunk)
    line, col = F.col("line"), F.col("_col")
    on_anchor = F.col("line_no") == line_no
    tried = tried.filter(F.contains(line, F.col("word")))
    if onward:
        at = F.when(on_anchor, col + 1).otherwise(1)
        hit = F.call_function("locate", F.col("word"), line, at)
        word = F.struct((F.col("_hit") - 1).alias("start"), F.length("word").alias("len"))
        found = tried.withColumn("_hit", hit)
        hits = _hits(found, F.when(F.col("_hit") > 0, F.array(word)))
        return _nearest_per_file(hits, F.min, F.min_by)
    found = tried.withColumn("_marked", mark_all(line, F.col("_regex")))
    return _nearest_per_file(_hits(found, _last_up_to(line_no, col)), F.max, F.max_by)
