from linewell.operators.filtered import (
    filtered, filtered_index, filtered_search, filtered_stats, index_to_line, line_to_index,
    line_types, next_marked, prev_marked,
)
from linewell.operators.find import (
    explode_spans, find_next, find_next_bulk, find_prev, find_prev_bulk, find_selected, spans,
)
from linewell.operators.history import recent
from linewell.operators.marks import (
    add_marks, clear_marks, delete_marks, mark_after, mark_before, marks_stats, toggle_marks,
)
from linewell.operators.overview import overview
from linewell.operators.paging import (
    context, export_lines, page, range_max_length, select_range, tail,
)
from linewell.operators.rules import Rule, classify, classify_join, rule_counts
from linewell.operators.search import (
    is_match, match_count, matches_max_length, search, search_any, search_update,
)
from linewell.operators.timing import duration_histogram, pair_durations

__all__ = [
    "Rule", "add_marks", "classify", "classify_join", "clear_marks", "context",
    "delete_marks", "duration_histogram", "explode_spans", "export_lines", "filtered",
    "filtered_index", "filtered_search", "filtered_stats", "find_next", "find_next_bulk",
    "find_prev", "find_prev_bulk", "find_selected", "index_to_line", "is_match",
    "line_to_index", "line_types", "mark_after", "mark_before", "marks_stats",
    "match_count", "matches_max_length", "next_marked", "overview", "page",
    "pair_durations", "prev_marked", "range_max_length", "recent", "rule_counts",
    "search", "search_any", "search_update", "select_range", "spans", "tail",
    "toggle_marks",
]
