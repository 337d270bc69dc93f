from linewell.functions.patterns import Term, line_matches, regex_of
from linewell.functions.spans import first_span, last_span, match_spans, span_count
from linewell.functions.text import expand_tabs, portion, visible_length, word_at

__all__ = [
    "Term", "expand_tabs", "first_span", "last_span", "line_matches", "match_spans",
    "portion", "regex_of", "span_count", "visible_length", "word_at",
]
