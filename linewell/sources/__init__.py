from linewell.sources.encoding import decode_column, detect_encoding
from linewell.sources.files import (
    decode_lines, file_info, file_stats, line_positions, number_lines, raw_lines,
    scan_lines, size_label,
)
from linewell.sources.listing import file_changes, listing
from linewell.sources.moves import file_moves, list_tree, remember
from linewell.sources.synth import format_lines, synth_lines
from linewell.sources.tables import (
    append_ranged_table, lines_from_table, read_lines_table, read_ranged_table, read_ranges, write_lines_table,
)
from linewell.sources.text_sink import read_logs, write_logs

__all__ = [
    "append_ranged_table", "decode_column", "decode_lines", "detect_encoding", "file_changes", "file_info",
    "file_moves", "list_tree", "remember",
    "file_stats", "format_lines", "line_positions", "lines_from_table", "listing", "number_lines",
    "raw_lines", "read_lines_table", "read_ranged_table", "read_logs", "read_ranges", "scan_lines", "size_label", "synth_lines",
    "write_lines_table", "write_logs",
]
