"""linewell: log-line analytics as plain PySpark DataFrames and streams.

Every function takes and returns DataFrames (or Columns).  The order of lines
is always the column pair (file, line_no); nothing relies on row position.
"""
