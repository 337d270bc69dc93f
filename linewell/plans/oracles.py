"""The same results as plain SQL over the same tables."""

from __future__ import annotations

# Lines of the documents, one row each.
LINES = """
WITH L AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line
  FROM (
    SELECT doc_id, parts,
      unnest(range(1, len(parts) + 1 - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
)"""

HIT = "regexp_matches(line, '(the|and) ')"
# Both alternatives are four characters long, so a hit ends three past its start.
FIRST = "length(regexp_extract(line, '(?s)^(.*?)(the|and) ', 1))"
LAST = "length(regexp_extract(line, '(?s)^(.*)(the|and) ', 1))"

VIEW = LINES + f""", V AS (
  SELECT file, line_no, line,
    CASE WHEN line_no % 10 = 0 THEN 'MARK' ELSE 'MATCH' END AS item_type
  FROM L WHERE line_no % 10 = 0 OR {HIT}
), X AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS idx FROM V
)"""

TAGGED = LINES + """, T AS (
  SELECT *, file || '|' || line_no || '|' || line AS tagged FROM L
)"""

LOGS = TAGGED + """, G AS (
  SELECT *, CAST(file AS BIGINT) % 20 AS log, CASE WHEN line_no >= 3 THEN 1 ELSE 0 END AS phase FROM T
)"""

FOLLOWED = LOGS + """
SELECT log, file AS doc, CASE WHEN log % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS epoch,
  log % 2 = 1 OR row_number() OVER (PARTITION BY log ORDER BY CAST(file AS BIGINT) DESC, line_no DESC) > 1 AS terminated, line
FROM G WHERE log % 2 = 1 OR phase = 0"""

TAG_START = """CAST(coalesce(sum(octet_length(encode(tagged)) + 1) OVER (
    PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS byte_start"""

# Tab stops are eight apart; a cell is padded from where the text before it ends.
TABS = LINES + """, C AS (
  SELECT file, line_no, string_split(replace(line, ' the ', chr(9)), chr(9)) AS cells FROM L
), E AS (
  SELECT file, line_no, array_to_string(list_transform(cells, lambda c, i:
    CASE WHEN i = len(cells) THEN c ELSE rpad(c, CAST((length(c) // 8 + 1) * 8 AS INTEGER), ' ')
    END), '') AS shown FROM C
)"""

EVENTS = """
WITH G AS (
  SELECT event_id AS line_no, ts, event_type, user_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || event_type || ' user=' || user_id AS line
  FROM events
)"""

PAIRS = EVENTS + """, S AS (
  SELECT line_no, event_type, user_id,
    epoch_us(ts) / 1000000.0::DOUBLE AS secs FROM G
), P AS (
  SELECT line_no, event_type, secs,
    last_value(CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN line_no END IGNORE NULLS) OVER w AS start_line,
    last_value(CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN secs END IGNORE NULLS) OVER w AS start_secs
  FROM S WINDOW w AS (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), D AS (
  SELECT line_no, start_line, secs - start_secs AS duration
  FROM P WHERE event_type = 'error' AND secs - start_secs > 0
)"""

CLASSIFIED = """
  SELECT file, line_no,
    CASE WHEN regexp_matches(line, 'secret|password', 'i') THEN 0
         WHEN regexp_matches(line, '[0-9]{3}') THEN 1
         WHEN regexp_matches(line, '^The ') THEN 2
         WHEN regexp_matches(line, 'ing') THEN 3 END AS rule FROM L"""

EVENT_RULES = EVENTS + """
SELECT 'events.log' AS file, line_no, CASE WHEN hit THEN ascii(event_type) END AS rule,
  CASE WHEN hit THEN event_type END AS fore, CASE WHEN hit THEN 'white' END AS back
FROM (SELECT *, regexp_matches(line, event_type || ' user=1') AS hit FROM G)"""

ENCODED = """
SELECT CAST(doc_id AS VARCHAR) AS file, guess, CASE guess WHEN 'UTF8' THEN 'UTF-8'
  WHEN 'UTF16LE' THEN 'UTF-16LE' ELSE 'ISO-8859-1' END AS reader_encoding
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'UTF16LE'
  WHEN doc_id % 4 = 2 AND regexp_matches(text, '[\\x{80}-\\x{ff}]') THEN 'ASCII8'
  WHEN doc_id % 4 <> 2 AND regexp_matches(text, '[^\\x00-\\x7f]') THEN 'UTF8'
  ELSE 'ASCII7' END AS guess FROM documents WHERE text <> '')"""

WORD = """CASE WHEN regexp_matches(substr(line, 11, 1), '[A-Za-z0-9_]') THEN"""


def _word(column: int) -> str:
    """Word around a column, as left and right halves."""
    return (
        f"regexp_extract(substr(line, 1, {column}), '[A-Za-z0-9_]*$') AS l, "
        f"regexp_extract(substr(line, {column + 1}), '^[A-Za-z0-9_]*') AS r"
    )


ORACLES: dict[str, str] = {
    # sources
    "scan_lines": LOGS + """
SELECT log, file AS doc, row_number() OVER w - 1 AS line_no, line,
  CAST(coalesce(sum(octet_length(encode(tagged)) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS byte_start,
  CAST(octet_length(encode(tagged)) + 1 AS BIGINT) AS n_bytes, lead(1) OVER w IS NOT NULL AS terminated
FROM G WINDOW w AS (PARTITION BY log ORDER BY phase, CAST(file AS BIGINT), line_no)""",
    "file_info": TAGGED + """
SELECT CAST(file AS BIGINT) % 5 AS part, count(*) AS n_lines,
  CAST(sum(octet_length(encode(tagged)) + 1) AS BIGINT) AS size, CAST(max(length(tagged)) AS INTEGER) AS max_length,
  CASE WHEN bool_or(regexp_matches(line, '[^\\x00-\\x7f]')) THEN 'UTF8' ELSE 'ASCII7' END AS guess FROM T GROUP BY 1""",
    "formatted_lines": """
SELECT 'orders.log' AS file, o_orderkey AS line_no,
  'this is order' || chr(9) || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS line FROM orders""",
    "scan_lines_auto": LINES + " SELECT file AS doc, line_no, line FROM L",
    "lines_table": LINES + " SELECT * FROM L WHERE line_no BETWEEN 2 AND 4",
    "lines_numbered": LINES + " SELECT *, line_no + 1 AS display_no FROM L",
    "line_positions": LINES + """
SELECT file, line_no, byte_end - n AS byte_start, byte_end FROM (
  SELECT file, line_no, CAST(octet_length(encode(line)) + 1 AS BIGINT) AS n,
    CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS byte_end
  FROM L)""",
    "decode_lines": LINES + """
SELECT file, line_no, CASE
  WHEN line_no % 10 IN (4, 9) THEN translate(regexp_replace(line, '[^\\x00-\\x7f]', '?', 'g'), 'e', 'ж')
  WHEN line_no % 10 = 6 THEN translate(regexp_replace(line, '[^\\x00-\\x7f]', '?', 'g'), 'e', '中')
  WHEN line_no % 10 = 8 THEN translate(regexp_replace(line, '[^\\x00-\\x7f]', '?', 'g'), 'e', 'あ')
  WHEN line_no % 10 IN (0, 5) THEN regexp_replace(line, '[^\\x{00}-\\x{ff}]', '?', 'g')
  ELSE line END AS line FROM L""",
    "detect_encoding": ENCODED,
    "detect_encoding_lenient": ENCODED,
    "file_stats": LINES + """
SELECT file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
  CAST(max(length(line)) AS INTEGER) AS max_length FROM L GROUP BY file""",
    "size_labels": """
SELECT doc_id, CASE WHEN n < 1024 THEN format('{:,}', n) || ' B'
  WHEN n < 1048576 THEN format('{:,.1f}', n / 1024.0) || ' KiB'
  ELSE format('{:,.1f}', n / 1048576.0) || ' MiB' END AS size_label
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * 97 AS n FROM documents)""",
    "file_changes": """
SELECT coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'CREATED' WHEN n.path IS NULL THEN 'DELETED'
       WHEN n.size > o.size THEN 'DATA_ADDED' WHEN n.size < o.size THEN 'TRUNCATED'
       ELSE 'UNCHANGED' END AS change,
  o.size AS old_size, n.size AS new_size, FALSE AS touched
FROM (SELECT CAST(item_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM benchmark) o
FULL OUTER JOIN
  (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents) n
ON o.path = n.path""",
    # Heads are hexadecimal here: two digits a byte.
    "file_moves": """
WITH d AS (SELECT doc_id % 5 AS kind, CAST(doc_id AS VARCHAR) AS name, coalesce(text, '') AS text FROM documents),
o AS (SELECT name AS path, hex(encode(text)) AS h FROM d),
n AS (SELECT CASE WHEN kind < 2 THEN 'old/' || name ELSE name END AS path,
        hex(encode(CASE WHEN kind IN (1, 2) THEN text || chr(10) || 'more' WHEN kind = 4 THEN 'new ' || text ELSE text END)) AS h
      FROM d WHERE kind <> 3),
j AS (SELECT coalesce(o.path, n.path) AS path, CAST(length(o.h) // 2 AS BIGINT) AS old_size,
        CAST(length(n.h) // 2 AS BIGINT) AS new_size, left(o.h, 2048) AS a, left(n.h, 2048) AS b,
        least(length(a), length(b)) AS m,
        coalesce(left(a, m) = left(b, m) AND (m > 0 OR old_size = new_size), FALSE) AS kept
      FROM o FULL OUTER JOIN n ON o.path = n.path),
s AS (SELECT path, old_size AS size, a AS head FROM j
      WHERE old_size > 0 AND (new_size IS NULL OR NOT kept OR new_size < old_size)),
t AS (SELECT path, new_size AS size, b AS head FROM j WHERE new_size > 0 AND (old_size IS NULL OR NOT kept)),
e AS (SELECT s1.path AS f, t1.path AS g
      FROM (SELECT head, size, min(path) AS path FROM s GROUP BY ALL HAVING count(*) = 1) s1
      JOIN (SELECT head, size, min(path) AS path FROM t GROUP BY ALL HAVING count(*) = 1) t1
        ON s1.head = t1.head AND s1.size = t1.size),
s2 AS (SELECT head, min(path) AS path, min(size) AS size FROM s
       WHERE length(head) >= 128 AND path NOT IN (SELECT f FROM e) GROUP BY head HAVING count(*) = 1),
p AS (SELECT t.path AS g, arg_max(s2.path, length(s2.head)) AS f FROM t JOIN s2
        ON t.size > s2.size AND starts_with(t.head, s2.head)
      WHERE t.path NOT IN (SELECT g FROM e) GROUP BY t.path),
v AS (SELECT f, g FROM e UNION ALL SELECT f, min(g) FROM p GROUP BY f HAVING count(*) = 1)
SELECT j.path, CASE WHEN old_size IS NULL THEN CASE WHEN x.f IS NULL THEN 'CREATED' ELSE 'RENAMED' END
    WHEN new_size IS NULL THEN 'DELETED' WHEN new_size < old_size THEN 'TRUNCATED'
    WHEN NOT kept AND old_size > 0 THEN 'REPLACED' WHEN new_size > old_size THEN 'DATA_ADDED' ELSE 'UNCHANGED' END AS change,
  old_size, new_size, FALSE AS touched, x.f AS moved_from, y.g AS moved_to
FROM j LEFT JOIN v x ON j.path = x.g LEFT JOIN v y ON j.path = y.f""",
    "list_tree": LINES + """
SELECT file || '.0000000000.txt' AS name, CAST(octet_length(encode(whole)) AS BIGINT) AS size,
  left(hex(encode(whole)), 2048) AS head
FROM (SELECT file, string_agg(line || chr(10), '' ORDER BY line_no) AS whole FROM L GROUP BY file)""",
    "export_range": LINES + """
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY line_no) AS INTEGER) AS pos, substr(line, 1, 31) AS line
FROM L WHERE line_no BETWEEN 2 AND 5""",
    # text
    "expand_tabs_lines": TABS + " SELECT * FROM E",
    "visible_lengths": TABS + " SELECT file, line_no, CAST(length(shown) AS INTEGER) AS n FROM E",
    "line_portion": LINES + " SELECT file, line_no, substr(line, 6, 8) AS part FROM L",
    "word_under_column": LINES + f"""
SELECT file, line_no, CASE WHEN r <> '' THEN l || r END AS word,
  CAST(CASE WHEN r <> '' THEN 10 - length(l) END AS INTEGER) AS word_start,
  CAST(CASE WHEN r <> '' THEN 10 + length(r) - 1 END AS INTEGER) AS word_end
FROM (SELECT file, line_no, {_word(10)} FROM L)""",
    # search
    "search_regex": LINES + f" SELECT * FROM L WHERE {HIT}",
    "search_icase": LINES + " SELECT * FROM L WHERE regexp_matches(line, '^(THE|and) ', 'i')",
    "search_fixed": LINES + " SELECT * FROM L WHERE contains(line, 'and.')",
    "search_conversations": """
SELECT file, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line FROM (
  SELECT file, parts,
    unnest(range(1, len(parts) + 1 - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS i
  FROM (SELECT conv_id || '/' || turn AS file, string_split(text, chr(10)) AS parts FROM conversations))
WHERE regexp_matches(parts[i], '(the|and) ')""",
    "search_any": LINES + """
SELECT * FROM L WHERE contains(line, 'and.') OR regexp_matches(line, '^WITH', 'i')
  OR regexp_matches(line, '[0-9]{4}')""",
    "search_empty": LINES + " SELECT * FROM L WHERE FALSE",
    "match_count": LINES + f"""
SELECT file, count(*) AS n_lines, count(*) FILTER (WHERE {HIT}) AS n_matches FROM L GROUP BY file""",
    "is_match": LINES + f" SELECT file, line_no, {HIT} AS is_match FROM L",
    "matches_max_length": LINES + f"""
SELECT file, count(*) AS n_matches, CAST(max(length(line)) AS INTEGER) AS max_length
FROM L WHERE {HIT} GROUP BY file""",
    "search_update": LINES + f" SELECT * FROM L WHERE {HIT}",
    # spans and find
    "spans": LINES + """, M AS (
  SELECT file, line_no, regexp_extract_all(line, '(the|and) ') AS m,
    string_split_regex(line, '(the|and) ') AS g FROM L
)
SELECT file, line_no, array_to_string(list_transform(range(len(m)), lambda i:
    coalesce(list_sum(list_transform(g[1:i + 1], lambda s: length(s))), 0)
    + coalesce(list_sum(list_transform(m[1:i], lambda s: length(s))), 0)), ',') AS starts,
  CAST(len(m) AS INTEGER) AS n_spans FROM M""",
    "explode_spans": LINES + """, M AS (
  SELECT file, line_no, regexp_extract_all(line, '(the|and) ') AS m,
    string_split_regex(line, '(the|and) ') AS g FROM L
), U AS (SELECT *, unnest(range(len(m))) AS i FROM M)
SELECT file, line_no, CAST(i AS INTEGER) AS nth,
  CAST(coalesce(list_sum(list_transform(g[1:i + 1], lambda s: length(s))), 0)
    + coalesce(list_sum(list_transform(m[1:i], lambda s: length(s))), 0) AS INTEGER) AS start,
  CAST(length(m[i + 1]) AS INTEGER) AS len, m[i + 1] AS text FROM U""",
    "span_counts": LINES + """
SELECT file, line_no, CAST(len(regexp_extract_all(line, '(the|and) ')) AS INTEGER) AS n_spans FROM L""",
    "find_next": LINES + f""", N AS (
  SELECT file, line_no, {FIRST} AS start FROM L WHERE line_no > 3 AND {HIT}
  UNION ALL
  SELECT file, line_no, 10 + {FIRST.replace("line,", "substr(line, 11),")} FROM L
  WHERE line_no = 3 AND {HIT.replace("line,", "substr(line, 11),")}
)
SELECT file, min(line_no) AS line_no, CAST(arg_min(start, line_no) AS INTEGER) AS start,
  CAST(arg_min(start, line_no) + 3 AS INTEGER) AS "end" FROM N GROUP BY file""",
    "find_prev": LINES + f""", N AS (
  SELECT file, line_no, {LAST} AS start FROM L WHERE line_no < 3 AND {HIT}
  UNION ALL
  SELECT file, line_no, {LAST.replace("line,", "substr(line, 1, 59),")} FROM L
  WHERE line_no = 3 AND {HIT.replace("line,", "substr(line, 1, 59),")}
)
SELECT file, max(line_no) AS line_no, CAST(arg_max(start, line_no) AS INTEGER) AS start,
  CAST(arg_max(start, line_no) + 3 AS INTEGER) AS "end" FROM N GROUP BY file""",
    "find_next_bulk": LINES + f""", C AS (
  SELECT file, line_no, {FIRST} AS start FROM L WHERE {HIT}
), A AS (
  SELECT file, line_no, 20 AS col,
    CASE WHEN {HIT.replace("line,", "substr(line, 21),")}
      THEN 20 + {FIRST.replace("line,", "substr(line, 21),")} END AS own FROM L WHERE line_no % 7 = 3
)
SELECT A.file, A.line_no, A.col,
  CASE WHEN own IS NOT NULL THEN A.line_no ELSE C.line_no END AS hit_line,
  CAST(coalesce(own, C.start) AS INTEGER) AS hit_start,
  CAST(coalesce(own, C.start) + 3 AS INTEGER) AS hit_end
FROM A ASOF LEFT JOIN C ON A.file = C.file AND A.line_no < C.line_no""",
    "find_prev_bulk": LINES + f""", C AS (
  SELECT file, line_no, {LAST} AS start FROM L WHERE {HIT}
), A AS (
  SELECT file, line_no, 20 AS col,
    CASE WHEN {HIT.replace("line,", "substr(line, 1, 19),")}
      THEN {LAST.replace("line,", "substr(line, 1, 19),")} END AS own FROM L WHERE line_no % 7 = 3
)
SELECT A.file, A.line_no, A.col,
  CASE WHEN own IS NOT NULL THEN A.line_no ELSE C.line_no END AS hit_line,
  CAST(coalesce(own, C.start) AS INTEGER) AS hit_start,
  CAST(coalesce(own, C.start) + 3 AS INTEGER) AS hit_end
FROM A ASOF LEFT JOIN C ON A.file = C.file AND A.line_no > C.line_no""",
    "find_selected_next": LINES + f""", W AS (
  SELECT file, l || r AS word, 2 + length(r) AS col FROM (SELECT file, {_word(2)} FROM L WHERE line_no = 0)
  WHERE r <> ''
), N AS (
  SELECT L.file, line_no, word,
    CASE WHEN line_no = 0 THEN col + instr(substr(line, CAST(col + 1 AS BIGINT)), word) ELSE instr(line, word) END AS p,
    CASE WHEN line_no = 0 THEN instr(substr(line, CAST(col + 1 AS BIGINT)), word) ELSE instr(line, word) END AS found
  FROM L JOIN W ON L.file = W.file
)
SELECT file, min(line_no) AS line_no, CAST(arg_min(p - 1, line_no) AS INTEGER) AS start,
  CAST(arg_min(p - 1 + length(word) - 1, line_no) AS INTEGER) AS "end"
FROM N WHERE found > 0 GROUP BY file""",
    "find_selected_prev": LINES + f""", W AS (
  SELECT file, l || r AS word FROM (SELECT file, {_word(2)} FROM L WHERE line_no = 3) WHERE r <> ''
), N AS (
  SELECT L.file, line_no, word,
    length(line) - length(string_split(line, word)[-1]) - length(word) AS p
  FROM L JOIN W ON L.file = W.file WHERE line_no < 3 AND contains(line, word)
)
SELECT file, max(line_no) AS line_no, CAST(arg_max(p, line_no) AS INTEGER) AS start,
  CAST(arg_max(p + length(word) - 1, line_no) AS INTEGER) AS "end" FROM N GROUP BY file""",
    # rules
    "classify": LINES + f""", K AS ({CLASSIFIED})
SELECT file, line_no, CAST(rule AS INTEGER) AS rule,
  CASE rule WHEN 0 THEN 'white' WHEN 1 THEN 'blue' WHEN 2 THEN 'green' WHEN 3 THEN 'grey' END AS fore,
  CASE rule WHEN 0 THEN 'red' WHEN 1 THEN 'white' WHEN 2 THEN 'white' WHEN 3 THEN 'black' END AS back
FROM K""",
    "rule_counts": LINES + f""", K AS ({CLASSIFIED})
SELECT CAST(rule AS INTEGER) AS rule, count(*) AS n_lines FROM K GROUP BY rule""",
    "classify_join": EVENT_RULES,
    "classify_join_long_list": EVENT_RULES,
    # marks
    "marks_add": LINES + """
SELECT file, line_no FROM L WHERE line_no % 10 = 0 OR line_no % 4 = 3""",
    "marks_delete": LINES + """
SELECT file, line_no FROM L WHERE line_no % 10 = 0 AND line_no % 4 <> 0""",
    "marks_clear": LINES + " SELECT file, line_no FROM L WHERE line_no % 10 = 0 AND file <> '0'",
    "marks_toggle": LINES + """
SELECT file, line_no FROM L WHERE (line_no % 10 = 0) <> (line_no % 4 = 0)""",
    "mark_after": LINES + """
SELECT file, line_no, min(CASE WHEN line_no % 10 = 0 THEN line_no END) OVER (
  PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS mark_line FROM L""",
    "mark_before": LINES + """
SELECT file, line_no, max(CASE WHEN line_no % 10 = 0 THEN line_no END) OVER (
  PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark_line FROM L""",
    "marks_stats": LINES + """
SELECT file, count(*) AS n_marks, CAST(max(length(line)) AS INTEGER) AS max_length
FROM L WHERE line_no % 10 = 0 GROUP BY file""",
    # filtered view
    "filtered_both": VIEW + " SELECT * FROM V",
    "filtered_marks": LINES + " SELECT *, 'MARK' AS item_type FROM L WHERE line_no % 10 = 0",
    "filtered_matches": LINES + f" SELECT *, 'MATCH' AS item_type FROM L WHERE {HIT}",
    "filtered_from_sets": LINES + f"""
SELECT *, CASE WHEN line_no % 10 = 0 THEN 'MARK' ELSE 'MATCH' END AS item_type
FROM L WHERE line_no % 10 = 0 OR {HIT} OR regexp_matches(line, '[0-9]{{4}}')""",
    "filtered_index": VIEW + " SELECT file, line_no, item_type, idx FROM X",
    "index_to_line": VIEW + " SELECT file, idx, line_no FROM X WHERE idx = 2",
    "line_to_index": VIEW + """
SELECT L.file, L.line_no, least(
  (SELECT count(*) FROM V WHERE V.file = L.file AND V.line_no < L.line_no),
  (SELECT count(*) - 1 FROM V WHERE V.file = L.file)) AS idx FROM L""",
    "filtered_stats": VIEW + """
SELECT file, count(*) AS n_items, CAST(max(length(line)) AS INTEGER) AS max_length FROM V GROUP BY file""",
    "line_types": LINES + f"""
SELECT file, line_no, CASE WHEN line_no % 10 = 0 THEN 'MARKED' WHEN {HIT} THEN 'MATCH' ELSE 'NORMAL' END AS line_type
FROM L""",
    "next_marked": VIEW + """
SELECT file, idx, line_no, item_type, min(CASE WHEN item_type = 'MARK' THEN idx END) OVER (
  PARTITION BY file ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS marked_idx FROM X""",
    "prev_marked": VIEW + """
SELECT file, idx, line_no, item_type, max(CASE WHEN item_type = 'MARK' THEN idx END) OVER (
  PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marked_idx FROM X""",
    "find_next_filtered": VIEW + """
SELECT file, min(line_no) AS line_no, CAST(arg_min(instr(line, 'ing') - 1, line_no) AS INTEGER) AS start,
  CAST(arg_min(instr(line, 'ing') + 1, line_no) AS INTEGER) AS "end"
FROM V WHERE line_no >= 1 AND contains(line, 'ing') GROUP BY file""",
    # paging and overview
    "page": TABS + " SELECT file, line_no, shown AS line FROM E WHERE line_no BETWEEN 3 AND 7",
    "page_filtered": VIEW + " SELECT * FROM X WHERE idx BETWEEN 1 AND 3",
    "tail": LINES + """
SELECT file, line_no, line FROM (SELECT *, max(line_no) OVER (PARTITION BY file) AS last FROM L)
WHERE line_no > last - 3""",
    "context": LINES + """
SELECT * FROM L WHERE EXISTS (SELECT 1 FROM L a WHERE a.file = L.file
  AND regexp_matches(a.line, '[0-9]{4}') AND a.line_no BETWEEN L.line_no - 2 AND L.line_no + 2)""",
    "range_max_length": LINES + """
SELECT file, CAST(max(length(line)) AS INTEGER) AS max_length
FROM L WHERE line_no BETWEEN 2 AND 6 GROUP BY file""",
    "overview": VIEW + """, Z AS (SELECT file, count(*) AS total FROM L GROUP BY file)
SELECT file, kind, bucket, n, CAST(least(n, 3) - 1 AS INTEGER) AS weight,
  round(least(n, 3) / 3.0::DOUBLE, 6) AS opacity, bucket * total // 5 AS first_line
FROM (SELECT V.file, item_type AS kind, CAST(line_no * 5 // total AS INTEGER) AS bucket,
  count(*) AS n, max(total) AS total FROM V JOIN Z ON V.file = Z.file GROUP BY ALL)""",
    # timing and history
    "pair_event_durations": PAIRS + """
SELECT 'events.log' AS file, line_no, start_line, round(duration, 3) AS duration FROM D""",
    "histogram_of_durations": PAIRS + """
SELECT floor(duration / 60.0::DOUBLE) * 60.0::DOUBLE AS bin, count(*) AS n FROM D GROUP BY 1""",
    "recent_users": """
SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id
ORDER BY last_used DESC, user_id LIMIT 50""",
    # following files
    "follow_search": LINES + f"""
SELECT file AS doc, 0::BIGINT AS epoch, TRUE AS terminated, line FROM L WHERE {HIT}""",
    "follow_counts": LOGS + """
SELECT log, 0::BIGINT AS epoch, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(tagged, '(the|and) ')) AS n_matches,
  CAST(max(length(tagged)) AS INTEGER) AS max_length FROM G GROUP BY log""",
    "follow_numbered": LOGS + """
SELECT log, file AS doc, row_number() OVER w - 1 AS line_no, 0::BIGINT AS epoch,
  CAST(coalesce(sum(octet_length(encode(tagged)) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS byte_start, line
FROM G WINDOW w AS (PARTITION BY log ORDER BY phase, CAST(file AS BIGINT), line_no)""",
    "follow_epochs": FOLLOWED,
    "follow_upserted": FOLLOWED,
    "follow_view": LOGS + f"""
SELECT log, file AS doc, CASE WHEN log % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS epoch,
  CASE WHEN log % 2 = 1 AND line_no % 10 = 0 THEN 'MARK' ELSE 'MATCH' END AS item_type, line
FROM G WHERE CASE WHEN log % 2 = 1 THEN line_no % 10 = 0 OR {HIT} ELSE phase = 0 AND {HIT} END""",
    "search_watched": LINES + f" SELECT file, line_no, line FROM L WHERE {HIT}",
    "search_progress": LINES + f"""
SELECT true AS several, true AS grew, count(*) AS n_lines, count(*) FILTER (WHERE {HIT}) AS n_matches,
  CAST(100 AS INTEGER) AS percent FROM L""",
    "batch_status": LINES + f"""
SELECT CAST(file AS BIGINT) % 3 AS batch_id, CASE WHEN count(*) FILTER (WHERE {HIT}) > 0 THEN 'NEW_FILTERED_DATA'
  ELSE 'NEW_DATA' END AS status FROM L GROUP BY 1""",
    "search_update_ranged": LINES + f" SELECT file, line_no, line FROM L WHERE {HIT}",
    "page_ranged": LINES + " SELECT * FROM L WHERE line_no BETWEEN 30 AND 34",
    "line_ranges": LINES + """
        SELECT file, line_no // 32 AS line_range, min(line_no) AS first_line, max(line_no) AS last_line,
          count(*) AS n_lines FROM L GROUP BY ALL""",
}
