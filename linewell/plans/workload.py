"""The library's operators as named jobs over the given tables.

``documents`` is the log corpus: each document is a file, each text line a log
line.  ``events`` is rendered as one timed log.  Jobs that read or follow text
files first write the corpus out as tagged lines, ``doc|line_no|line``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewell import operators as ops
from linewell import sources as src
from linewell import streaming as st
from linewell.functions import Term, expand_tabs, portion, span_count, visible_length, word_at
from linewell.operators.ordered import attach_per_file
from linewell.operators.timing import duration_histogram, pair_durations
from linewell.plans.session import ship
from linewell.sources.encoding import PYTHON_CODECS
from linewell.shared import fresh_path
from linewell.sources.uris import open_fs, qualified

PATTERN = "(the|and) "
RULES = [
    ops.Rule("secret|password", True, "white", "red"),
    ops.Rule("[0-9]{3}", False, "blue", "white"),
    ops.Rule("^The ", False, "green", "white"),
    ops.Rule("ing", False, "grey", "black"),
]
KEY = ["file", "line_no"]

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}


def job(fn: Job) -> Job:
    @wraps(fn)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    JOBS[fn.__name__] = shipped
    return shipped


# -- inputs ------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.lines_from_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat_ws(
        " ", stamp, F.col("event_type"), F.concat(F.lit("user="), F.col("user_id"))
    )
    return table(spark, sf_dir, "events").select(
        F.lit("events.log").alias("file"), F.col("event_id").alias("line_no"),
        line.alias("line"),
    )


def tenth(lines: DataFrame, rest: int = 0) -> DataFrame:
    """Marks: every tenth line."""
    return lines.filter(F.col("line_no") % 10 == rest).select(*KEY)


def write_corpus(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "corpus")
    lines = doc_lines(spark, sf_dir)
    lines.select(F.concat_ws("|", "file", "line_no", "line").alias("value")).write.text(path)
    return path


def untag(df: DataFrame) -> DataFrame:
    """Tagged lines back to ``doc`` and ``line``."""
    parts = F.split("line", r"\|", 3)
    return df.withColumn("doc", parts[0]).withColumn("line", parts[2])


def since_first(df: DataFrame, column: str, log: list[str]) -> Column:
    """A running value counted from its document's first line (a document is one row)."""
    return F.col(column) - F.min(column).over(Window.partitionBy(*log, "doc"))


# -- sources -----------------------------------------------------------------------

@job
def scan_lines(spark, sf_dir):
    """Lines of written logs; the last line of each has no LF."""
    folder = fresh_path(spark, "logs")
    _write_logs(_log_lines(spark, sf_dir), folder, closed=False)
    got = untag(src.scan_lines(spark, folder, "UTF-8", positions=True))
    return got.select(
        _log_of("file").alias("log"), "doc", "line_no", "line", "byte_start",
        (F.col("byte_end") - F.col("byte_start")).alias("n_bytes"), "terminated",
    )


@job
def file_info(spark, sf_dir):
    """All facts of the files written to five folders, a row a folder.

    Tasks write the lines that they hold, a file a folder, so that no task's share grows with the input.
    """
    path = fresh_path(spark, "corpus")
    tagged = F.concat_ws("|", "file", "line_no", "line").alias("value")
    part = (F.col("file").cast("bigint") % 5).alias("part")
    doc_lines(spark, sf_dir).select(tagged, part).write.partitionBy("part").text(path)
    info = src.file_info(spark, [f"{path}/part={k}" for k in range(5)])
    # Guesses in the order of their names: one file that is not plain makes its folder so.
    return info.groupBy(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part")).agg(
        F.sum("n_lines").alias("n_lines"), F.sum("size").alias("size"), F.max("max_length").alias("max_length"),
        F.max("guess").alias("guess"))


@job
def formatted_lines(spark, sf_dir):
    """Generated lines, one per order."""
    orders = table(spark, sf_dir, "orders")
    return src.format_lines(orders, "o_orderkey", "this is order\t%07d", "orders.log")


@job
def scan_lines_auto(spark, sf_dir):
    """Encoding guessed per file."""
    got = untag(src.scan_lines(spark, write_corpus(spark, sf_dir)))
    return got.select("doc", since_first(got, "line_no", ["file"]).alias("line_no"), "line")


@job
def lines_table(spark, sf_dir):
    path = fresh_path(spark, "lines")
    src.write_lines_table(doc_lines(spark, sf_dir), path)
    return ops.page(src.read_lines_table(spark, path), 2, 3)


@job
def lines_numbered(spark, sf_dir):
    return doc_lines(spark, sf_dir).withColumn("display_no", F.col("line_no") + 1)


@job
def line_positions(spark, sf_dir):
    return src.line_positions(doc_lines(spark, sf_dir)).drop("line")


# A letter of each code page that Western text would not show at work.
LETTERS = {"windows-1251": "ж", "KOI8-R": "ж", "Big5": "中", "Shift_JIS": "あ"}


@job
def decode_lines(spark, sf_dir):
    """Every tenth line in each of the ten encodings, brought back to text."""
    lines = doc_lines(spark, sf_dir)
    out = None
    for rest, (name, codec) in enumerate(PYTHON_CODECS.items()):
        part = lines.filter(F.col("line_no") % 10 == rest)
        text = F.col("line")
        if name in LETTERS:
            text = F.translate(F.regexp_replace(text, "[^\x00-\x7f]", "?"), "e", LETTERS[name])
        elif name in ("ISO-8859-1", "windows-1252"):
            text = F.regexp_replace(text, "[^\x00-\xff]", "?")
        encode = F.pandas_udf(lambda s, c=codec: s.map(lambda t: t.encode(c)), "binary")
        raw = part.select(*KEY, encode(text).alias("raw"))
        back = src.decode_lines(raw, name).select(*KEY, "line")
        out = back if out is None else out.unionByName(back)
    return out


def _encoded(spark, sf_dir) -> DataFrame:
    lines = doc_lines(spark, sf_dir)
    kind = F.col("file").cast("bigint") % 4
    latin = F.encode(F.regexp_replace("line", "[^\\x00-\\xff]", "?"), "ISO-8859-1")
    bom = F.when(F.col("line_no") == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    wide = F.concat(bom, F.encode("line", "UTF-16LE"))
    raw = F.when(kind == 2, latin).when(kind == 3, wide).otherwise(F.encode("line", "UTF-8"))
    return lines.select(
        "file", raw.alias("raw"), F.lit(0).cast("bigint").alias("_split"),
        F.col("line_no").alias("_row"),
    )


@job
def detect_encoding(spark, sf_dir):
    return src.detect_encoding(_encoded(spark, sf_dir))


@job
def detect_encoding_lenient(spark, sf_dir):
    return src.detect_encoding(_encoded(spark, sf_dir), "ref")


@job
def file_stats(spark, sf_dir):
    return src.file_stats(doc_lines(spark, sf_dir))


@job
def size_labels(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", src.size_label(size.cast("bigint") * 97).alias("size_label")
    )


@job
def file_changes(spark, sf_dir):
    """Two listings: benchmark texts as the earlier files, documents as the later ones."""
    def files(name, key):
        return table(spark, sf_dir, name).select(
            F.col(key).cast("string").alias("path"),
            F.octet_length("text").cast("bigint").alias("size"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"),
        )

    return src.file_changes(files("benchmark", "item_id"), files("documents", "doc_id"))


@job
def file_moves(spark, sf_dir):
    """Documents as files of two listings: moved, moved and grown, grown, removed and replaced ones."""
    kind, text, name = F.col("doc_id") % 5, F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents")

    def files(rows, path, content):
        return rows.select(
            path.alias("path"), F.octet_length(content).cast("bigint").alias("size"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"),
            F.substring(F.encode(content, "UTF-8"), 1, 1024).alias("head"))

    later = F.when(kind.isin(1, 2), F.concat(text, F.lit("\nmore"))).when(kind == 4, F.concat(F.lit("new "), text)).otherwise(text)
    return src.file_moves(
        files(docs, name, text),
        files(docs.filter(kind != 3), F.when(kind < 2, F.concat(F.lit("old/"), name)).otherwise(name), later))


@job
def list_tree(spark, sf_dir):
    """Documents written as a log each, then listed with their first bytes."""
    path = fresh_path(spark, "tree")
    src.write_logs(doc_lines(spark, sf_dir), path, 1 << 20)
    return src.list_tree(spark, path).select(
        F.regexp_extract("path", "[^/]+$", 0).alias("name"), "size", F.hex("head").alias("head"))


@job
def export_range(spark, sf_dir):
    """Parts of a range of lines, written per file and read back in order."""
    path = fresh_path(spark, "export")
    ops.export_lines(doc_lines(spark, sf_dir), 5, 2, path, columns=(0, 30), per_file=True)
    order = Window.partitionBy("file").orderBy("part", F.monotonically_increasing_id())
    return src.read_logs(spark, path).select("file", F.row_number().over(order).alias("pos"), "line")


# -- text --------------------------------------------------------------------------

def _tabbed(spark, sf_dir) -> DataFrame:
    return doc_lines(spark, sf_dir).withColumn("line", F.replace("line", F.lit(" the "), F.lit("\t")))


@job
def expand_tabs_lines(spark, sf_dir):
    return _tabbed(spark, sf_dir).select(*KEY, expand_tabs("line").alias("shown"))


@job
def visible_lengths(spark, sf_dir):
    return _tabbed(spark, sf_dir).select(*KEY, visible_length("line").alias("n"))


@job
def line_portion(spark, sf_dir):
    return doc_lines(spark, sf_dir).select(*KEY, portion("line", 12, 5).alias("part"))


@job
def word_under_column(spark, sf_dir):
    word = doc_lines(spark, sf_dir).select(*KEY, word_at("line", 10).alias("w"))
    return word.select(
        *KEY, "w.word", F.col("w.start").alias("word_start"), F.col("w.end").alias("word_end")
    )


# -- search ------------------------------------------------------------------------

@job
def search_regex(spark, sf_dir):
    return ops.search(doc_lines(spark, sf_dir), PATTERN)


@job
def search_icase(spark, sf_dir):
    return ops.search(doc_lines(spark, sf_dir), "^(THE|and) ", ignore_case=True)


@job
def search_fixed(spark, sf_dir):
    return ops.search(doc_lines(spark, sf_dir), "and.", syntax="fixed")


@job
def search_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    name = F.concat_ws("/", "conv_id", "turn")
    return ops.search(src.lines_from_table(turns, name, "text"), PATTERN)


@job
def search_any(spark, sf_dir):
    terms = [Term("and.", syntax="fixed"), Term("^WITH", True), Term("[0-9]{4}")]
    return ops.search_any(doc_lines(spark, sf_dir), terms)


@job
def search_empty(spark, sf_dir):
    return ops.search(doc_lines(spark, sf_dir), "")


@job
def match_count(spark, sf_dir):
    return ops.match_count(doc_lines(spark, sf_dir), PATTERN)


@job
def is_match(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.is_match(lines, ops.search(lines, PATTERN)).drop("line")


@job
def matches_max_length(spark, sf_dir):
    return ops.matches_max_length(ops.search(doc_lines(spark, sf_dir), PATTERN))


@job
def search_update(spark, sf_dir):
    """The first half of each file was searched before; now the whole file is there."""
    lines = doc_lines(spark, sf_dir)
    done = lines.groupBy("file").agg(F.floor((F.max("line_no") + 1) / 2).alias("processed"))
    last = done.withColumn("_last", F.col("processed") - 1)
    earlier = attach_per_file(ops.search(lines, PATTERN), last, "_last").filter(
        "line_no < processed"
    ).select(*lines.columns)
    return ops.search_update(earlier, lines, done, PATTERN)


def _grown(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A ranged table that grew once, its ranges, and how far each file was there before: not at all, or half."""
    lines, path = doc_lines(spark, sf_dir), fresh_path(spark, "ranged")
    half = lines.groupBy("file").agg(F.floor((F.max("line_no") + 1) / 2).alias("processed"))
    known = half.filter(F.col("file").cast("bigint") % 5 > 0)
    both = lines.join(known, "file", "left").withColumn("_old", F.col("line_no") < F.coalesce("processed", F.lit(0)))
    for old in (True, False):
        src.append_ranged_table(both.filter(F.col("_old") == old).select(*lines.columns), path, width=32)
    return src.read_ranged_table(spark, path), src.read_ranges(spark, path), known


@job
def search_update_ranged(spark, sf_dir):
    """Files of different progress in a table laid out by line ranges; a fifth of them is new."""
    lines, ranges, known = _grown(spark, sf_dir)
    earlier = ops.search(lines, PATTERN).join(known, "file").filter("line_no < processed").select("file", "line_no", "line")
    return ops.search_update(earlier, lines, known, PATTERN, ranges=ranges)


@job
def page_ranged(spark, sf_dir):
    return ops.page(_grown(spark, sf_dir)[0], 30, 5).drop("line_range")


@job
def line_ranges(spark, sf_dir):
    return _grown(spark, sf_dir)[1]


# -- spans and find ----------------------------------------------------------------

@job
def spans(spark, sf_dir):
    found = ops.spans(doc_lines(spark, sf_dir), PATTERN)
    return found.select(
        *KEY, F.concat_ws(",", F.transform("spans", lambda s: s["start"].cast("string"))).alias("starts"),
        F.size("spans").alias("n_spans"),
    )


@job
def explode_spans(spark, sf_dir):
    return ops.explode_spans(doc_lines(spark, sf_dir), PATTERN)


@job
def span_counts(spark, sf_dir):
    return doc_lines(spark, sf_dir).select(*KEY, span_count("line", PATTERN).alias("n_spans"))


@job
def find_next(spark, sf_dir):
    return ops.find_next(doc_lines(spark, sf_dir), PATTERN, 3, 10)


@job
def find_prev(spark, sf_dir):
    return ops.find_prev(doc_lines(spark, sf_dir), PATTERN, 3, 60)


def _anchors(lines: DataFrame) -> DataFrame:
    return lines.filter("line_no % 7 = 3").select(*KEY, F.lit(20).alias("col"))


@job
def find_next_bulk(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.find_next_bulk(_anchors(lines), lines, PATTERN)


@job
def find_prev_bulk(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.find_prev_bulk(_anchors(lines), lines, PATTERN)


@job
def find_selected_next(spark, sf_dir):
    return ops.find_selected(doc_lines(spark, sf_dir), 0, 2)


@job
def find_selected_prev(spark, sf_dir):
    return ops.find_selected(doc_lines(spark, sf_dir), 3, 2, direction="prev")


# -- rules -------------------------------------------------------------------------

@job
def classify(spark, sf_dir):
    return ops.classify(doc_lines(spark, sf_dir), RULES).drop("line")


@job
def rule_counts(spark, sf_dir):
    return ops.rule_counts(ops.classify(doc_lines(spark, sf_dir), RULES))


def _stored_rules(spark, sf_dir) -> DataFrame:
    """A rule per event type, in the order of their first letters."""
    return table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.ascii("event_type").alias("priority"),
        F.concat(F.upper("event_type"), F.lit(" user=1")).alias("pattern"),
        F.lit(True).alias("ignore_case"), F.col("event_type").alias("fore"),
        F.lit("white").alias("back"),
    )


@job
def classify_join(spark, sf_dir):
    rules = _stored_rules(spark, sf_dir)
    return ops.classify_join(event_lines(spark, sf_dir), rules).drop("line")


@job
def classify_join_long_list(spark, sf_dir):
    """Over 300 more rules that are tried first and match nothing, some tied with real ones."""
    rules = _stored_rules(spark, sf_dir)
    none = spark.range(320).select(
        (-F.col("id")).cast("int").alias("priority"), F.concat(F.lit("no such text "), "id").alias("pattern"),
        F.lit(False).alias("ignore_case"), F.lit("x").alias("fore"), F.lit("x").alias("back"))
    tied = rules.withColumn("ignore_case", F.lit(False)).withColumn("fore", F.lit("tied"))
    empty = rules.withColumn("pattern", F.lit(None).cast("string")).withColumn("priority", F.lit(-1))
    every = rules.unionByName(none).unionByName(tied).unionByName(empty)
    return ops.classify_join(event_lines(spark, sf_dir), every).drop("line")


# -- marks -------------------------------------------------------------------------

@job
def marks_add(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    beyond = lines.filter("line_no % 4 = 0").select("file", (F.col("line_no") + 3).alias("line_no"))
    return ops.add_marks(tenth(lines), beyond, lines)


@job
def marks_delete(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.delete_marks(tenth(lines), lines.filter("line_no % 4 = 0"))


@job
def marks_clear(spark, sf_dir):
    return ops.clear_marks(tenth(doc_lines(spark, sf_dir)), "0")


@job
def marks_toggle(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.toggle_marks(tenth(lines), lines.filter("line_no % 4 = 0"), lines)


@job
def mark_after(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.mark_after(lines.select(*KEY), tenth(lines))


@job
def mark_before(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.mark_before(lines.select(*KEY), tenth(lines))


@job
def marks_stats(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.marks_stats(tenth(lines), lines)


# -- filtered view -----------------------------------------------------------------

def _view(spark, sf_dir, visibility="BOTH") -> DataFrame:
    lines = doc_lines(spark, sf_dir)
    return ops.filtered_search(lines, PATTERN, tenth(lines), visibility)


def _indexed(spark, sf_dir, *columns: str) -> DataFrame:
    """The indexed view, stored once: what follows reads it more than once."""
    path = fresh_path(spark, "view")
    keep = columns or ("file", "line_no", "item_type", "idx")
    src.write_lines_table(ops.filtered_index(_view(spark, sf_dir)).select(*keep), path)
    return src.read_lines_table(spark, path)


@job
def filtered_both(spark, sf_dir):
    return _view(spark, sf_dir)


@job
def filtered_marks(spark, sf_dir):
    return _view(spark, sf_dir, "MARKS")


@job
def filtered_matches(spark, sf_dir):
    return _view(spark, sf_dir, "MATCHES")


@job
def filtered_from_sets(spark, sf_dir):
    """Both sets given as tables: a search of two terms, and marks."""
    lines = doc_lines(spark, sf_dir)
    return ops.filtered(lines, ops.search_any(lines, [PATTERN, "[0-9]{4}"]), tenth(lines))


@job
def filtered_index(spark, sf_dir):
    return ops.filtered_index(_view(spark, sf_dir)).drop("line")


@job
def index_to_line(spark, sf_dir):
    return ops.index_to_line(ops.filtered_index(_view(spark, sf_dir)), 2)


@job
def line_to_index(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.line_to_index(lines.select(*KEY), _view(spark, sf_dir))


@job
def filtered_stats(spark, sf_dir):
    return ops.filtered_stats(_view(spark, sf_dir))


@job
def line_types(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.line_types(lines, ops.search(lines, PATTERN), tenth(lines)).drop("line")


@job
def next_marked(spark, sf_dir):
    return ops.next_marked(_indexed(spark, sf_dir))


@job
def prev_marked(spark, sf_dir):
    return ops.prev_marked(_indexed(spark, sf_dir))


@job
def find_next_filtered(spark, sf_dir):
    return ops.find_next(_view(spark, sf_dir), "ing", 1, 0)


# -- paging and overview -----------------------------------------------------------

@job
def page(spark, sf_dir):
    return ops.page(_tabbed(spark, sf_dir), 3, 5, expanded=True)


@job
def page_filtered(spark, sf_dir):
    return ops.page(ops.filtered_index(_view(spark, sf_dir)), 1, 3, by="idx")


@job
def tail(spark, sf_dir):
    return ops.tail(doc_lines(spark, sf_dir), 3)


@job
def context(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return ops.context(lines, ops.search(lines, "[0-9]{4}"), 2)


@job
def range_max_length(spark, sf_dir):
    return ops.range_max_length(doc_lines(spark, sf_dir), 2, 6)


@job
def overview(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    totals = lines.groupBy("file").agg(F.count("*").alias("n_lines"))
    shown = ops.overview(_view(spark, sf_dir), totals, 5)
    return shown.withColumn("opacity", F.round("opacity", 6))


# -- timing and history ------------------------------------------------------------

def _durations(spark, sf_dir) -> DataFrame:
    even = F.regexp_extract("line", r"user=(\d+)", 1).cast("bigint") % 2 == 0
    stamp = F.regexp_extract("line", r"^\S+ \S+", 0).try_cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), stamp)
    return pair_durations(
        event_lines(spark, sf_dir), " click ", " error ", time=micros / 1e6, guard=even)


@job
def pair_event_durations(spark, sf_dir):
    return _durations(spark, sf_dir).withColumn("duration", F.round("duration", 3))


@job
def histogram_of_durations(spark, sf_dir):
    return duration_histogram(_durations(spark, sf_dir), 60.0)


@job
def recent_users(spark, sf_dir):
    return ops.recent(table(spark, sf_dir, "events"), "user_id", "ts")


# -- following files ---------------------------------------------------------------

def _run(writer, spark: SparkSession):
    """One pass over what is there now."""
    query = (
        writer.option("checkpointLocation", fresh_path(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


@job
def follow_search(spark, sf_dir):
    stream = st.follow(spark, write_corpus(spark, sf_dir))
    out = fresh_path(spark, "followed")
    _run(st.follow_search(stream, PATTERN).writeStream.format("parquet").option("path", out), spark)
    got = untag(spark.read.parquet(out))
    return got.select("doc", "epoch", "terminated", "line")


@job
def follow_counts(spark, sf_dir):
    """Running counts of each log."""
    folder, out = fresh_path(spark, "logs"), fresh_path(spark, "counts")
    _write_logs(_log_lines(spark, sf_dir), folder, closed=True)

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    counts = st.follow_counts(st.follow(spark, folder), PATTERN)
    _run(counts.writeStream.outputMode("complete").foreachBatch(store), spark)
    return spark.read.parquet(out).select(
        _log_of("file").alias("log"), "epoch", "n_lines", "n_matches", "max_length")


LOGS = 20


def _log_lines(spark, sf_dir) -> DataFrame:
    """Every line's log (of LOGS), and its phase: the first three lines of a document come before all others."""
    lines = doc_lines(spark, sf_dir)
    return lines.select(
        (F.col("file").cast("bigint") % LOGS).alias("log"), (F.col("line_no") >= 3).cast("int").alias("phase"),
        F.col("file").cast("bigint").alias("doc"), "line_no", F.concat_ws("|", "file", "line_no", "line").alias("text"))


def _write_logs(lines: DataFrame, folder: str, closed: bool) -> None:
    """One growing file a log, streamed by the task that holds its sorted lines."""
    def write(batches):
        at, out, n = None, None, 0
        for batch in batches:
            for log, text in zip(batch.column("log").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if log != at:
                    finish(out)
                    fs, inner = open_fs(f"{folder}/{log}.log")
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    at, out = log, fs.open_output_stream(inner)
                else:
                    out.write(b"\n")
                out.write(text.encode())
                n += 1
        finish(out)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    def finish(out):
        if out is not None:
            if closed:
                out.write(b"\n")
            out.close()

    folder = qualified(lines.sparkSession, folder)  # a path without a scheme is one of Spark's default file system
    placed = lines.repartition(LOGS, "log").sortWithinPartitions("log", "phase", "doc", "line_no")
    placed.select("log", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _log_of(file: str) -> Column:
    return F.regexp_extract(file, r"(\d+)\.log", 1).cast("bigint")


@job
def follow_numbered(spark, sf_dir):
    """Two batches: the logs grow in between, and a line cut in two is whole in the end."""
    folder, out, counters = (fresh_path(spark, x) for x in ("logs", "numbered", "counters"))
    checkpoint, lines = fresh_path(spark, "checkpoint"), _log_lines(spark, sf_dir)
    for part, closed in ((lines.filter("phase = 0"), False), (lines, True)):
        _write_logs(part, folder, closed)
        writer = st.follow_numbered(st.follow(spark, folder), out, counters)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = untag(spark.read.parquet(out))
    return got.select(_log_of("file").alias("log"), "doc", "line_no", "epoch", "byte_start", "line")


@job
def follow_epochs(spark, sf_dir):
    """Current lines of logs that grew once, and of which every other was then cut back.

    The last line of the logs is open until they grow; in those cut back it stays open.
    """
    folder, out, checkpoint = (fresh_path(spark, x) for x in ("logs", "followed", "checkpoint"))
    lines = _log_lines(spark, sf_dir)
    start = lines.filter("phase = 0")
    for part, closed in ((start, False), (lines, True), (start.filter("log % 2 = 0"), False)):
        _write_logs(part, folder, closed)
        stream = st.follow(spark, folder, emit_partial=True)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    received = spark.read.parquet(out)
    now = st.current_epoch(st.latest_lines(received), st.epochs_of(received))
    return untag(now).select(_log_of("file").alias("log"), "doc", "epoch", "terminated", "line")


@job
def follow_view(spark, sf_dir):
    """Matches and marks of logs that grew, and of which every other was then cut back and lost its marks.

    Every tenth line of a document is marked before it arrives.
    """
    folder, out, checkpoint, marks = (fresh_path(spark, x) for x in ("logs", "view", "checkpoint", "marks"))
    lines = _log_lines(spark, sf_dir)
    start = lines.filter("phase = 0")
    for part, truncated in ((start, False), (lines, False), (start.filter("log % 2 = 0"), True)):
        _write_logs(part, folder, closed=True)
        if not truncated:
            placed = src.scan_lines(spark, folder, "UTF-8", positions=True)
            placed.filter(F.split("line", r"\|", 3)[1].cast("bigint") % 10 == 0).select(
                "file", F.lit(0).cast("bigint").alias("epoch"), "byte_start").write.mode("append").parquet(marks)
        writer = st.follow_view(st.follow(spark, folder), PATTERN, marks, out)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return untag(st.view_of(spark, out)).select(_log_of("file").alias("log"), "doc", "epoch", "item_type", "line")


@job
def follow_upserted(spark, sf_dir):
    """The lines of ``follow_epochs``, kept current batch by batch."""
    folder, out, checkpoint = (fresh_path(spark, x) for x in ("logs", "upserted", "checkpoint"))
    lines = _log_lines(spark, sf_dir)
    start = lines.filter("phase = 0")
    for part, closed in ((start, False), (lines, True), (start.filter("log % 2 = 0"), False)):
        _write_logs(part, folder, closed)
        writer = st.follow_upsert(st.follow(spark, folder, emit_partial=True), out)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    current = st.upserted(spark, out)
    now = st.current_epoch(current, st.epochs_of(current))
    return untag(now).select(_log_of("file").alias("log"), "doc", "epoch", "terminated", "line")


def _watched(spark, sf_dir) -> str:
    """Where a search of a stored table, about five steps, has left its matches and progress.

    The table has as many files as its scan has tasks, five or more, so that no task's share grows with the input.
    """
    path, out = fresh_path(spark, "lines"), fresh_path(spark, "watched")
    n_files = max(5, 4 * table(spark, sf_dir, "documents").rdd.getNumPartitions())
    src.write_lines_table(doc_lines(spark, sf_dir).repartition(n_files, "file"), path)
    st.search_with_progress(spark, path, PATTERN, out, files_per_step=-(-n_files // 5)).awaitTermination()
    return out


@job
def search_watched(spark, sf_dir):
    return spark.read.parquet(f"{_watched(spark, sf_dir)}/matches").select(*KEY, "line")


@job
def search_progress(spark, sf_dir):
    """The last row of progress, and whether lines and percent grew with every step."""
    steps = st.progress_of(spark, _watched(spark, sf_dir))
    before = Window.orderBy("step")
    grew = (F.col("n_lines") > F.lag("n_lines", 1, 0).over(before)) & (F.col("percent") >= F.lag("percent", 1, 0).over(before))
    return steps.withColumn("grew", grew).agg(
        (F.count("*") > 1).alias("several"), F.bool_and("grew").alias("grew"), F.max("n_lines").alias("n_lines"),
        F.max("n_matches").alias("n_matches"), F.max("percent").alias("percent"))


@job
def batch_status(spark, sf_dir):
    """Three batches: a third of the documents is added before each."""
    path, out = fresh_path(spark, "corpus"), fresh_path(spark, "status")
    checkpoint = fresh_path(spark, "checkpoint")
    lines = doc_lines(spark, sf_dir)
    for k in range(3):
        part = lines.filter(F.col("file").cast("bigint") % 3 == k)
        part.select("line").write.mode("append").text(path)
        writer = st.follow_status(st.follow(spark, path), PATTERN, out)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return st.batch_status(spark, out)
