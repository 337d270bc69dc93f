"""Lines that many documents repeat, found by range-partitioned hashes.

Every line becomes (key hash, document, position).  These narrow rows are
range-partitioned by hash, then document, so that a line found everywhere still
spreads over many partitions, and are sorted by document and position.  Streaming
over that order marks the first occurrence of a key in each document; the marks are
pre-summed to document counts.  What goes back to the documents is a bitmap of 64
lines a word, holding only words in which a line is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.llm._common import BLANKS, lower_ascii, stored

HASHES = ("_h1", "_h2")
DOCUMENT = ("_d1", "_d2")


def lines_of(text: Column) -> Column:
    """The lines of a text, split at LF (null or empty: one empty line)."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """A key for each line: stripped of white space, A-Z lower-cased."""
    return F.transform(lines_of(lower_ascii(text)), lambda x: F.btrim(x, F.lit(BLANKS)))


def _document(doc_id: str, text: str) -> list[Column]:
    """96 bits that stand for a row; equal rows are equal documents."""
    return [F.xxhash64(doc_id, text).alias("_d1"), F.hash(text, doc_id).alias("_d2")]


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Bitmaps of dropped lines: ``_d1, _d2, dropped`` (map of word number to 64 bits).

    A line goes if its key has at least ``min_chars`` code points and stands in at
    least ``min_docs`` rows of ``docs``; with ``keep_first`` the first one by document
    hash and position stays.  Rows without a dropped line have no bitmap (all kept).
    Equal rows count once each and share one bitmap; null texts are one empty line;
    null ids are ids like any other.  An empty table gives no bitmap.
    """
    lines = docs.select(*_document(doc_id, text), F.posexplode(keys_of(F.col(text))))
    entries = lines.filter(F.length("col") >= min_chars).select(
        F.xxhash64("col").alias("_h1"), F.hash("col").alias("_h2"), *DOCUMENT, "pos")
    ordered = entries.repartitionByRange(*HASHES, *DOCUMENT)
    stream = Window.partitionBy(*HASHES, *DOCUMENT).orderBy("pos")
    marked = ordered.withColumn("_new", (F.col("pos") == F.first("pos").over(stream)).cast("int"))
    # Stored, so that the join below meets two plain shuffles and Spark can split a common line's rows.
    common = stored(marked.groupBy(*HASHES).agg(
        F.sum("_new").alias("_docs"), F.min(F.struct(*DOCUMENT, "pos")).alias("_first"),
    ).filter(F.col("_docs") >= min_docs), "common-lines")
    gone = entries.join(common, list(HASHES))
    if keep_first:
        gone = gone.filter(F.struct(*DOCUMENT, "pos") != F.col("_first"))
    words = gone.groupBy(*DOCUMENT, F.expr("cast(pos div 64 as int)").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("_bits"))
    return words.groupBy(*DOCUMENT).agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("dropped"))


def with_kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``row`` (the whole input row), ``n_lines``, ``n_dropped`` and ``kept`` for every row.

    ``kept`` is the text without the lines that ``keep_bitmaps`` drops, joined by LF;
    it is empty if no line stays.  Extra columns live inside ``row``, so their names
    clash with nothing.
    """
    bitmaps = keep_bitmaps(docs, doc_id, text, **rule)
    rows = docs.select(*_document(doc_id, text), F.struct("*").alias("row"))
    joined = rows.join(bitmaps, list(DOCUMENT), "left")
    dense = F.when(F.col("dropped").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.array_max(F.map_keys("dropped"))),
        lambda w: F.coalesce(F.element_at("dropped", w), F.lit(0).cast("long"))))
    split = joined.select(
        "row", lines_of(F.col("row")[text]).alias("_lines"), dense.alias("_dense"))
    kept = F.expr(
        "filter(_lines, (x, i) -> coalesce(getbit(get(_dense, cast(i div 64 as int)), "
        "cast(i % 64 as int)), 0) = 0)")
    return split.select(
        "row", F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_dense").isNull(), F.col("_lines")).otherwise(kept).alias("_kept"),
    ).select(
        "row", "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept"))
