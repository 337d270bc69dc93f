"""Text files to numbered lines with byte positions.

``scan_lines`` reads raw bytes split at LF by Spark's own text source, so files
are split and read in parallel.  Numbering and byte positions need one small
summary row per file split (count, first row, bytes): the summary pass reads no
text into a shuffle, and the lines themselves are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.functions.text import visible_length
from linewell.operators.ordered import total_in_place
from linewell.sources.encoding import (
    AUTO_READER, READERS, decode_column, detect_encoding, encoding_facts,
)
from linewell.sources.listing import listing
from linewell.shared import fresh_path

# Names of files that Spark reads through a decompressor.
COMPRESSED = r"\.(gz|bz2|lz4|snappy|deflate|zst|zstd|xz)$"

SPLIT = ("file", "_split")

_EMPTY = "file string, raw binary, _split bigint, _row bigint, _size bigint, _mtime timestamp"


def _open(reader: DataFrameReader, paths: list[str]) -> DataFrame | None:
    try:
        return reader.text(paths) if paths else None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _existing(reader: DataFrameReader, paths: list[str]) -> list[str]:
    """The paths that exist, found by halving the list."""
    if _open(reader, paths) is not None:
        return paths
    if len(paths) < 2:
        return []
    half = len(paths) // 2
    return _existing(reader, paths[:half]) + _existing(reader, paths[half:])


def raw_lines(
    spark: SparkSession,
    paths: str | Iterable[str],
    encoding: str = "UTF-8",
    missing_ok: bool = True,
) -> DataFrame:
    """Undecoded lines: file, raw bytes and the bookkeeping columns ``_*``.

    Duplicate paths are read once.  Missing paths are empty unless
    ``missing_ok`` is false.  Only LF ends a line, a CR stays in it.  A path named
    ``_x`` or ``.x`` is an error; such files inside folders are left out.
    """
    paths = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    hidden = [p for p in paths if p.rstrip("/").rsplit("/", 1)[-1].startswith(("_", "."))
              and p.rstrip("/").rsplit("/", 1)[-1] not in (".", "..")]
    if hidden:
        # Spark's file listing would leave them out without a word.
        raise ValueError(f"names that begin with '_' or '.' cannot be read: {hidden}")
    reader = spark.read.option("lineSep", "\n")
    if encoding.upper().startswith("UTF-16"):
        # The source searches the separator in this encoding; values stay raw bytes.
        reader = reader.option("encoding", encoding)
    if not paths:
        return spark.createDataFrame([], _EMPTY)
    if not missing_ok:
        found = reader.text(paths)
    else:
        found = _open(reader, paths)
        found = _open(reader, _existing(reader, paths)) if found is None else found
    if found is None:
        return spark.createDataFrame([], _EMPTY)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("value").cast("binary").alias("raw"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_modification_time").alias("_mtime"),
    )


def separator_bytes(encoding: str) -> int:
    return 2 if encoding.upper().startswith("UTF-16") else 1


def scan_lines(
    spark: SparkSession,
    paths: str | Iterable[str],
    encoding: str = "auto",
    missing_ok: bool = True,
    positions: bool = False,
) -> DataFrame:
    """Numbered, decoded lines of one or many files.

    ``encoding="auto"`` costs one more pass that guesses each file's encoding;
    name the encoding to skip it.  ``positions=True`` adds byte_start, byte_end
    and terminated.
    """
    if encoding.lower() != "auto":
        encoding = READERS.get(encoding.upper(), encoding)
        return _scan_as(spark, paths, encoding, missing_ok, positions)
    raw = raw_lines(spark, paths, missing_ok=missing_ok)
    path = fresh_path(spark, "encodings")
    detect_encoding(raw).select("file", "reader_encoding").write.parquet(path)
    guesses = spark.read.parquet(path)
    # Files whose lines end in a single LF byte are one scan, whatever their encodings.
    text = F.when(F.col("reader_encoding") == "UTF-8", decode_column(spark, F.col("raw"), "UTF-8")).otherwise(
        decode_column(spark, F.col("raw"), "ISO-8859-1"))
    numbered = number_lines(raw, positions=positions, facts=guesses)
    out = _kept(_with_line(numbered, text).filter(
        F.col("reader_encoding").isin("UTF-8", "ISO-8859-1")), positions)
    for wide in ("UTF-16LE", "UTF-16BE"):
        if files := _files_read_as(guesses, wide):
            own = number_lines(raw_lines(spark, files, wide), wide, positions)
            out = out.unionByName(_kept(decode_lines(own, wide), positions))
    return out


def _files_read_as(guesses: DataFrame, encoding: str) -> list[str]:
    """Paths of the files of one reader encoding, to be read again; named one by one, as paths are."""
    chosen = guesses.filter(F.col("reader_encoding") == encoding).select("file")
    # From the URI back to a path whose special characters stand for themselves.
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(r["file"])) for r in chosen.collect()]


def _scan_as(spark, paths, encoding, missing_ok, positions) -> DataFrame:
    df = raw_lines(spark, paths, encoding, missing_ok)
    df = number_lines(df, encoding=encoding, positions=positions)
    return _kept(decode_lines(df, encoding), positions)


def _kept(df: DataFrame, positions: bool) -> DataFrame:
    keep = ["file", "line_no", "line"]
    return df.select(*keep, *(["byte_start", "byte_end", "terminated"] if positions else []))


def split_summary(df: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """Per file split: its first row id, the lines and bytes before it in the file."""
    width = (F.octet_length("raw") + separator_bytes(encoding)).cast("bigint")
    sums = df.groupBy(*SPLIT).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first"), F.sum(width).alias("_bytes")
    )
    # One row per split, so even one huge file is a small window partition.
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0).cast("bigint")
    return sums.select(
        *SPLIT, "_n", "_first",
        F.coalesce(F.sum("_n").over(earlier), zero).alias("_lines_before"),
        F.coalesce(F.sum("_bytes").over(earlier), zero).alias("_bytes_before"),
    )


def number_lines(
    df: DataFrame, encoding: str = "UTF-8", positions: bool = False, facts: DataFrame | None = None
) -> DataFrame:
    """Add ``line_no`` (0-based) and ``display_no`` (1-based) per file to ``raw_lines``.

    Row ids are consecutive inside a split, so a line's number is its split's
    offset plus the distance from the split's first row.  The summary is
    computed here, once; should the files be split differently afterwards, the
    job fails instead of losing or misnumbering lines.  ``positions`` adds
    byte_start, byte_end (past the LF) and terminated; compressed files have none
    of them and fail the job.  ``facts`` has a row for each file, whose other columns
    reach the lines along with their split's offset.
    """
    separator = separator_bytes(encoding)
    # Written and read again: computed once, and of a size Spark knows when it picks the join.
    path = fresh_path(df.sparkSession, "splits")
    summary = split_summary(df, encoding)
    (summary.join(facts, "file", "left") if facts is not None else summary).write.parquet(path)
    offsets = df.sparkSession.read.parquet(path)
    body = _with_split_offset(df, separator) if positions else df
    inside = F.col("_row") - F.col("_first")
    number = F.when(
        inside.between(F.lit(0), F.col("_n") - 1), F.col("_lines_before") + inside
    ).otherwise(
        F.raise_error(F.lit("file splits changed while numbering lines; run again"))
    )
    out = (
        body.join(offsets, [*SPLIT], "left")
        .withColumn("line_no", number)
        .withColumn("display_no", F.col("line_no") + 1)
    )
    if positions:
        start = F.when(F.col("file").rlike(COMPRESSED), F.raise_error(F.lit(
            "a compressed file has no byte positions; read it without them"))).otherwise(
            F.col("_bytes_before") + F.col("_offset"))
        end = start + F.octet_length("raw") + separator
        out = (
            out.withColumn("byte_start", start)
            .withColumn("byte_end", end)
            .withColumn("terminated", F.col("byte_end") <= F.col("_size"))
        )
    return out.drop("_n", "_first", "_lines_before", "_bytes_before", "_offset")


def _with_split_offset(df: DataFrame, separator: int) -> DataFrame:
    """Add ``_offset``: bytes of the split's lines before this one.

    A task reads its splits one after the other in file order, so a running sum
    over its Arrow batches needs neither a shuffle nor a sort of the text.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_offset", T.LongType())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, last_key = 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            width = pc.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(width.astype(np.int64) + separator)])
            files, splits = batch.column("file"), batch.column("_split")
            changed = pc.or_(
                pc.not_equal(files[1:], files[:-1]), pc.not_equal(splits[1:], splits[:-1])
            )
            starts = np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1
            run = np.searchsorted(starts, np.arange(batch.num_rows), side="right")
            base = np.concatenate([[0], before[starts]])
            # The first run may continue the split the last batch ended in.
            base[0] = -carry if (files[0].as_py(), splits[0].as_py()) == last_key else 0
            offset = before[:-1] - base[run]
            last_key = (files[-1].as_py(), splits[-1].as_py())
            carry = int(before[-1] - base[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(offset, pa.int64())],
                names=[*batch.schema.names, "_offset"],
            )

    return df.mapInArrow(running, schema)


def decode_lines(df: DataFrame, encoding: str) -> DataFrame:
    """Add ``line``: the decoded ``raw``.  A byte order mark on line 0 is dropped."""
    return _with_line(df, decode_column(df.sparkSession, F.col("raw"), encoding))


def _with_line(df: DataFrame, text: Column) -> DataFrame:
    if "line_no" in df.columns:
        bom = (F.col("line_no") == 0) & F.startswith("_text", F.lit("\ufeff"))
        line = F.when(bom, F.substring("_text", F.lit(2), F.length("_text"))).otherwise(
            F.col("_text")
        )
    else:
        line = F.col("_text")
    return df.withColumn("_text", text).withColumn("line", line).drop("_text")


def file_stats(lines: DataFrame) -> DataFrame:
    """Per file: lines, characters and longest displayed line of a lines DataFrame."""
    return lines.groupBy("file").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
        F.max(visible_length("line")).alias("max_length"),
    )


def file_info(spark: SparkSession, paths: str | Iterable[str], mode: str = "strict") -> DataFrame:
    """All facts of each file: file, size, size_label, mtime, n_lines, max_length, guess, reader_encoding.

    ``max_length`` is the longest displayed line, decoded by the guess.  One pass over
    the files; only UTF-16 files are read once more, split at their own separator.
    Empty files have no lines, length 0 and the guess of plain text.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def longest(encoding: str) -> Column:
        return F.max(visible_length(decode_column(spark, F.col("raw"), encoding)))

    raw = raw_lines(spark, paths)
    facts = encoding_facts(raw, mode, F.count("*").alias("_n"), longest("UTF-8").alias("_utf8"),
                           longest("ISO-8859-1").alias("_latin"))
    narrow = facts.withColumns({"n_lines": F.col("_n"), "max_length": F.when(
        F.col("reader_encoding") == "UTF-8", F.col("_utf8")).otherwise(F.col("_latin"))})
    keep = ["file", "guess", "reader_encoding", "n_lines", "max_length"]
    path = fresh_path(spark, "file-facts")
    narrow.select(keep).write.parquet(path)
    stored = spark.read.parquet(path)
    known = stored.filter(~F.startswith("reader_encoding", F.lit("UTF-16")))
    for wide in ("UTF-16LE", "UTF-16BE"):
        chosen = stored.filter(F.col("reader_encoding") == wide)
        if files := _files_read_as(stored, wide):
            own = number_lines(raw_lines(spark, files, wide), wide)
            counts = decode_lines(own, wide).groupBy("file").agg(
                F.count("*").alias("n_lines"), F.max(visible_length("line")).alias("max_length"))
            known = known.unionByName(chosen.drop("n_lines", "max_length").join(counts, "file"))
    files = listing(spark, paths)
    whole = files.withColumnRenamed("path", "file").join(known, "file", "left")
    return whole.select(
        "file", "size", size_label("size").alias("size_label"), "mtime",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("max_length", F.lit(0)).alias("max_length"),
        F.coalesce("guess", F.lit("ASCII7")).alias("guess"),
        F.coalesce("reader_encoding", F.lit(AUTO_READER["ASCII7"])).alias("reader_encoding"))


# Size units, 1024 apart.
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def size_label(size: Column | str) -> Column:
    """A size in bytes as text: whole bytes, else one decimal and a binary unit."""
    size = F.col(size) if isinstance(size, str) else size
    label = None
    for power, unit in enumerate(SIZE_UNITS):
        if power == 0:
            text = F.concat(F.format_number(size, 0), F.lit(f" {unit}"))
        else:
            text = F.concat(F.format_number(size / F.lit(1024.0**power), 1), F.lit(f" {unit}"))
        if power == len(SIZE_UNITS) - 1:
            return label.otherwise(text)
        limit = F.lit(1024 ** (power + 1))
        label = F.when(size < limit, text) if label is None else label.when(size < limit, text)


def line_positions(lines: DataFrame, separator: int = 1, **chunking) -> DataFrame:
    """Byte positions of any numbered (file, line_no, line) table, in UTF-8 bytes.

    For tables whose lines did not come from ``raw_lines``.  byte_end lies past
    the separator, as if the last line had one too.  The lines are stored once,
    where they are; no text is shuffled.
    """
    width = F.octet_length("line") + separator
    return total_in_place(lines, "byte_start", width, **chunking).withColumn(
        "byte_end", F.col("byte_start") + width
    )
