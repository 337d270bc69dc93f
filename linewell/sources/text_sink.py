"""A batch sink that writes each log of a set as ordered text files.

A task that holds sorted lines streams them out, one file for each log and part of its
lines; there are no folders and no work on the driver for each log.  A file is written
under a name of its own attempt and then takes its final name in a staging folder, so that a
task that runs again replaces what it wrote before.  The commit is one rename of the
staging folder; until then the target does not exist, and an aborted job leaves nothing.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from linewell.plans.session import ship
from linewell.sources import uris
from linewell.sources.moves import _entries

FORMAT = "linewell_text"
# File systems allow names of 255 bytes; the part and the attempt take some.
NAME_BYTES = 160
# Bytes and lines of files that a task holds when it reads them.
READ_BYTES, READ_LINES = 1 << 22, 1 << 14
# Below the staging folder: files that are being written.
ATTEMPTS = "_attempts"


def export_name(file: str, part: int) -> str:
    """Name of the text file of a log's part; names in order are parts in order.

    Characters outside letters, digits and ``_.-~`` are percent-encoded, as is a first ``_``
    or ``.``, which would hide the file; no name at all is written as NUL.  Of a long name the end stays, behind a checksum of the whole.
    """
    name = quote(file or "\0", safe="")
    if name[:1] in ("_", "."):
        name = f"%{ord(name[0]):02X}{name[1:]}"
    if len(name) > NAME_BYTES:
        name = f"{hashlib.sha1(file.encode()).hexdigest()}~{name[-(NAME_BYTES - 41):]}"
    return f"{name}.{part:010d}.txt"


@dataclass
class Written(WriterCommitMessage):
    files: int
    lines: int


class TextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, staging: str):
        self.path, self.staging = path, staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = uris.open_fs(self.staging)
        attempt, at, out = f"{folder}/{ATTEMPTS}/{uuid.uuid4().hex}", None, None
        done = Written(0, 0)

        def finish():
            if out is not None:
                out.close()
                final = f"{folder}/{export_name(*at)}"
                if fs.get_file_info(final).type != pafs.FileType.NotFound:
                    fs.delete_file(final)  # of an earlier attempt
                fs.move(attempt, final)
                done.files += 1

        for batch in iterator:
            if not batch.num_rows:
                continue
            files, parts = pc.fill_null(batch.column("file"), ""), batch.column("part")
            lines = pc.fill_null(batch.column("line").cast(pa.binary()), b"").to_pylist()
            new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(parts[1:], parts[:-1]))
            begins = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                key = files[a].as_py(), parts[a].as_py()
                if key != at:
                    finish()
                    if at is None:
                        fs.create_dir(f"{folder}/{ATTEMPTS}", recursive=True)
                    at, out = key, fs.open_output_stream(attempt)
                out.write(b"\n".join([*lines[a:b], b""]))
            done.lines += batch.num_rows
        finish()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, staging = uris.open_fs(self.staging)
        _, target = uris.open_fs(self.path)
        fs.create_dir(staging, recursive=True)
        if fs.get_file_info(f"{staging}/{ATTEMPTS}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{staging}/{ATTEMPTS}")  # with what lost attempts left in it
        with fs.open_output_stream(f"{staging}/_SUCCESS"):
            pass
        fs.move(staging, target)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staging = uris.open_fs(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class TextSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(self.options["target"], self.options["staging"])


def write_logs(lines: DataFrame, path: str, part_lines: int) -> None:
    """Write (file, line_no, line) as text, a file for each log and ``part_lines`` line numbers.

    Lines are shuffled by (file, part), so a log of any size spreads over tasks, and sorted
    within the tasks.  The path must be new; tasks write to it directly (local, HDFS,
    S3 or GCS paths).
    """
    spark = lines.sparkSession
    target = uris.qualified(spark, path).rstrip("/")
    fs, inner = uris.open_fs(target)
    if fs.get_file_info(inner).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    for module in (uris, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)  # Spark's planner process has no package of ours
    spark.dataSource.register(TextSink)
    placed = lines.select("file", F.call_function("div", "line_no", F.lit(part_lines)).alias("part"), "line_no", "line")
    placed.repartition("file", "part").sortWithinPartitions("file", "part", "line_no").select("file", "part", "line").write.format(
        FORMAT).mode("append").option("target", target).option("staging", f"{target}.{uuid.uuid4().hex}.partial").save()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, line) of the files of ``path``, each streamed; lines of small files share a batch."""
    paths, lines, held = [], [], 0

    def flush():
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.binary())], names=["path", "line"])
        paths.clear(), lines.clear()
        held = 0
        return out

    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, inner = uris.open_fs(path)
            with fs.open_input_file(inner) as file:
                rest = b""
                while data := file.read(READ_BYTES):
                    *whole, rest = (rest + data).split(b"\n")
                    paths += [path] * len(whole)
                    lines += whole
                    held += len(data)
                    if held >= READ_BYTES or len(lines) >= READ_LINES:
                        yield flush()
                if rest:
                    paths.append(path)
                    lines.append(rest)
    if lines:
        yield flush()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, line) of what ``write_logs`` wrote; long names are given as they were shortened.

    The folder is listed by one task and the files are dealt to tasks by name, however many
    they are; a file is streamed by one task, its lines in order.
    """
    ship(spark)
    folder = spark.createDataFrame([(uris.qualified(spark, path),)], "path string")
    found = folder.mapInArrow(_entries, "path string, size long, ms long, folder boolean").filter("not folder")
    rows = found.select("path").repartition(2 * spark.sparkContext.defaultParallelism, "path").mapInArrow(_read, "path string, line binary")
    name = F.regexp_extract("path", "[^/]+$", 0)
    written = F.url_decode(F.url_decode(F.regexp_extract(name, r"^(.*)\.\d+\.txt$", 1)))
    return rows.select(
        F.when(written == "\0", "").otherwise(written).alias("file"),
        F.regexp_extract(name, r"\.(\d+)\.txt$", 1).cast("bigint").alias("part"), F.col("line").cast("string").alias("line"))
