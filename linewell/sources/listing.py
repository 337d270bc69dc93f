"""What changed between two listings of a set of files."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(path, size, mtime) of every file; no file content is read.

    ``path`` is written as ``scan_lines`` writes ``file``.  Spark plans no reads for empty
    files, so they are added from the listing that the driver holds anyway.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = spark.read.format("binaryFile").load(paths)
    full = found.select(
        F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"))
    # The two lists differ in how they write a missing authority.
    uris = [re.sub(r"^([^:/]+):///", r"\1:/", n) for n in found.inputFiles()]
    names = spark.createDataFrame([(n,) for n in uris], "path string")
    empty = [r.path for r in names.join(full, "path", "left_anti").collect()]
    rows = [(n, 0, _modified(spark, n)) for n in empty]
    none = spark.createDataFrame(rows, "path string, size bigint, ms bigint")
    return full.unionByName(none.select("path", "size", F.timestamp_millis("ms").alias("mtime")))


def _modified(spark: SparkSession, uri: str) -> int:
    """Modification time of one file in milliseconds."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return status.getModificationTime()


def file_changes(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Per path CREATED, DELETED, DATA_ADDED, TRUNCATED or UNCHANGED.

    Size decides, as for a followed file.  A same-sized file with another
    modification time is UNCHANGED with ``touched`` set.
    """
    old = prev.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("_old"))
    new = cur.select("path", F.col("size").alias("new_size"), F.col("mtime").alias("_new"))
    change = (
        F.when(F.col("old_size").isNull(), "CREATED")
        .when(F.col("new_size").isNull(), "DELETED")
        .when(F.col("new_size") > F.col("old_size"), "DATA_ADDED")
        .when(F.col("new_size") < F.col("old_size"), "TRUNCATED")
        .otherwise("UNCHANGED")
    )
    return old.join(new, "path", "full_outer").select(
        "path", change.alias("change"), "old_size", "new_size",
        F.coalesce(F.col("_old") != F.col("_new"), F.lit(False)).alias("touched"),
    )
