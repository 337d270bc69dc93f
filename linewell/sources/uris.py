"""File systems of URIs as Spark writes them.  Pickled by value into data source processes."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI as Spark writes it, or of a local path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs, unquote(inner)
    return pafs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URI, with the scheme and working folder that Spark would use."""
    jvm = spark.sparkContext._jvm
    plain = jvm.org.apache.hadoop.fs.Path(path)
    system = plain.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Spark leaves an empty authority out.
    return re.sub(r"^([^:/]+):///", r"\1:/", system.makeQualified(plain).toUri().toString())
