"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewell.plans.session import ship
from linewell.sources.shared import fresh_path

#: White space of the line and word contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A double strictly between 0 and 1, decided by the values of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, its size known to Spark."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder whose readers are done, and the shuffle files behind it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    released(spark)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished work: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
