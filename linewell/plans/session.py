"""Session settings that suit line scans at scale.  Nothing here is set behind the user's back."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Mark sets and match keys below this size travel to the lines, not the lines to them.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Keeps file splits the same while executors come and go.
    "spark.sql.files.minPartitionNum": "8",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with all recommended settings."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that do not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        stem = f"{tempfile.mkdtemp(prefix='linewell-ship-')}/linewell"
        spark.sparkContext.addPyFile(shutil.make_archive(stem, "zip", root, "linewell"))
        _shipped.add(app)
