"""Most recently used values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many searches and files are remembered.
RECENT_SEARCHES = 50
RECENT_FILES = 10


def recent(history: DataFrame, key: str, ts: str, n: int = RECENT_SEARCHES) -> DataFrame:
    """The ``n`` most recently used distinct non-empty keys, newest first.

    Equal times are ordered by key.
    """
    used = history.filter(F.col(key).cast("string") != "")
    latest = used.groupBy(key).agg(F.max(ts).alias("last_used"))
    return latest.orderBy(F.col("last_used").desc(), F.col(key)).limit(n)
