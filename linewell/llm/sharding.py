"""Shards by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws -ln(u) / weight from a hash of the key and the
child's path; the smallest draw wins, so a child wins in proportion to its weight.
A draw depends on its own child alone: when a weight grows, rows move only into the
subtree that grew, when it shrinks, only out of it.  Shards are opened one after the
other; a full region is followed by a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.llm._common import uniform

RACKS, SHARDS = 2, 4  # in a region, in a rack
#: About so many rows are numbered in one sorted group.
RUN = 1 << 16


def tree(n_shards: int, racks: int = RACKS, per_rack: int = SHARDS) -> list[list[list[float]]]:
    """Weights of ``n_shards`` equal shards, as regions of racks of shards.

    Opening a shard in a started region adds weight to that region, and rows that it
    draws spread within it; opening the first shard of a new region draws rows into
    that shard alone.  So racks are filled one after the other and a region is
    started whenever ``racks * per_rack`` divides the shard count.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    racks_of = [[1.0] * min(per_rack, n_shards - k) for k in range(0, n_shards, per_rack)]
    return [racks_of[k:k + racks] for k in range(0, len(racks_of), racks)]


def _draw(key: Column, weights: Column, *path: Column) -> Column:
    """The child (from 0) with the smallest draw; children of no weight never win."""
    draws = F.transform(weights, lambda w, i: F.struct(
        F.when(w > 0, -F.log(uniform(key, *path, i)) / w).otherwise(F.lit(float("inf"))).alias("d"),
        i.alias("i")))
    return F.array_min(draws)["i"]


def shard_of(key: Column, weights: list[list[list[float]]]) -> Column:
    """The shard number of ``key``; shards are numbered in tree order from 0."""
    lit = lambda x: F.array(*map(lit, x)) if isinstance(x, list) else F.lit(float(x))
    regions = lit([float(sum(map(sum, region))) for region in weights])
    racks = lit([[float(sum(rack)) for rack in region] for region in weights])
    before, firsts = 0, []
    for region in weights:
        firsts.append([])
        for rack in region:
            firsts[-1].append(before)
            before += len(rack)
    place = F.struct(key.alias("k"), _draw(key, regions, F.lit("region")).alias("r"))
    # One-element arrays keep each draw from being worked out again wherever it is used.
    with_rack = F.transform(F.array(place), lambda p: F.struct(
        p["k"].alias("k"), p["r"].alias("r"),
        _draw(p["k"], F.get(racks, p["r"]), F.lit("rack"), p["r"]).alias("q")))
    done = F.transform(with_rack, lambda p: (
        F.get(F.get(lit(firsts), p["r"]), p["q"]).cast("int") + _draw(
            p["k"], F.get(F.get(lit(weights), p["r"]), p["q"]), F.lit("shard"), p["r"], p["q"])))
    return F.get(done, F.lit(0)).cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard, in the order of a hash of ``order``.

    No task numbers a whole shard: a shard is cut into runs of hash values, rows are
    numbered within their run, and the runs' counts are added up.  ``order`` should
    name columns that tell rows apart; rows equal in them may swap slots in a rerun
    only if other columns differ.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*order))
    counts = hashed.groupBy(shard).agg(F.count("*").alias("_n"))
    parts = counts.agg(F.max("_n")).first()[0] or 0
    bits = max(0, (parts // RUN).bit_length())
    run = F.shiftrightunsigned(F.col("_hash"), 64 - bits) if bits else F.lit(0).cast("long")
    cut = hashed.withColumn("_run", run)
    starts = cut.groupBy(shard, "_run").agg(F.count("*").alias("_n")).select(
        shard, "_run", (F.sum("_n").over(Window.partitionBy(shard).orderBy("_run")) - F.col("_n")).alias("_start"))
    within = Window.partitionBy(shard, "_run").orderBy("_hash", *order)
    numbered = cut.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(starts, [shard, "_run"]).withColumn(
        "slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_hash", "_run", "_at", "_start")


def with_shards(docs: DataFrame, n_shards: int = 24, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a last column ``shard`` (a column of that name is replaced); no shuffle."""
    key = F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0).cast("long"))
    return docs.withColumn("shard", shard_of(key, tree(n_shards)))


def assign(docs: DataFrame, n_shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text (null: 0) plus 8, ``text_crc32`` that of
    the text (null: null).  Rows of one id share a shard (a null id is an id); equal
    rows take neighbouring slots.  ``grown_shard`` is the shard with one more shard.
    An empty table gives no rows; other columns are not read.
    """
    key = F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0).cast("long"))
    narrow = docs.select(
        F.col(doc_id),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, tree(n_shards)).alias("shard"),
        shard_of(key, tree(n_shards + 1)).alias("grown_shard"))
    return with_slots(narrow, "shard", [doc_id, "text_crc32", "size"])
