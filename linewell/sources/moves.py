"""Files known by how they begin: listings made in tasks, and moves between two of them.

A rolled or renamed log keeps its first bytes, whatever is appended to it later, so a
listing with the first bytes of every file tells a moved file from a new one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewell.plans.session import ship
from linewell.shared import checkpointed
from linewell.sources.uris import open_fs, qualified

#: First bytes kept of a file, and the fewest by which a file that has grown is known again.
HEAD, LEAST = 1024, 64
_BATCH = 4096
_ENTRIES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("ms", pa.int64()), ("folder", pa.bool_())])


def _child(folder: str, name: str) -> str:
    """URI of a folder's entry, written as Spark writes ``_metadata.file_path``."""
    return f"{folder.rstrip('/')}/" + re.sub(r"[^\w.!~'()*,;:$&+=@-]", lambda c: quote(c[0]), name)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the folders of ``path`` hold; a file stands for itself.  Hidden names are passed by, as Spark does."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, inner = open_fs(path)
            own = fs.get_file_info(inner)
            if own.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            if own.type == pafs.FileType.File:
                found = [(path, own)]
            else:
                found = [(_child(path, i.base_name), i) for i in fs.get_file_info(pafs.FileSelector(inner))
                         if i.base_name[:1] not in ("_", ".")]
            for k in range(0, len(found), _BATCH):
                part = found[k:k + _BATCH]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _ in part], pa.string()), pa.array([i.size or 0 for _, i in part], pa.int64()),
                    pa.array([(i.mtime_ns or 0) // 1_000_000 for _, i in part], pa.int64()),
                    pa.array([i.type == pafs.FileType.Directory for _, i in part], pa.bool_())], schema=_ENTRIES)


def _with_heads(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """The rows with the first bytes of their files; a file that is gone by now is left out."""
    for batch in batches:
        heads, keep = [], []
        for k, path in enumerate(batch.column("path").to_pylist()):
            fs, inner = open_fs(path)
            try:
                with fs.open_input_file(inner) as file:
                    heads.append(file.read(head))
            except FileNotFoundError:
                continue
            keep.append(k)
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(heads, pa.binary())], names=[*rows.schema.names, "head"])


def list_tree(spark: SparkSession, folders: str | Iterable[str], head: int = HEAD) -> DataFrame:
    """(path, size, mtime, head) of every file below ``folders``, empty ones too.

    Folders are listed in tasks, one level of the tree a job, and first bytes are read in
    tasks; the driver sees no file.  The listing of one folder is held by one task.  A
    named file stands for itself; names beginning with ``_`` or ``.`` are passed by, a
    missing path is an error, patterns in paths are not expanded.
    """
    ship(spark)
    named = [folders] if isinstance(folders, str) else list(folders)
    level = spark.createDataFrame([(qualified(spark, f),) for f in named], "path string").distinct()
    files = None
    while True:
        found = checkpointed(level.mapInArrow(_entries, "path string, size long, ms long, folder boolean"))
        own = found.filter("not folder").select("path", "size", "ms")
        files = own if files is None else files.union(own)
        level = found.filter("folder").select("path").distinct()
        if level.isEmpty():
            break
    spread = files.dropDuplicates(["path"])  # by path, so that a folder's files are read by many tasks
    return spread.mapInArrow(lambda it: _with_heads(it, head), "path string, size long, ms long, head binary").select(
        "path", "size", F.timestamp_millis("ms").alias("mtime"), "head")


def _begin(head: Column, n: Column) -> Column:
    return F.substring(head, F.lit(1), n)


def _present(snapshot: DataFrame) -> DataFrame:
    return snapshot if "present" in snapshot.columns else snapshot.withColumn("present", F.lit(True))


def remember(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """``cur`` with ``present``, and what ``prev`` knew of files that are gone, as not present.

    Given as the earlier listing to ``file_moves``, it tells files that reappear.
    """
    gone = _present(prev).join(cur.select("path"), "path", "left_anti")
    columns = ["path", "size", "mtime", "head"]
    return cur.select(*columns, F.lit(True).alias("present")).union(gone.select(*columns, F.lit(False)))


def _asked(earlier: DataFrame, later: DataFrame, least: int) -> DataFrame:
    """(moved_to, size, n, k): lengths at which a later file is compared, with the checksum of as many first bytes.

    These are lengths of earlier files that begin as it does: with equal first bytes up to the last of the steps
    ``least``, 2 ``least``, 4 ``least``, ... that their length reaches.  Only keys of the steps are shuffled to find them.
    """
    base = max(least, 1)
    step = lambda n: F.expr(f"length(bin({n} div {base})) - 1")
    begun = lambda head: F.sha2(_begin(F.col(head), F.expr(f"cast({base} * power(2, j) as int)")), 256).alias("b")
    lengths = earlier.withColumn("j", step("n")).select("j", begun("_h"), "n").groupBy("j", "b").agg(F.collect_set("n").alias("ns"))
    open_ = later.withColumn("_n", F.octet_length("_g")).filter(F.col("_n") >= base)
    begins = open_.withColumn("j", F.explode(F.sequence(F.lit(0), step("_n")))).select("moved_to", "j", begun("_g"))
    found = begins.join(lengths, ["j", "b"]).groupBy("moved_to").agg(F.flatten(F.collect_list("ns")).alias("ns"))
    return open_.join(found, "moved_to").withColumn("n", F.explode("ns")).filter(F.col("n") <= F.col("_n")).select(
        "moved_to", "size", "n", F.sha2(_begin(F.col("_g"), F.col("n")), 256).alias("k"))


def file_moves(prev: DataFrame, cur: DataFrame, least: int = LEAST) -> DataFrame:
    """``path, change, old_size, new_size, touched, moved_from, moved_to`` of two listings with heads.

    ``change`` is that of ``file_changes``, and REPLACED where the path holds another file that is
    no shorter, RENAMED for a new path whose file was known under another, REAPPEARED for one
    that ``remember`` has seen go.  A file is known by its first bytes: first where size and first bytes
    are equal, then, with ``least`` first bytes or more, where the later file is longer
    and begins as the earlier one does.  Where several earlier or later files answer alike, none is claimed:
    they stay CREATED and DELETED.  A file that stands where it was is never moved, so copies
    are CREATED.  Empty files have no beginning.  Paths are unique in each listing; null paths are
    left out, null heads count as empty.
    """
    old, new = _present(prev).filter("path is not null"), cur.filter("path is not null")
    both = checkpointed(old.select(
        "path", F.col("size").alias("old_size"), F.col("mtime").alias("_old"), "present",
        F.coalesce("head", F.lit(b"")).alias("_h")).join(new.select(
            "path", F.col("size").alias("new_size"), F.col("mtime").alias("_new"),
            F.coalesce("head", F.lit(b"")).alias("_g")), "path", "full_outer"))
    common = F.least(F.octet_length("_h"), F.octet_length("_g"))
    kept = _begin(F.col("_h"), common) == _begin(F.col("_g"), common)
    appears = F.col("old_size").isNull() | ~F.col("present")
    both = both.withColumn("_kept", F.coalesce(kept & (common > 0) | (F.col("old_size") == F.col("new_size")) & kept, F.lit(False)))
    sources = both.filter(F.col("present") & (F.octet_length("_h") > 0) & (
        F.col("new_size").isNull() | ~F.col("_kept") | (F.col("new_size") < F.col("old_size")))).select(
        F.col("path").alias("moved_from"), F.col("old_size").alias("size"), F.octet_length("_h").alias("n"), "_h", F.sha2("_h", 256).alias("k"))
    targets = both.filter(F.col("new_size").isNotNull() & (F.octet_length("_g") > 0) & (appears | ~F.col("_kept"))).select(
        F.col("path").alias("moved_to"), F.col("new_size").alias("size"), "_g", F.sha2("_g", 256).alias("k"))

    def sole(df: DataFrame, name: str, *keys: str) -> DataFrame:
        """Rows that no other row answers alike; counted, never paired."""
        held = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(name).alias(name), F.min("size").alias("_size"))
        return held.filter("_n = 1").drop("_n")

    exact = checkpointed(sole(sources, "moved_from", "k", "size").join(
        sole(targets, "moved_to", "k", "size").drop("_size"), ["k", "size"]).select("moved_from", "moved_to"))
    left = sources.join(exact, "moved_from", "left_anti").filter(F.col("n") >= least)
    asked = _asked(left, targets.join(exact, "moved_to", "left_anti"), least)
    grown = asked.join(sole(left.drop("_h"), "moved_from", "n", "k"), ["n", "k"]).filter("size > _size").groupBy("moved_to").agg(
        F.max_by("moved_from", "n").alias("moved_from")).groupBy("moved_from").agg(
        F.count("*").alias("_n"), F.min("moved_to").alias("moved_to")).filter("_n = 1").select("moved_from", "moved_to")
    moved = checkpointed(exact.union(grown))

    told = both.join(moved.withColumnRenamed("moved_to", "path"), "path", "left").join(
        moved.withColumnRenamed("moved_from", "path"), "path", "left")
    change = (
        F.when(F.col("old_size").isNull(), F.when(F.col("moved_from").isNull(), "CREATED").otherwise("RENAMED"))
        .when(F.col("new_size").isNull(), "DELETED")
        .when(~F.col("present"), "REAPPEARED")
        .when(F.col("new_size") < F.col("old_size"), "TRUNCATED")
        .when(~F.col("_kept") & (F.octet_length("_h") > 0), "REPLACED")
        .when(F.col("new_size") > F.col("old_size"), "DATA_ADDED")
        .otherwise("UNCHANGED")
    )
    return told.filter(F.coalesce("present", F.lit(True)) | F.col("new_size").isNotNull()).select(
        "path", change.alias("change"), "old_size", "new_size",
        F.coalesce(F.col("_old") != F.col("_new"), F.lit(False)).alias("touched"), "moved_from", "moved_to")
