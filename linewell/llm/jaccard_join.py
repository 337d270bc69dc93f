"""All pairs of documents whose word n-gram sets have a Jaccard similarity of 0.8 or more.

1. Each whole text gives its set of five-word shingles (64-bit hashes), an order-free
   128-bit print of the set, and MinHash bands; the number of bands and rows follows
   from the recall wanted at the threshold.  Texts of one print are one class: copies
   are counted, never paired.
2. Bands are shuffled as (band hash, class).  Buckets that hold the same classes are
   one bucket.  Only classes that share a bucket send their full sets on, once a bucket.
3. A task verifies a bucket's members exactly, by matrix products over their common
   shingles.  A large bucket is cut into blocks and its block pairs go to different
   tasks.  A pair that meets in several buckets belongs to the first of them.
4. A task returns for each member the number of its links and one edge of a spanning
   forest of the links found, not the pairs; edges are contracted to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow
from linewell.llm._components import components
from linewell.llm._words import U, mix, shingles, text_chunks, words
from linewell.sources.shared import checkpointed

WORDS, SIMILAR, RECALL = 5, 0.8, 0.999
#: Members, and shingles, of a block of a large bucket.
MEMBERS, SHINGLES = 2048, 1 << 21


#: 96 bits of a row's id and text.
KEY = "struct<a:bigint,b:int>"


def row_key(doc_id: str, text: str) -> Column:
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.hash(text, doc_id).alias("b"))


def bands_for(similar: float = SIMILAR, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): as many rows as ``recall`` at ``similar`` allows within ``most`` hashes."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)) if similar < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def _prints(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, in any order."""
    signed = np.int64
    a = (mix(hashes).sum(dtype=np.uint64) + U(len(hashes))).astype(signed)
    return int(a), int(np.bitwise_xor.reduce(mix(hashes + U(0x51ED270B))).astype(signed)) if len(hashes) else 0


def _signatures(hashes: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """MinHash values, a row a text that has shingles."""
    seeds = np.random.default_rng(20240501).integers(1, 1 << 63, 2 * count, dtype=np.uint64)
    begin = at[:-1][np.diff(at) > 0]
    out = np.empty((len(begin), count), dtype=np.uint64)
    for k in range(count):
        out[:, k] = np.minimum.reduceat((hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | U(1)), begin)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch, "text", 1 << 20):
            hashes, at = shingles(*words(part.column("text")), WORDS)
            sig = _signatures(hashes, at, bands * rows) if len(hashes) else np.zeros((0, bands * rows), np.uint64)
            prints, counts = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = np.unique(hashes[a:b])
                prints.append(_prints(own))
                counts.append(len(own))
            band = np.zeros((len(sig), bands), dtype=np.uint64)
            for r in range(rows):
                band = mix(band * U(31) + sig[:, r::rows][:, :bands] + U(r))
            band = mix(band + np.arange(bands, dtype=np.uint64)).astype(np.int64)
            full = np.array(counts) > 0
            ends = np.concatenate([[0], np.cumsum(full) * bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("key"), pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()), pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(band.ravel())),
            ], names=["key", "p1", "p2", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full shingle sets of the classes' representatives, as bytes of 64-bit hashes."""
    for batch in batches:
        for part in text_chunks(batch, "text", 1 << 20):
            hashes, at = shingles(*words(part.column("text")), WORDS)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            keep = [i for i, name in enumerate(part.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in keep] + [pa.array(sets, pa.binary())],
                names=[part.schema.names[i] for i in keep] + ["hashes"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of distinct hashes.

    Shingles that many sets hold are multiplied as a dense matrix, rare ones are
    counted pair by pair.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    held = np.diff(np.append(first, len(values)))
    out = np.zeros((m, m), dtype=np.float32)
    dense = max(16, m // 24)
    often = np.flatnonzero(held > dense)
    for k in range(0, len(often), 1024):
        slab = np.zeros((m, min(1024, len(often) - k)), dtype=np.float32)
        for col, x in enumerate(often[k:k + 1024]):
            slab[owner[first[x]:first[x] + held[x]], col] = 1
        out += slab @ slab.T
    for size in np.unique(held[(held > 1) & (held <= dense)]):
        rows = owner[first[held == size][:, None] + np.arange(size)]
        for k in range(0, len(rows), max(1, (1 << 20) // int(size) ** 2)):
            part = rows[k:k + max(1, (1 << 20) // int(size) ** 2)]
            pairs = (part[:, :, None] * m + part[:, None, :]).ravel()
            if m <= 512:
                out += np.bincount(pairs, minlength=m * m).reshape(m, m)
            else:
                np.add.at(out.ravel(), pairs, 1)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _linked(sets: list[np.ndarray], similar: float) -> np.ndarray:
    both = overlaps(sets)
    n = np.array([len(s) for s in sets], dtype=np.float32)
    linked = both >= similar * (n[:, None] + n[None, :] - both) - 1e-3
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> np.ndarray:
    """Each member's parent in a spanning forest of the links; a root is its own."""
    parent = np.full(len(linked), -1)
    for root in range(len(linked)):
        if parent[root] >= 0:
            continue
        parent[root], front = root, np.array([root])
        while len(front):
            reached = np.flatnonzero(linked[front].any(axis=0) & (parent < 0))
            parent[reached] = front[linked[np.ix_(front, reached)].argmax(axis=0)]
            front = reached
    return parent


def _verify_group(bucket: int, left: int, right: int, rows: list[dict], similar: float) -> list[tuple]:
    """(p1, p2, p1 of its parent in the forest, p2 of it, links) for each linked member of a block pair."""
    seen, members = set(), []
    for row in rows:
        if (row["p1"], row["p2"]) not in seen:
            seen.add((row["p1"], row["p2"]))
            members.append(row)
    if len(members) < 2:
        return []
    sets = [np.frombuffer(row["hashes"], dtype=np.uint64) for row in members]
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        linked = np.zeros((2, 2), dtype=bool)
        linked[0, 1] = linked[1, 0] = both >= similar * (len(sets[0]) + len(sets[1]) - both) - 1e-3
    else:
        linked = _linked(sets, similar)
    if left != right:
        side = np.array([row["block"] == left for row in members])
        linked &= side[:, None] != side[None, :]
    earlier = sorted({b for row in members for b in row["buckets"] if b < bucket})
    if earlier and linked.any():
        number = {b: i for i, b in enumerate(earlier)}
        inside = np.zeros((len(members), len(earlier)), dtype=np.float32)
        for i, row in enumerate(members):
            for b in row["buckets"]:
                if b < bucket:
                    inside[i, number[b]] = 1
        for k in range(0, len(members), 512):
            linked[k:k + 512] &= (inside[k:k + 512] @ inside.T) == 0
    copies = np.array([row["copies"] for row in members], dtype=np.int64)
    parent, out = _forest(linked), []
    for i in np.flatnonzero(linked.any(axis=1)):
        up = members[parent[i]]
        out.append((members[i]["p1"], members[i]["p2"], up["p1"], up["p2"], int(copies[linked[i]].sum())))
    return out


def _verify(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Groups arrive sorted by (bucket, left, right); only the group at hand is held."""
    group, rows, found = None, [], []
    names = ["p1", "p2", "q1", "q2", "links"]

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in range(5)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["bucket"], row["left"], row["right"])
            if key != group:
                if len(rows) > 1:
                    found += _verify_group(*group, rows, similar)
                group, rows = key, []
                if len(found) > 4096:
                    yield flush()
                    found.clear()
            rows.append(row)
    if len(rows) > 1:
        found += _verify_group(*group, rows, similar)
    yield flush()


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          similar: float = SIMILAR, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): ``key, p1, p2, n, copies, links`` a row of ``docs``' distinct (id, text), and forest edges.

    ``copies`` counts the rows of the class over all of ``docs``; ``links`` counts
    the linked rows of other classes.
    """
    bands, rows = bands_for(similar, recall)
    spark = docs.sparkSession
    keyed = docs.select(row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    sketch = checkpointed(map_arrow(
        keyed, lambda it: _sketch(it, bands, rows), f"key {KEY}, p1 long, p2 long, n long, bands array<long>"))
    classes = checkpointed(sketch.filter("n > 0").groupBy("p1", "p2").agg(
        F.count("*").alias("copies"), F.min_by(F.struct("n", "key", "bands"), "key").alias("of")).select(
        "p1", "p2", "copies", "of.*"))
    placed = classes.select("p1", "p2", "n", F.explode(F.array_distinct("bands")).alias("bucket"))
    stats = placed.groupBy("bucket").agg(
        F.count("*").alias("members"), F.sum("n").alias("shingles"),
        F.sum(F.xxhash64("p1", "p2").cast("decimal(38,0)")).alias("_check"),
    ).filter("members > 1")
    # Buckets with the same members (count and two sums say so) verify the same pairs: one stays.
    kept = stats.groupBy("members", "shingles", "_check").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
    inside = placed.select("p1", "p2", "bucket").join(kept.select("bucket", blocks.alias("blocks")), "bucket")
    wanted = inside.groupBy("p1", "p2").agg(F.collect_list(F.struct("bucket", "blocks")).alias("in"))
    wanted = classes.join(wanted, ["p1", "p2"]).select("key", "p1", "p2", "copies", "in")
    texts = map_arrow(
        keyed.join(wanted, "key"), _sets, f"key {KEY}, p1 long, p2 long, copies long, `in` array<struct<bucket:long,blocks:int>>, hashes binary")
    sent = texts.select(
        "p1", "p2", "copies", "hashes", F.transform("in", lambda x: x["bucket"]).alias("buckets"),
        F.explode("in").alias("at")).select(
        "*", F.col("at.bucket").alias("bucket"),
        F.pmod(F.xxhash64("p1", "p2"), F.col("at.blocks")).cast("int").alias("block"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("at.blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
    sent = sent.select("*", F.explode(pairs).alias("pair")).select(
        "bucket", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"),
        "block", "p1", "p2", "copies", "buckets", "hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = checkpointed(map_arrow(
        sent.repartition(parts, "bucket", "left", "right").sortWithinPartitions("bucket", "left", "right"),
        lambda it: _verify(it, similar), "p1 long, p2 long, q1 long, q2 long, links long"))
    edges = found.select(F.struct("p1", "p2").alias("a"), F.struct(
        F.col("q1").alias("p1"), F.col("q2").alias("p2")).alias("b"))
    counted = found.groupBy("p1", "p2").agg(F.sum("links").alias("links"))
    joined = sketch.drop("bands").join(classes.select("p1", "p2", "copies"), ["p1", "p2"], "left").join(
        counted, ["p1", "p2"], "left")
    return joined.select(
        "key", "p1", "p2", "n", F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("links", F.lit(0)).alias("links")), edges


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """One row a row of ``docs``: ``id, key, class_id, group_id, n_links, first_key``.

    Rows of one shingle set share a class, named by its least id (null only if all its
    ids are); classes joined by links, directly or through others, share a group, named
    likewise.  ``n_links`` counts the other rows with similarity 0.8 or more, copies
    included.  A text of fewer than five words is one shingle of them all; a text
    without words (null, empty) has no links and is a class and a group of its own.
    ``first_key`` is the key of the row that deduplication keeps for the group: least
    id, then least key.  Extra columns are not read; an empty table gives no rows.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("key"))
    found, edges = links(docs, doc_id, text, **rule)
    found = found.dropDuplicates(["key"])
    # A text without words stands alone: its own key takes the place of a print.
    alone = F.struct(F.col("key.a").alias("p1"), F.col("key.b").cast("long").alias("p2"), F.lit(1).alias("alone"))
    own = F.when(F.col("n") > 0, F.struct("p1", "p2", F.lit(0).alias("alone"))).otherwise(alone)
    rows = checkpointed(narrow.join(found.withColumn("cls", own), "key").select(
        "id", "key", "cls", "copies", "links", "n"))
    roots = components(edges).select(
        F.struct("node.p1", "node.p2", F.lit(0).alias("alone")).alias("cls"),
        F.struct("root.p1", "root.p2", F.lit(0).alias("alone")).alias("root"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    classes = rows.groupBy("cls").agg(least.alias("least")).join(roots, "cls", "left").withColumn(
        "grp", F.coalesce("root", "cls"))
    groups = classes.groupBy("grp").agg(F.min("least").alias("head"))
    names = classes.join(groups, "grp").select(
        "cls", F.col("least.id").alias("class_id"), F.col("head.id").alias("group_id"),
        F.col("head.key").alias("first_key"))
    return rows.join(names, "cls").select(
        "id", "key", "class_id", "group_id",
        F.when(F.col("n") > 0, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        "first_key")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """The rows of ``docs`` that ``join`` keeps: one of each group, all columns unchanged."""
    joined = join(docs, doc_id, text, **rule)
    keys = checkpointed(joined.filter(F.col("key") == F.col("first_key")).groupBy("key").agg(F.count("*").alias("_n")))
    rows = docs.select(row_key(doc_id, text).alias("key"), F.struct("*").alias("_row")).join(keys, "key")
    single = rows.filter("_n = 1").select("_row")
    several = rows.filter("_n > 1").groupBy("key").agg(F.first("_row").alias("_row")).select("_row")
    return single.union(several).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
