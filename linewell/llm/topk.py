"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to a set of pivots are computed once (the pivot table).  By
the triangle inequality the greatest difference of two table rows is a lower bound
of the distance of their vectors, hence an upper bound of their inner product.  A task
holds a block of queries and a block of candidates, looks at candidates in the order
of their bounds and stops when the k-th score beats the next bound.  Ranks of the
blocks are merged by a window that keeps k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow
from linewell.sources.shared import checkpointed

SCALE, PIVOTS, TOP = 256, 32, 5
#: Rows of a block of candidates, and of queries.
CANDIDATES, QUERIES = 16_384, 1_024


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


def _with_table(batches: Iterator[pa.RecordBatch], pivots: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("v").to_pylist()
        width = max([len(p) for p in pivots] + [len(r) for r in rows] + [1])
        x, p = _matrix(rows, width).astype(float), _matrix(pivots, width).astype(float)
        square = np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "id", "asks", "v")),
             pa.array(list(np.sqrt(square)), pa.list_(pa.float64()))],
            names=["row", "id", "asks", "v", "table"])


def _best(q: np.ndarray, q_table: np.ndarray, own: int, x: np.ndarray, table: np.ndarray, square: np.ndarray,
          rows: np.ndarray, ids: list[int | None], top: int) -> list[tuple[int, int | None]]:
    """(score, id) of the best candidates of the query that is row ``own``, in order; null ids come last among ties."""
    apart = np.abs(table - q_table).max(axis=1) if table.shape[1] else np.zeros(len(x))
    bound = (square + float((q * q).sum()) - apart * apart) / 2
    bound += 1e-9 * (square + float((q * q).sum())) + 1e-3  # rounding of the table
    order = np.argsort(-bound, kind="stable")
    found: list[tuple[int, bool, int]] = []
    at, step = 0, 64
    while at < len(order) and not (len(found) == top and -found[-1][0] > bound[order[at]]):
        part = order[at:at + step]
        scores = x[part] @ q
        if len(found) == top:
            part, scores = part[scores >= -found[-1][0]], scores[scores >= -found[-1][0]]
        new = [(-int(s), ids[k] is None, ids[k] or 0)
               for s, k, r in zip(scores, part, rows[part], strict=True) if r != own]
        found = sorted(found + new)[:top]
        at, step = at + step, min(2 * step, 4096)
    return [(-s, None if null else i) for s, null, i in found]


def _search_block(held: list[pa.RecordBatch], top: int) -> pa.RecordBatch | None:
    block = pa.Table.from_batches(held).to_pydict()
    asks = [k for k, a in enumerate(block["asks"]) if a]
    have = [k for k, a in enumerate(block["asks"]) if not a]
    if not asks or not have:
        return None
    width = max(max((len(v) for v in block["v"]), default=1), 1)
    x = _matrix([block["v"][k] for k in have], width)
    table = np.array([block["table"][k] for k in have], dtype=float)
    rows, ids = np.array([block["row"][k] for k in have], dtype=np.int64), [block["id"][k] for k in have]
    square = (x.astype(float) ** 2).sum(1)
    out = []
    for k in asks:
        q = _matrix([block["v"][k]], width)[0]
        found = _best(q, np.array(block["table"][k]), block["row"][k], x, table, square, rows, ids, top)
        out += [(block["id"][k], block["row"][k], i, s) for s, i in found]
    return pa.RecordBatch.from_arrays(
        [pa.array([o[j] for o in out], pa.int64()) for j in range(4)], names=["query_id", "row", "vec_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by block; only the block at hand is held."""
    at, rows = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("q_block", "x_block")])
        edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            key = tuple(keys[:, a])
            if key != at and rows:
                if (done := _search_block(rows, top)) is not None:
                    yield done
                rows = []
            at = key
            rows.append(batch.slice(int(a), int(b - a)))
    if rows and (done := _search_block(rows, top)) is not None:
        yield done


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding",
           top: int = TOP, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` best candidates of every query row.

    Candidates are all rows but the query's own, so rows of one id find each other and
    repeated rows ask and are found once each.  Ties go to the smaller id, null ids last;
    fewer candidates give fewer ranks.  A row of null id is no query unless ``is_query``
    says so.  Vectors that are null or hold null or non-finite components take no part; a
    shorter vector counts as filled up with zeros.  Scores are exact while they fit 63
    bits.  Extra columns are not read; an empty table gives no rows.  Pivots are
    ``pivots`` rows chosen by a hash of the id; the result does not depend on them.
    """
    rows = vectors.filter(usable(F.col(vector))).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), quantized(F.col(vector), scale).alias("v"))
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()]
    # Row marks are stored with the table, so that both sides below read the same ones.
    table = checkpointed(map_arrow(
        rows, lambda it: _with_table(it, chosen), "row long, id long, asks boolean, v array<long>, table array<double>"))
    n, m = table.count(), table.filter("asks").count()
    x_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    have = table.select(every(q_blocks).alias("q_block"), block(x_blocks).alias("x_block"), "row", "id", F.lit(False).alias("asks"), "v", "table")
    ask = table.filter("asks").select(block(q_blocks).alias("q_block"), every(x_blocks).alias("x_block"), "row", "id", "asks", "v", "table")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = have.union(ask).repartition(parts, "q_block", "x_block").sortWithinPartitions("q_block", "x_block")
    found = map_arrow(placed, lambda it: _search(it, top), "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
