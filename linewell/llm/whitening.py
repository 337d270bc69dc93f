"""Whitening of whole-number vectors by shifted Cholesky QR.

The centred rows are orthogonalised pass by pass: a distributed pass sums the Gram
matrix of the rows so far, its Cholesky factor R joins the factors, and the next pass
sends every row through the triangular solves of all factors.  The first factor comes
from a Gram matrix with a small shift, so that nearly dependent dimensions do no harm;
two further passes bring the rows to orthonormal in double precision.  The product of
the factors has the singular values and right vectors of the centred rows: the
components of their covariance, without ever squaring its condition number.

Matrices of dimensions x dimensions go to the driver, rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow, stored

#: Rows of a matrix product, and passes at most (three suffice unless dimensions depend on each other).
ROWS, PASSES = 4096, 6
#: Columns that a triangular solve works on together.
PANEL = 32
#: Gram matrices within this of the identity need no further pass: the rest is folded in.
NEAR = 1e-8
_UNIT = 2.0**-53
#: Singular values below this share of the largest, times the dimensions, are rounding.
_NOISE = 2.0**-44


@dataclass
class Fit:
    """Vectors, sums by dimension, components (as rows), their variances, and the variance of all dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def axes(self) -> np.ndarray:
        """Columns that map a centred row to whitened entries; NaN for a component of no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, self.components.T / np.sqrt(self.variances), np.nan)


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their vectors as one matrix of integers, filled up with zeros."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            lists = part.column("x")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            out = np.zeros((part.num_rows, dims or int(sizes.max(initial=0))), np.int64)
            out[np.repeat(np.arange(part.num_rows), sizes), np.arange(len(flat)) - np.repeat(at, sizes)] = flat
            yield part, out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they suffice, else Python's."""
    most = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (as dimension -1) and the sum of each dimension, in two halves that cannot overflow."""
    n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, x in _matrices(batches, 0):
        n += len(x)
        if x.shape[1] > len(high):
            high, low = (np.pad(v, (0, x.shape[1] - len(v))) for v in (high, low))
        high[:x.shape[1]] += (x >> 32).sum(axis=0)
        low[:x.shape[1]] += (x & 0xFFFFFFFF).sum(axis=0)
    yield pa.RecordBatch.from_pydict({
        "i": pa.array(range(-1, len(high)), pa.int32()), "high": pa.array([n, *high.tolist()], pa.int64()),
        "low": pa.array([0, *low.tolist()], pa.int64())})


def _solve(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x times the inverse of the upper triangular r."""
    x = np.asfortranarray(x)
    for a in range(0, r.shape[1], PANEL):
        b = min(a + PANEL, r.shape[1])
        x[:, a:b] -= x[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            x[:, j] = (x[:, j] - x[:, a:j] @ r[a:j, j]) / r[j, j]
    return x


def _gram(rows: DataFrame, n: int, sums: list[int], finish: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The Gram matrix of ``finish``ed centred rows, summed row by row of the matrix."""
    def partial(batches):
        total = np.zeros((size, size))
        for _, x in _matrices(batches, len(sums)):
            y = finish(_deviations(x, n, sums).astype(float) / n)
            total += y.T @ y
        yield _vectors(range(size), total)

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().reshape(-1, size)
            for i, v in zip(batch.column("i").to_pylist(), values, strict=True):
                total[i] = total[i] + v if i in total else v
        if total:
            yield _vectors(total.keys(), np.stack(list(total.values())))

    schema = "i int, v array<double>"
    table = map_arrow(map_arrow(rows, partial, schema).repartition("i"), added, schema).toArrow().sort_by("i")
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(size, size)


def _vectors(i, values: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(range(0, values.size + 1, values.shape[1]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["i", "v"])


def _factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted as far as it takes."""
    d = len(gram)
    shift = 11 * d * (d + 1 + ROWS) * _UNIT * np.trace(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(rows: DataFrame, components: int) -> Fit:
    """The first components of ``rows`` (x: array of longs, none null)."""
    summed = {r["i"]: int(r["high"]) * (1 << 32) + int(r["low"]) for r in map_arrow(
        rows.select("x"), _sums, "i int, high long, low long").groupBy("i").agg(
            *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).collect()}
    n, dims = summed.get(-1, 0) >> 32, len(summed) - 1
    sums = [summed[i] for i in range(dims)]
    if n == 0 or dims < 1:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []

    def solved(x: np.ndarray) -> np.ndarray:
        for r in factors:
            x = _solve(x, r)
        return x

    whole = np.eye(dims)
    while True:
        gram = _gram(rows, n, sums, solved, dims)
        total = np.trace(gram) / n if not factors else total
        if total == 0.0 or len(factors) == PASSES or np.abs(gram - np.eye(dims)).max() <= NEAR:
            break
        factors.append(_factor(gram, shifted=not factors))
        whole = factors[-1] @ whole
    # What the last Gram matrix still differs from the identity by (all, for dependent dimensions) is folded in.
    values, vectors = np.linalg.eigh(gram)
    _, s, right = np.linalg.svd(np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ whole)
    s[s <= s[0] * dims * _NOISE] = 0.0
    return Fit(n, sums, right[:components], s[:components] ** 2 / n, total)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over components with variance."""
    axes = model.axes[:, model.variances > 0]
    if not axes.size:
        return 0.0
    gram = _gram(rows, model.n, model.sums, lambda x: np.column_stack([x @ axes, np.ones(len(x))]), axes.shape[1] + 1)
    mean = gram[-1, :-1] / model.n
    return float(np.abs(gram[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def transformed(rows: DataFrame, model: Fit) -> DataFrame:
    """``id, deviation, whitened`` for every row: the exact sum of (n*x - sums)^2, and the whitened vector."""
    kind, k = dict(rows.dtypes)["id"], len(model.variances)

    def work(batches):
        for part, x in _matrices(batches, len(model.sums)):
            far = _deviations(x, model.n, model.sums)
            if far.dtype == object or len(model.sums) * float(np.abs(far).max(initial=0)) ** 2 >= 2.0**62:
                far = far.astype(object)
                squares = pa.array([Decimal(v) if v < 10**38 else None for v in (far * far).sum(axis=1).tolist()], pa.decimal128(38, 0))
            else:
                squares = pa.array((far * far).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            y = (far.astype(float) / model.n) @ model.axes
            ends = pa.array(range(0, y.size + 1, k), pa.int32())
            white = pa.ListArray.from_arrays(ends, pa.array(y.ravel(), mask=np.isnan(y.ravel())))
            yield pa.RecordBatch.from_arrays([part.column("id"), squares, white], names=["id", "deviation", "whitened"])

    return map_arrow(rows, work, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "x", components: int = 8) -> DataFrame:
    """A row for each vector and component: ``id, component, n, deviation, whitened, explained, identity_error``.

    ``vector`` is an array of longs.  Null vectors and those that hold a null take no part;
    one shorter than the longest is filled up with zeros.  Components number from 1 by
    falling variance, at most as many as there are dimensions; one without variance (dependent
    dimensions, a single vector, copies of one) has a null ``whitened`` and explains 0.
    ``deviation`` is exact, and null from 10^38 on.  Null ids and repeated rows are rows
    like any other.  Tables without vectors, or with empty ones only, give no rows.
    """
    rows = stored(vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("x")).filter(
        F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull())), "vectors")
    model = fit(rows, components)
    if not len(model.variances):
        return vectors.sparkSession.createDataFrame([], (
            f"id {dict(rows.dtypes)['id']}, component int, n long, deviation decimal(38,0), whitened double, "
            "explained double, identity_error double"))
    shares = model.variances / model.total if model.total else np.zeros(len(model.variances))
    error = identity_error(rows, model)
    each = transformed(rows, model).select("id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(
        "id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(F.array(*map(F.lit, shares.tolist())), "_k").alias("explained"),
        F.lit(error).alias("identity_error"))
