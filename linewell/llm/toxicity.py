"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a whole text: its words, word pairs, triples, and pairs with one word
between, hashed to 2^19 places, each present or not.  Every coordinate has its own
learning rate, and L1 keeps most weights at zero, so the weights are a small array
of fixed size that every task can hold.  Training reads a bounded number of labelled
ids in order, one task a slice: learners in tasks of their own, their changes added or
averaged, scored worse (README).  Scoring, which grows with the documents, runs in all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow
from linewell.llm._words import U, mix, text_chunks, words
from linewell.sources.shared import fresh_path

BITS = 19
#: L1 grows with the square root of the number of training rows, as the noise of a gradient sum does.
ALPHA, BETA, L1_RATE, L2 = 1.0, 1.0, 0.07, 0.1
#: Labelled rows used at most, chosen by a hash of the id.
TRAINING_ROWS = 40_000
SLICES, REPLICAS, EPOCHS = 3, 4, 3
_BIAS = 1 << BITS  # one place more than the features have


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every feature of every text, repeats included."""
    hashes, begin = words(texts)
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    places, owners = [mix(hashes + U(11))], [of]
    for offsets in ((0, 1), (0, 2), (0, 1, 2)):
        n = len(hashes) - offsets[-1]
        if n > 0:
            total = np.full(n, U(97 + sum(offsets) * 7 + len(offsets)))
            for k, o in enumerate(offsets):
                total += hashes[o:o + n] * U(2 * k + 3)
            same = of[:n] == of[offsets[-1]:]
            places.append(mix(total[same]))
            owners.append(of[:n][same])
    return np.concatenate(owners), (np.concatenate(places) >> U(64 - BITS)).astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray, bias: np.ndarray | bool, l1: float) -> np.ndarray:
    l1 = np.where(bias, 0.0, l1)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train(batches: Iterator[pa.RecordBatch], z: np.ndarray, n: np.ndarray, l1: float) -> Iterator[pa.RecordBatch]:
    """FTRL over the rows of a task in order; the change of the state comes out as two arrays."""
    z0, n0, z, n, replica = z, n, z.astype(float), n.astype(float), -1
    for batch in batches:
        for part in text_chunks(batch, "text"):
            replica = part.column("replica")[0].as_py()
            of, places = features(part.column("text"))
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(part.num_rows + 1))
            for k, y in enumerate(part.column("label").to_pylist()):
                at = np.append(np.unique(places[order[ends[k]:ends[k + 1]]]), _BIAS)
                w = _weights(z[at], n[at], at == _BIAS, l1)
                g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                root = np.sqrt(n[at])
                z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
                n[at] += g * g
    changed = [(z - z0).astype(np.float32).tobytes(), (n - n0).astype(np.float32).tobytes()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([replica], pa.int32()), *[pa.array([c], pa.binary()) for c in changed]], names=["replica", "z", "n"])


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "toxic", most: int = TRAINING_ROWS) -> DataFrame:
    """``text, label, slice, replica``: at most ``most`` labelled ids outside the held-out fold.

    An id with several labels counts as toxic if one says so; null labels are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(
        F.col(doc_id).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    mixed = F.xxhash64("_id", F.lit("fold"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    return rows.select("text", "label", F.pmod(mixed, F.lit(SLICES)).cast("int").alias("slice"),
                       F.pmod(F.shiftright(mixed, 20), F.lit(REPLICAS)).cast("int").alias("replica"),
                       F.xxhash64("_id").alias("at"))


#: Places of non-zero weights, the weights, and the bias.
Model = tuple[np.ndarray, np.ndarray, float]


def fit(rows: DataFrame) -> Model | None:
    """The trained model; None without rows."""
    spark = rows.sparkSession
    path = fresh_path(spark, "toxicity-training")
    rows.repartition("slice", "replica").sortWithinPartitions("slice", "replica", "at").select(
        "text", "label", "replica", F.col("slice").alias("s"), F.col("replica").alias("r"),
    ).write.partitionBy("s", "r").parquet(path)
    schema = "text string, label int, replica int, s int, r int"
    stored = spark.read.schema(schema).parquet(path)
    parts = {(row["s"], row["r"]): row["k"] for row in stored.groupBy("s", "r").agg(F.count("*").alias("k")).collect()}
    if not parts:
        return None
    l1 = L1_RATE * sum(parts.values()) ** 0.5
    z, n = np.zeros(_BIAS + 1, np.float32), np.zeros(_BIAS + 1, np.float32)
    for _ in range(EPOCHS):
        for k in range(SLICES):
            replicas = [spark.read.schema("text string, label int, replica int").parquet(f"{path}/s={k}/r={r}").coalesce(1)
                        for r in range(REPLICAS) if (k, r) in parts]
            if not replicas:
                continue
            state = spark.sparkContext.broadcast((z, n, l1))
            moves = map_arrow(reduce(DataFrame.union, replicas), lambda it, s=state: _train(it, *s.value),
                              "replica int, z binary, n binary").toArrow().sort_by("replica")
            state.destroy()
            # One task read the slice, so there is one change; of several, features would be added and the bias averaged.
            z, n = z.copy(), n.copy()
            for total, column in ((z, "z"), (n, "n")):
                for change in moves[column]:
                    change = np.frombuffer(change.as_buffer(), dtype=np.float32)
                    total[:_BIAS] += change[:_BIAS]
                    total[_BIAS] += change[_BIAS] / len(moves)
            del moves
    bias = np.arange(_BIAS + 1) == _BIAS
    weights = _weights(z.astype(float), n.astype(float), bias, l1)
    places = np.flatnonzero(weights[:_BIAS])
    return places.astype(np.int32), weights[places], float(weights[_BIAS])


def _score(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    if model is not None:
        weights = np.zeros(1 << BITS)
        weights[model[0]] = model[1]
    for batch in batches:
        for part in text_chunks(batch, "text", 1 << 20):
            score = np.zeros(part.num_rows)
            if model is not None:
                of, places = features(part.column("text"))
                heavy = weights[places] != 0
                pairs = np.unique(of[heavy] * (1 << BITS) + places[heavy])
                total = np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], part.num_rows)
                score = 1.0 / (1.0 + np.exp(-np.clip(total + model[2], -35, 35)))
            rest = [part.column(i) for i, name in enumerate(part.schema.names) if name != "text"]
            names = [name for name in part.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=[*names, "score"])


def scored(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, score`` for every row; the non-zero weights travel once as a broadcast."""
    narrow = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(narrow.dtypes)["id"]
    return map_arrow(narrow, lambda it: _score(it, held.value), f"id {kind}, held_out boolean, score double")


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Train on ``labels`` outside the held-out fold and score every row of ``docs``.

    A score is the chance of label 1 by the whole text alone.  Null and empty texts
    have no features and score by the bias; repeated rows score alike.  Without any
    training row all scores are 0.  Extra columns are not read.
    """
    return scored(docs, fit(training_rows(docs, labels, doc_id, text, label)), doc_id, text)


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "toxic", at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``at``, columns unchanged."""
    model = fit(training_rows(docs, labels, doc_id, text, label))
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["_row"]
    done = map_arrow(rows, lambda it: _score(it, held.value), f"_row {kind}, score double")
    return done.filter(F.col("score") < at).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
