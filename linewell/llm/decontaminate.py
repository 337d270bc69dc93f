"""Benchmark passages in documents, by SimHash of item-sized windows.

For every benchmark item, windows of its size slide over each whole text.  Windows that
hold no shingle of an item of their size cannot be similar and are passed over.
The others get a 128-bit SimHash whose shingles count by the square root of their weight, so that
its angle follows the weighted similarity also where many items share a long template.  An index of the items'
fingerprints in 8 blocks of 16 bits finds every item within 31 bits: of 8 blocks one
differs in at most 3 bits, and the index lists all values that near.  Candidates are
verified by their exact weighted similarity.  A shingle's weight follows from the number
of items that hold it, counted once over all items.  Items are taken in blocks of bounded
size, which every task can hold; texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow
from linewell.llm._words import U, mix, shingles, text_chunks, words

WORDS, SIMILAR, RADIUS = 5, 0.8, 31
#: At most about so many characters of items are held in a task at once.
ITEM_CHARS = 2_000_000
_UNIT = 840  # weight of a shingle that one item holds
_NEAR = np.array([sum(1 << b for b in bits) for k in range(RADIUS // 8 + 1) for bits in combinations(range(16), k)], dtype=np.int64)


def _roots(weights: np.ndarray) -> np.ndarray:
    """Square roots in 64ths: whole numbers, so that running sums are exact."""
    return np.rint(64 * np.sqrt(weights)).astype(np.int64)


def _sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of +weight or -weight for each of 128 hash bits; one row more than hashes."""
    both = np.stack([hashes, mix(hashes + U(0x5851F42D))], axis=1).view(np.uint8)
    bits = np.unpackbits(both, axis=1, bitorder="little").astype(np.int32)
    out = np.zeros((len(hashes) + 1, 128), dtype=np.int64)
    np.cumsum((2 * bits - 1) * weights[:, None], axis=0, out=out[1:])
    return out


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (8 blocks of 16 bits a row) of rows of 128 sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint16)


class Items:
    """Benchmark items and their Hamming index.

    ``shared`` are the sorted shingles that several items of the whole benchmark hold
    and ``held`` the number of these items; without them the items given are all.
    """

    def __init__(self, ids: list, texts: list[str], shared: np.ndarray | None = None, held: np.ndarray | None = None):
        hashes, at = shingles(*words(pa.array(texts, pa.string())), WORDS)
        n_words = np.diff(words(pa.array(texts, pa.string()))[1])
        keep = [k for k in range(len(ids)) if n_words[k] >= WORDS]
        self.ids = [ids[k] for k in keep]
        self.parts = [hashes[at[k]:at[k + 1]] for k in keep]
        self.sizes = np.array([len(p) for p in self.parts], dtype=np.int64)
        every = np.concatenate([np.unique(p) for p in self.parts] or [np.zeros(0, np.uint64)])
        self.known, own = np.unique(every, return_counts=True)
        self.shared, held = (self.known[own > 1], own[own > 1]) if shared is None else (shared, held)
        self.weight = np.maximum(1, _UNIT // held).astype(np.int64)
        self.root = _roots(self.weight)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.known >> U(44)).astype(np.int64)] = True
        self.held_by: dict[int, set[int]] = {}  # shingle number: sizes of the items that hold it
        for p in self.parts:
            for s in np.searchsorted(self.known, p).tolist():
                self.held_by.setdefault(s, set()).add(len(p))
        prints = [_fingerprints(_sums(p, self.roots(p))[-1:])[0] for p in self.parts]
        self.prints = np.array(prints, dtype=np.uint16).reshape(-1, 8)
        self.index = []
        for b in range(8):
            values = (self.prints[:, b].astype(np.int64)[:, None] ^ _NEAR[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << 16) + 1))
            self.index.append((starts, (order // len(_NEAR)).astype(np.int32)))

    def _of(self, hashes: np.ndarray, values: np.ndarray, else_: int) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(hashes), else_, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shared, hashes), len(self.shared) - 1)
        return np.where(self.shared[at] == hashes, values[at], else_)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """A shingle weighs less the more items hold it; one that none holds weighs as if one did."""
        return self._of(hashes, self.weight, _UNIT)

    def roots(self, hashes: np.ndarray) -> np.ndarray:
        """What a shingle adds to a fingerprint's sums."""
        return self._of(hashes, self.root, int(_roots(np.array([_UNIT]))[0]))

    def near(self, prints: np.ndarray) -> np.ndarray:
        """(window, item) pairs whose fingerprints differ in at most RADIUS bits."""
        found = []
        for b, (starts, items) in enumerate(self.index):
            value = prints[:, b].astype(np.int64)
            first, many = starts[value], starts[value + 1] - starts[value]
            window = np.repeat(np.arange(len(prints)), many)
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append(window * len(self.ids) + items[at])
        pairs = np.unique(np.concatenate(found)) if self.ids else np.zeros(0, np.int64)
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        far = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        return np.stack([window, item], axis=1)[far <= RADIUS]

    def similarity(self, window: np.ndarray, item: np.ndarray) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        a, n = np.unique(window, return_counts=True)
        b, m = np.unique(item, return_counts=True)
        values = np.union1d(a, b)
        left, right = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        left[np.searchsorted(values, a)], right[np.searchsorted(values, b)] = n, m
        w = self.weights(values)
        return float((w * np.minimum(left, right)).sum() / (w * np.maximum(left, right)).sum())

    def matches(self, hashes: np.ndarray, similar: float) -> list[tuple]:
        """(item id, first word, words, similarity) of the best window of each item found in one text."""
        hits = np.flatnonzero(self.filter[(hashes >> U(44)).astype(np.int64)])
        if not len(hits) or not len(self.known):
            return []
        number = np.minimum(np.searchsorted(self.known, hashes[hits]), len(self.known) - 1)
        real = self.known[number] == hashes[hits]
        hits, number = hits[real], number[real]
        best: dict[int, tuple[float, int]] = {}
        of_size: dict[int, list[int]] = {}
        for at, s in zip(hits.tolist(), number.tolist(), strict=True):
            for n in self.held_by[s]:
                of_size.setdefault(n, []).append(at)
        for n, places in sorted(of_size.items()):
            if n > len(hashes):
                continue
            mine = np.array(places)
            edge = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(edge, np.maximum(mine - n + 1, 0), 1)
            np.add.at(edge, mine + 1, -1)
            begins = np.flatnonzero(np.cumsum(edge)[:len(hashes) - n + 1] > 0)
            for k in range(0, len(begins), 8192):
                part = begins[k:k + 8192]
                low, high = int(part[0]), int(part[-1]) + n
                if high - low > 4 * len(part) + 4 * n:  # far apart: one run at a time
                    groups = np.split(part, np.flatnonzero(np.diff(part) > n) + 1)
                else:
                    groups = [part]
                for group in groups:
                    low, high = int(group[0]), int(group[-1]) + n
                    sums = _sums(hashes[low:high], self.roots(hashes[low:high]))
                    prints = _fingerprints(sums[group - low + n] - sums[group - low])
                    for w, item in self.near(prints):
                        if self.sizes[item] == n:
                            start = int(group[w])
                            found = self.similarity(hashes[start:start + n], self.parts[item])
                            if found >= similar and found > best.get(int(item), (0.0, 0))[0]:
                                best[int(item)] = (found, start)
        return [(self.ids[i], start, int(self.sizes[i]) + WORDS - 1, found) for i, (found, start) in sorted(best.items())]


_built: dict[str, Items] = {}


def _scan(batches: Iterator[pa.RecordBatch], held, counts, similar: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    token = held.value[0]
    if token not in _built:  # once a worker
        _built.clear()
        _built[token] = Items(*held.value[1:], *counts.value)
    items = _built[token]
    match = pa.list_(pa.struct([("item_id", kind), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))
    for batch in batches:
        for part in text_chunks(batch, "text", 1 << 20):
            hashes, at = shingles(*words(part.column("text")), WORDS)
            found = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                found.append([dict(zip(("item_id", "start_word", "n_words", "similarity"), m, strict=True))
                              for m in items.matches(hashes[a:b], similar)])
            rest = [name for name in part.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(found, match)], names=[*rest, "found"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each item."""
    for batch in batches:
        for part in text_chunks(batch, "t", 1 << 20):
            hashes, begin = words(part.column("t"))
            tokens, at = shingles(hashes, begin, WORDS)
            own = [np.unique(tokens[at[k]:at[k + 1]]) for k in np.flatnonzero(np.diff(begin) >= WORDS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(own or [np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])


def _counts(usable: DataFrame):
    """Broadcast of the sorted shingles that several of all items hold, and how many (at most _UNIT)."""
    counted = map_arrow(usable.select("t"), _held, "s long").groupBy("s").agg(
        F.least(F.count("*"), F.lit(_UNIT)).cast("short").alias("held")).filter("held > 1").toArrow()
    shared = counted["s"].to_numpy().view(np.uint64)
    order = np.argsort(shared)
    return usable.sparkSession.sparkContext.broadcast((shared[order], counted["held"].to_numpy()[order]))


def _blocks(items: DataFrame, item_id: str, text: str) -> tuple[list, object, str, pa.DataType]:
    """Broadcasts of all items, each of bounded size, and of their counts, and the type of their ids."""
    usable = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("t"))
    chars = usable.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks, out = max(1, -(-chars // ITEM_CHARS)), []
    for k in range(blocks):
        part = usable.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k).orderBy("id", "t").toArrow()
        out.append(items.sparkSession.sparkContext.broadcast(
            (uuid.uuid4().hex, part["id"].to_pylist(), part["t"].to_pylist())))
    return out, _counts(usable), dict(usable.dtypes)["id"], part.schema.field("id").type


def _scanned(rows: DataFrame, held, counts, id_type: str, arrow_type: pa.DataType, similar: float) -> DataFrame:
    """``rows`` (with a column ``text``) without text, with the matches ``found`` of one block of items."""
    names = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes if name != "text")
    found = f"array<struct<item_id:{id_type},start_word:bigint,n_words:bigint,similarity:double>>"
    return map_arrow(rows, lambda it: _scan(it, held, counts, similar, arrow_type), f"{names}, found {found}")


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``id, item_id, start_word, n_words, similarity``: the best window of each item in each row.

    A window matches if its bag of five-word shingles has a weighted Jaccard similarity
    of 0.8 or more with the item's.  Items of fewer than five words have no shingle and
    match nothing, nor do null or empty texts.  Repeated rows and items match each.  An
    empty table on either side gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    blocks, *kinds = _blocks(items, item_id, item_text)
    parts = [_scanned(rows, held, *kinds, similar) for held in blocks]
    return reduce(DataFrame.union, parts).select("id", F.explode("found").alias("m")).select("id", "m.*")


def without_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that hold no passage of an item, columns unchanged."""
    blocks, *kinds = _blocks(items, item_id, item_text)
    kept = docs.select(F.struct("*").alias("_row"))
    for held in blocks:
        rows = kept.select("_row", F.col("_row")[text].alias("text"))
        kept = _scanned(rows, held, *kinds, similar).filter(F.size("found") == 0).select("_row")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
