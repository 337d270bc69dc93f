"""Periodic runs of words, caught while the words arrive.

Dyadic square catching: every completed block of 2^k words becomes a catcher.  It
waits for its own return at a distance of 2^k to 2^(k+1) - 1 words, which the block
hashes of appended words show.  A return opens a comparison of the words with those
one period before; each appended word advances it until two words differ.  Squares of
one period that overlap are one comparison, hence one run.

A run of period q and at least 4 * q words holds, within its first 2^(k+1) - 1 words, a
block of 2^k <= q words together with its return, so no run is missed.  Hashes only
propose; every comparison is made on the words.  The work is n * log n steps and the state
some 40 bytes a word.  A text is worked on in one task, of whatever length; nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow
from linewell.llm._words import U, mix, text_chunks

#: A run has at least so many periods and so many words.
PERIODS, LEAST = 4, 6
#: Words appended at once.
STEP = 1 << 17
#: Word comparisons made at once.
WIDE = 1 << 20
_FAR = np.int64(1) << 40  # beyond any word number of a stream


class Catcher:
    """The runs of a stream of word numbers, found as it grows.

    ``longest`` bounds the words of a run.  ``append`` takes the next words; the runs
    that have ended are in ``ended`` as (start, period, end).  A negative number that
    occurs once ends all runs.
    """

    def __init__(self, size: int, longest: int):
        self.words, self.n = np.empty(size, np.int64), 0
        self.levels = max(0, (max(longest, LEAST) // PERIODS).bit_length())
        self.tail = [np.zeros(0, U)] * self.levels  # hashes of the last windows, for the level above
        self.block = [np.zeros(0, U)] * self.levels  # hashes of the completed blocks: the catchers
        self.start = self.period = self.front = np.zeros(0, np.int64)  # comparisons that still hold
        self.ended: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        self.words[old:self.n] = words
        self._advance()
        below, first = None, 0  # hashes of the level below, and the word its first one begins at
        for k in range(self.levels):
            m = 1 << k
            if k == 0:
                fresh, at = mix(words.astype(U) + U(0x51ED27)), old
            else:
                at = max(0, old - m + 1)
                many = self.n - m + 1 - at
                if many <= 0:
                    break
                left = below[at - first:][:many]
                right = below[at - first + m // 2:][:many]
                fresh = mix(left * U(0x9E3779B97F4A7C15) + (right ^ (right >> U(31))))
            closed = np.arange(-(-at // m) * m, at + len(fresh), m)
            self.block[k] = np.concatenate([self.block[k], fresh[closed - at]])
            place = np.arange(max(at, m), at + len(fresh))
            place = place[fresh[place - at] == self.block[k][(place >> k) - 1]]
            if len(place):
                self._open(((place >> k) - 1) << k, place, m)
            first = at - len(self.tail[k])
            below = np.concatenate([self.tail[k], fresh])
            self.tail[k] = below[-m:]

    def _advance(self) -> None:
        """Carry all comparisons on over the appended words."""
        self.front = self.front + self._agree(self.front, self.front - self.period, 1)
        self._settle(self.start, self.period, self.front)

    def _settle(self, start: np.ndarray, period: np.ndarray, front: np.ndarray) -> None:
        """Keep the comparisons that reach the last word; the others have ended."""
        done = front < self.n
        long = done & (front - start >= np.maximum(LEAST, PERIODS * period))
        if long.any():
            self.ended.append(np.stack([start[long], period[long], front[long]]))
        self.start, self.period, self.front = start[~done], period[~done], front[~done]

    def _open(self, block: np.ndarray, place: np.ndarray, m: int) -> None:
        """Open comparisons where blocks of ``m`` words return, unless one already holds them."""
        period, end = place - block, place + m
        start, span, front = np.concatenate([np.stack([self.start, self.period, self.front]), *self.ended], axis=1)
        # Inside a run of a shorter period, which divides this one: nothing new.
        short = span < m
        order = np.argsort(start[short], kind="stable")
        begins = start[short][order]
        if len(begins):
            reach = np.maximum.accumulate(front[short][order])
            k = np.searchsorted(begins, block, "right") - 1
            new = ~((k >= 0) & (reach[np.maximum(k, 0)] >= end))
            block, period, end = block[new], period[new], end[new]
        # Inside a known comparison of the same period.
        order = np.argsort(span * _FAR + start)
        if len(order):
            k = order[np.maximum(np.searchsorted((span * _FAR + start)[order], period * _FAR + block, "right") - 1, 0)]
            new = ~((span[k] == period) & (start[k] <= block) & (front[k] >= end))
            block, period = block[new], period[new]
        # Neighbouring blocks that return at one distance are one comparison.
        key = np.sort(period * _FAR + block)
        key = key[np.diff(key, prepend=-m - 1) != m]
        period, block = key // _FAR, key % _FAR
        right = self._agree(block + period, block, 1)
        block, period, right = (x[right >= m] for x in (block, period, right))
        left = self._agree(block - 1, block + period - 1, -1)
        key = np.unique(np.stack([block - left, period, block + period + right]), axis=1)
        self._settle(*np.concatenate([np.stack([self.start, self.period, self.front]), key], axis=1))

    def _agree(self, at: np.ndarray, other: np.ndarray, step: int) -> np.ndarray:
        """For how many words from ``at`` and ``other`` on, in direction ``step``, the two are the same."""
        n, length = self.n, np.zeros(len(at), np.int64)
        live, width = np.arange(len(at)), 8
        while len(live):
            width = max(8, min(width, WIDE // len(live)))
            along = step * (length[live, None] + np.arange(width))
            a, b = at[live, None] + along, other[live, None] + along
            inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < n)
            same = inside & (self.words[np.clip(a, 0, n - 1)] == self.words[np.clip(b, 0, n - 1)])
            good = np.where(same.all(axis=1), width, same.argmin(axis=1))
            length[live] += good
            live, width = live[good == width], width * 4
        return length


def runs(numbers: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of every run, sorted by text, start and period.

    ``numbers`` are the words of all texts as numbers from 0, ``begin`` says where each
    text's words begin (one entry more than texts).
    """
    n = len(begin) - 1
    ends = begin[1:] + np.arange(n)  # of the texts in the stream, each followed by a word of its own
    stream, inner = np.empty(len(numbers) + n, np.int64), np.ones(len(numbers) + n, bool)
    stream[ends], inner[ends] = -1 - np.arange(n), False
    stream[inner] = numbers
    catcher = Catcher(len(stream), int(np.diff(begin).max(initial=0)))
    for k in range(0, len(stream), STEP):
        catcher.append(stream[k:k + STEP])
    start, period, end = np.concatenate([np.zeros((3, 0), np.int64), *catcher.ended], axis=1)
    text = np.searchsorted(ends, start)
    order = np.lexsort([period, start, text])
    text, start, period, end = (x[order] for x in (text, start, period, end))
    return text, start - np.append(0, ends + 1)[text], end - start, period


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in no run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) == 0


#: Maps an id and the number of a text's words to the numbers of the words that take their places, or None.
Rewrite = Callable[[object, int], np.ndarray | None]


def _collapse(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch, "text"):
            ids = part.column("id")
            lists = []
            for doc, text in zip(ids.to_pylist(), part.column("text").to_pylist(), strict=True):
                found = (text or b"").split()  # bytes: at the six ASCII white space characters only
                places = rewrite(doc, len(found)) if rewrite and found else None
                lists.append(found if places is None else [found[k] for k in places.tolist()])
            begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = pa.array([w for x in lists for w in x], pa.large_binary()).dictionary_encode()
            numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text, start, length, period = runs(numbers, begin)
            at = np.searchsorted(text, np.arange(part.num_rows + 1))
            for k in np.flatnonzero(np.diff(at)):
                own = slice(at[k], at[k + 1])
                keep = np.flatnonzero(_kept(len(lists[k]), start[own], length[own], period[own]))
                lists[k] = [lists[k][i] for i in keep.tolist()]
            found = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.diff(begin), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), found),
                pa.array([b" ".join(x) for x in lists], pa.binary())], names=["id", "n_words", "runs", "collapsed"])


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``id, n_words, runs, collapsed`` for every row of ``docs``.

    Words are maximal runs of characters other than U+0020 and U+0009 to U+000D.  ``runs``
    holds (start, length, period), by start and period: all stretches of words that repeat
    with a smallest period q, have at least ``LEAST`` words and ``PERIODS`` periods, and
    extend no further.  ``collapsed`` is the text without the words that some run holds behind its first
    period, joined by single spaces.  Null and empty texts have no words, no runs and an
    empty collapsed text; null ids and repeated rows are rows like any other; other columns
    are not read.  ``rewrite`` puts other words of the text in the places of its words first.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]
    done = map_arrow(rows, lambda it: _collapse(it, rewrite), (
        f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"))
    return done.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties by start, then period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
