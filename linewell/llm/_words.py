"""Words of whole texts as 64-bit hashes, for many texts at once.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; A-Z count
as a-z.  Its hash is a polynomial of its UTF-8 bytes modulo 2^64, so all words of a
block come out of two running sums; a mixer spreads the bits.  Runs inside tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18  # bytes worked on at once
_LETTER = np.zeros(256, dtype=np.bool_)
_LETTER[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _LETTER[_lo:_hi] = True
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] += U(32)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * _BLOCK)
        up, down = np.full(n, U(_BASE)), np.full(n, U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one entry more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(at[0]), int(at[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    at = at - first
    letter = _LETTER[raw]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    cuts = at[:-1][at[:-1] < len(raw)]
    opens[cuts] = letter[cuts]
    starts = np.flatnonzero(opens)
    closes = letter.copy()
    closes[:-1] &= ~letter[1:]
    inner = cuts[cuts > 0] - 1
    closes[inner] = letter[inner]
    stops = np.flatnonzero(closes) + 1
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        base = starts[k]
        n = max(k + 1, int(np.searchsorted(stops, base + _BLOCK, "right")))
        part = _FOLD[raw[base:stops[n - 1]]]
        up, down = _power(len(part) + 1)
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[:len(part)], out=run[1:])
        s, e = starts[k:n] - base, stops[k:n] - base
        out[k:n] = (run[e] - run[s]) * down[s]
        k = n
    return mix(out), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, begin: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words inside a text, and where each text's begin.

    A text of fewer words, but at least one, has the run of all its words.
    """
    n = np.diff(begin)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(at[-1], dtype=np.uint64)
    # Word number of each shingle: consecutive within a text.
    first = np.repeat(begin[:-1] - at[:-1], many) + np.arange(at[-1])
    short = np.repeat(n < size, many)
    full = first[~short]
    total = np.zeros(len(full), dtype=np.uint64)
    for j in range(size):
        total += hashes[full + j] * U((_BASE * (2 * j + 3)) & (2**64 - 1) | 1)
    out[~short] = total
    for t in np.flatnonzero((n > 0) & (n < size)):
        run = hashes[begin[t]:begin[t + 1]]
        out[at[t]] = (run * np.arange(7, 7 + 2 * len(run), 2, dtype=np.uint64)).sum(dtype=np.uint64) + U(len(run))
    return mix(out), at


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """``batch`` in slices whose texts hold about ``most`` bytes (at least one row each)."""
    if not batch.num_rows:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(length) - length) // most
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))
