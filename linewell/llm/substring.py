"""Passages of 50 words or more that different texts share, exactly or nearly.

Tokens are the five-word shingles of a text.  For each of several hash functions a text
falls into compact windows: a token and the longest run around it in which it has the
least hash (a node of the Cartesian tree over the hashes).  Only windows as long as a
passage are kept, about two for each passage length of text.  Where a token soon comes
again (a word said many times over) the windows of its places are one: they are put
together over half a passage, and hold what each of them holds.

1. Windows are grouped by (function, token); a group of one text is dropped.  Windows of
   a group that hold the same tokens around theirs, as far as a passage reaches, are one
   context: a passage as it stands, linked to the first of them.
2. The different contexts of a group are compared each to each, however many they are, with the
   tokens of their windows; the number of functions follows from the recall wanted at the
   threshold.  Contexts without a passage of tokens that other texts of the group hold are passed by.
   A passage is a run of the text whose tokens the other holds so densely that the
   Jaccard similarity is 0.8 or more.  Written out are places covered, and a forest of links.
3. Passages of a text are merged; texts linked by passages form classes.

Equal texts are one text from the start: copies are counted, never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewell.llm._common import dropped, map_arrow, released
from linewell.llm._components import components
from linewell.llm._words import U, mix, shingles, text_chunks, words
from linewell.sources.shared import checkpointed, fresh_path

#: RECALL: chance that two windows of similarity SIMILAR share a token of least hash.
WORDS, PASSAGE, SIMILAR, RECALL = 5, 50, 0.8, 0.998
#: Contexts of a part of a large group, and of a small group (bits of a word).
GROUP, FEW = 4096, 64
#: Partners that are tried first for what a context shares (only speed depends on it).
FIRST = 8
#: Bits of the filters that spare windows and texts without candidates the shuffle (only speed depends on them).
LEAST_BITS, MOST_BITS = 20, 28
_BASE = 0x9E3779B97F4A7C15  # odd: of the sums that tell contexts apart
_AT = 28  # bits for a token's place
_REACH = 12  # bits for the tokens of a window before its first place and after its last
_SIDES = 3 * _REACH - 1  # bits behind a window's place: from its first to its last place, and both sides


def functions_for(similar: float = SIMILAR, recall: float = RECALL) -> int:
    """Hash functions of which at least one agrees with chance ``recall`` at ``similar``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar)) if similar < 1 else 1


def compact_windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last) of every compact window of ``length`` tokens or more.

    Equal hashes are ordered by place.  A node whose run is that long is the least
    of some stretch of ``length`` tokens, and so are the lesser nodes that end its
    run; so the tree is built over those least tokens alone.
    """
    n = len(hashes)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    packed = (hashes >> U(_AT) << U(_AT)) | np.arange(n, dtype=np.uint64)
    least, span = packed, 1
    while span < length:
        step = min(span, length - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    place = np.unique(least & U((1 << _AT) - 1)).astype(np.int64)
    value = packed[place].tolist()
    where = place.tolist()
    first, last, stack = [0] * len(where), [n - 1] * len(where), []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            last[stack.pop()] = where[k] - 1
        if stack:
            first[k] = where[stack[-1]] + 1
        stack.append(k)
    return place, np.array(first, np.int64), np.array(last, np.int64)


def _lesser(value: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it that is less; the first must be the least."""
    at = np.arange(-1, len(value) - 1)
    at[0] = 0
    going = np.flatnonzero(value[at] > value)
    while len(going):
        # All entries between an entry and its pointer are greater, so pointers can be followed at once.
        at[going] = at[at[going]]
        going = going[value[at[going]] > value[going]]
    return at


def all_compact_windows(hashes: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, place, first, last) of the ``compact_windows`` of many texts put together, places counted through all."""
    n, none = len(hashes), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    packed = (hashes >> U(_AT) << U(_AT)) | np.arange(n, dtype=np.uint64)
    least, span = packed, 1
    while span < length:
        step = min(span, length - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    stop = np.repeat(begin[1:], np.diff(begin))
    mark = np.zeros(n, np.bool_)
    mark[(least[np.arange(len(least)) + length <= stop[:len(least)]] & U((1 << _AT) - 1)).astype(np.int64)] = True
    place = np.flatnonzero(mark)
    if not len(place):
        return none, none, none, none
    text = np.searchsorted(begin, place, "right") - 1
    # A least entry before each text and behind the last one ends all runs.
    opens = np.flatnonzero(np.diff(text, prepend=-1))
    value = np.append(np.insert(packed[place], opens, U(0)), U(0))
    own = np.ones(len(value), np.bool_)
    own[np.append(opens + np.arange(len(opens)), len(value) - 1)] = False
    where = np.zeros(len(value), np.int64)
    where[own] = place
    left = _lesser(value)[own]
    right = (len(value) - 1 - _lesser(value[::-1]))[::-1][own]
    first = np.where(own[left], where[left] + 1, begin[text])
    last = np.where(own[right], where[right] - 1, begin[text + 1] - 1)
    return text, place, first, last


def _together(text: np.ndarray, place: np.ndarray, first: np.ndarray, sig: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last window of each set of windows that are put together, over ``length // 2`` tokens at most.

    They are of one token, and each begins behind the place of the one before it.
    """
    apart = np.ones(len(place), np.bool_)
    apart[1:] = (np.diff(text) != 0) | (sig[1:] != sig[:-1]) | (first[1:] != place[:-1] + 1) | (np.diff(place) > length // 2)
    opens = np.flatnonzero(apart)
    step = (place - np.repeat(place[opens], np.diff(np.append(opens, len(place))))) // (length // 2 + 1)
    apart[1:] |= np.diff(step) != 0
    opens = np.flatnonzero(apart)
    return opens, np.append(opens[1:], len(place))[:len(opens)] - 1


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _windows(batches: Iterator[pa.RecordBatch], length: int, functions: int,
             wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(sig, t) of all windows: function and token, text.  Each text is read once a task.

    With a filter only windows whose ``sig`` may be in it, and also ``at``: the window as place, tokens from there to its
    last place, tokens before and after these (clipped beyond passages), and ``context``: a hash of its tokens up to
    ``length`` before and after its places.
    """
    seen: set[int] = set()
    most = (1 << _REACH) - 1
    seeds = np.random.default_rng(7).integers(1, 1 << 63, functions, dtype=np.uint64)
    up = back = np.zeros(0, np.uint64)
    for batch in batches:
        new = [k for k, t in enumerate(batch.column("t").to_pylist()) if not (t in seen or seen.add(t))]
        for part in text_chunks(batch.take(pa.array(new, pa.int64())), "text", 1 << 20):
            tokens, begin = shingles(*words(part.column("text")), WORDS)
            t = part.column("t").to_numpy()
            if wanted is not None:
                if len(up) < len(tokens):
                    up, back = _powers(_BASE, len(tokens)), _powers(pow(_BASE, -1, 1 << 64), len(tokens))
                # Sums of token * base^place; a stretch's difference, shifted to place 0, tells its tokens.
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:len(tokens)])])
            for f, seed in enumerate(seeds):
                hashed = mix(tokens ^ seed)
                text, place, first, last = all_compact_windows(hashed, begin, length)
                sig = hashed[place] >> U(3) << U(3) | U(f & 7)
                if wanted is None:
                    ours, _ = _together(text, place, first, sig, length)
                    text, sig = text[ours], sig[ours]
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(t[text])], names=["sig", "t"])
                    continue
                held = _held(wanted, sig)
                text, place, first, last, sig = text[held], place[held], first[held], last[held], sig[held]
                ours, ends = _together(text, place, first, sig, length)
                text, sig, first, last, place, end = text[ours], sig[ours], first[ours], last[ends], place[ours], place[ends]
                low, high = np.maximum(first, place - length), np.minimum(last, end + length) + 1
                context = mix((sums[high] - sums[low]) * back[low] ^ mix((place - low).astype(np.uint64)))
                at = (place - begin[text]) << _SIDES | (end - place) << 2 * _REACH
                at |= np.minimum(place - first, most) << _REACH | np.minimum(last - end, most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(t[text]), pa.array(at), pa.array(context.view(np.int64))],
                    names=["sig", "t", "at", "context"])


def _wanted_texts(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose text may have candidates, each text once a task."""
    seen: set[int] = set()
    for batch in batches:
        t = batch.column("t").to_numpy()
        may = _held(bitmap, t.view(np.uint64))
        keep = [int(k) for k in np.flatnonzero(may) if not (t[k] in seen or seen.add(t[k]))]
        if keep:
            yield batch.take(pa.array(keep))


def _regions(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """(sig, part, parts, low, high, begin, tokens) of the contexts asked for: the tokens of their windows up to
    ``reach`` before and after its places; 32 bits a token tell those of a group apart."""
    seen: set[int] = set()
    side = (1 << _REACH) - 1
    for batch in batches:
        new = [k for k, t in enumerate(batch.column("t").to_pylist()) if not (t in seen or seen.add(t))]
        for chunk in text_chunks(batch.take(pa.array(new, pa.int64())), "text", 1 << 20):
            tokens, begin = shingles(*words(chunk.column("text")), WORDS)
            tokens = (tokens >> U(32)).astype(np.uint32)
            asked = chunk.column("asked")
            own, count = asked.flatten(), np.diff(asked.offsets.to_numpy())
            text = np.repeat(np.arange(len(count)), count)
            at = own.field("at").to_numpy()
            place = at >> _SIDES
            low = place - np.minimum(at >> _REACH & side, reach)
            high = place + (at >> 2 * _REACH & side >> 1) + np.minimum(at & side, reach) + 1
            for k in range(0, len(at), 1 << 12):
                some = slice(k, k + (1 << 12))
                size, open_ = high[some] - low[some], (low + begin[text])[some]
                end = np.cumsum(size)
                taken = tokens[np.repeat(open_ - end + size, size) + np.arange(end[-1])]
                data = pa.Array.from_buffers(pa.binary(), len(size), [
                    None, pa.py_buffer(np.concatenate([[0], 4 * end]).astype(np.int32)), pa.py_buffer(taken)])
                yield pa.RecordBatch.from_arrays(
                    [own.field("sig")[some], own.field("part")[some], own.field("parts")[some],
                     pa.array(chunk.column("t").to_numpy()[text[some]]), own.field("high")[some], pa.array(low[some]), data],
                    names=["sig", "part", "parts", "low", "high", "begin", "tokens"])


def dense_runs(hit: np.ndarray, length: int, similar: float) -> list[tuple[int, int]]:
    """Longest stretches of at least ``length`` that are hits up to the share that ``similar`` allows.

    Two runs of n tokens with h in common have similarity h / (2n - h), so h must be
    2 * similar / (1 + similar) of n.  A stretch begins and ends with a hit.
    """
    share = 2 * similar / (1 + similar)
    miss = share / (1 - share)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    opens, closes = edge[::2], edge[1::2]
    out: list[tuple[int, int]] = []
    # A gap of half a passage parts two passages, however long both are.
    for group in np.split(np.arange(len(opens)), np.flatnonzero(opens[1:] - closes[:-1] > length // 2) + 1):
        if not len(group) or closes[group[-1]] - opens[group[0]] < length:
            continue
        begin, end = opens[group], closes[group]
        gaps = np.concatenate([[0], begin[1:] - end[:-1]])
        after = np.cumsum((end - begin) - miss * gaps)  # score up to the end of each run of hits
        before = after - (end - begin)
        # The farthest end whose score is no less than at the start.
        best = np.maximum.accumulate(after[::-1])[::-1]
        k = 0
        while k < len(group):
            far = int(np.searchsorted(-best, -before[k] + 1e-9, "right")) - 1
            if far >= k and end[far] - begin[k] >= length:
                out.append((int(begin[k]), int(end[far])))
                k = far + 1
            else:
                k += 1
    return out


def _scores(hit: np.ndarray, length: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``hit`` the score before each place that is a hit (else infinite), and after each.

    As in ``dense_runs`` a stretch is dense if its score does not fall: a hit counts 1, a miss as much as a hit weighs up.
    """
    share = 2 * similar / (1 + similar)
    after = np.cumsum(np.where(hit, np.float32(1), np.float32(-share / (1 - share))), axis=1, dtype=np.float32)
    return np.where(hit, after - 1, np.float32(np.inf)), np.where(hit, after + np.float32(1e-3), np.float32(-np.inf))


def _runs(hit: np.ndarray, length: int, similar: float) -> np.ndarray:
    """For each row of ``hit`` whether it has a dense stretch of ``length`` or more between two hits."""
    before, after = _scores(hit, length, similar)
    if hit.shape[1] < length:
        return np.zeros(len(hit), np.bool_)
    return (after[:, length - 1:] >= np.minimum.accumulate(before[:, :hit.shape[1] - length + 1], axis=1)).any(axis=1)


def _may_cover(hit: np.ndarray, length: int, similar: float) -> np.ndarray:
    """For each row of ``hit`` the places in dense stretches, also shorter ones."""
    before, after = _scores(hit, length, similar)
    most = np.maximum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
    return most >= np.minimum.accumulate(before, axis=1)


def covers(hit: np.ndarray, length: int, similar: float) -> np.ndarray:
    """For each row of ``hit`` the places in any dense stretch of ``length`` or more between two hits."""
    n, width = hit.shape
    out = np.zeros((n, width), np.bool_)
    if not n or width < length:
        return out
    before, after = _scores(hit, length, similar)
    starts = width - length + 1
    # The farthest start for each end, looked up in all rows at once: their scores lie apart.
    far = np.float64(4 * width / (1 - similar) + 4) * np.arange(n)[:, None]
    least = np.minimum.accumulate(np.minimum(before[:, :starts], np.float32(width + 2)), axis=1)
    row, end = np.nonzero(hit[:, length - 1:])
    keys = (far - least).ravel()
    start = np.searchsorted(keys, far[row, 0] - after[row, end + length - 1], "left") - row * starts
    good = start <= end
    row, start, end = row[good], start[good], end[good] + length
    change = np.bincount(row * (width + 1) + start, minlength=n * (width + 1)) - np.bincount(
        row * (width + 1) + end, minlength=n * (width + 1))
    np.greater(np.cumsum(change.reshape(n, width + 1), axis=1)[:, :width], 0, out=out)
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted (a plain sort is faster here than the hash table of ``np.unique``)."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=values[:1] - 1))]


def _stretches(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the stretches of true entries of each row."""
    padded = np.zeros((mark.shape[0], mark.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mark
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def group_links(group: np.ndarray, side: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray,
                regions: list[np.ndarray], length: int, similar: float) -> np.ndarray:
    """Rows (t, u, start, stop): passages that contexts have in common with contexts of other texts of their group.

    Contexts come sorted by group, of one large or several small groups (``FEW``).  ``low`` and ``high`` are the least
    and greatest text of a context, ``begin`` the place of its region in ``low``.  Contexts of different sides are
    compared if there are two sides, else all.  Every pair is tested.  Written out are, for each context of one text,
    the places in passages shared with any other, and a forest of the links between texts; contexts of several texts are
    passages as they are.
    """
    share = 2 * similar / (1 + similar)
    need, alone = math.ceil(share * length - 1e-3), low == high
    keep = np.arange(len(low))
    while True:
        # Tokens of one text alone are no hits; contexts that hold no passage without them drop out.
        size = np.array([len(regions[k]) for k in keep])
        row = np.repeat(np.arange(len(keep)), size)
        tokens = np.concatenate([regions[k] for k in keep]) | group[keep][row].astype(np.uint64) << U(32)
        tokens, number = np.unique(tokens, return_inverse=True)
        v = len(tokens)
        names, text = np.unique(low[keep], return_inverse=True)
        useful = np.bincount(_distinct(number * len(names) + text[row]) // len(names), minlength=v + 1) > 1
        useful[number[~alone[keep][row]]] = True
        useful[v] = False
        ids = np.full((len(keep), size.max()), v)
        ids[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = number
        stay = _runs(useful[ids], length, similar)
        if stay.sum() < 2:
            return np.zeros((0, 4), np.int64)
        if stay.all():
            break
        keep = keep[stay]
    group, side, low, high, begin, alone = (x[keep] for x in (group, side, low, high, begin, alone))
    n, two = len(keep), bool((side != side[0]).any())
    linked = text.copy()  # a name for each text's class
    covered = (ids == v) | ~alone[:, None]
    partner = np.zeros(n, np.int64)
    edges = []
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    count = np.diff(np.append(begins, n))
    small = count.max() <= FEW and not two
    found = np.zeros((n, n) if small else (0, 0), np.bool_)

    def other(a, b):
        return np.where(low[b] != low[a], low[b], np.where(alone[b], high[a], high[b]))

    def settle(a, b, hit):
        """Pairs sorted by a, with the tokens of a that b holds."""
        run = _runs(hit, length, similar)
        a, b, hit = a[run], b[run], hit[run]
        if not len(a):
            return
        if small:
            found[a, b] = True
        partner[a] = other(a, b)
        forest = []
        for k in np.flatnonzero(linked[a] != linked[b]).tolist():
            if linked[a[k]] != linked[b[k]]:
                linked[linked == linked[b[k]]] = linked[a[k]]
                forest.append(k)
        if forest:
            row, start, stop = _stretches(covers(hit[forest], length, similar))
            k = np.array(forest)[row]
            edges.append(np.stack([low[a[k]], low[b[k]], begin[a[k]] + start, begin[a[k]] + stop], axis=1))
        # What all partners together may cover; partners that may add to what is covered, the likeliest first.
        first = np.flatnonzero(np.diff(a, prepend=-1))
        bound = covers(np.logical_or.reduceat(hit, first, axis=0), length, similar)
        bound = np.repeat(bound, np.diff(np.append(first, len(a))), axis=0)
        hits, best = hit.sum(axis=1), True
        while len(a):
            more = bound & ~covered[a]
            open_ = more.any(axis=1)
            a, hit, bound, hits, more = a[open_], hit[open_], bound[open_], hits[open_], more[open_]
            if not len(a):
                break
            able = (_may_cover(hit, length, similar) & more).any(axis=1)
            a, hit, bound, hits = a[able], hit[able], bound[able], hits[able]
            if not len(a):
                break
            now = np.ones(len(a), np.bool_)
            if best:
                order = np.lexsort((-hits, a))
                now[:] = False
                now[order[np.flatnonzero(np.diff(a[order], prepend=-1))]] = True
            some = a[now]
            first = np.flatnonzero(np.diff(some, prepend=-1))
            covered[some[first]] |= np.logical_or.reduceat(covers(hit[now], length, similar), first, axis=0)
            a, hit, bound, hits, best = a[~now], hit[~now], bound[~now], hits[~now], False

    def fits(a, b):
        return ~(alone[a] & alone[b] & (low[a] == low[b])) & (a != b)

    if small:
        rank = np.arange(n) - np.repeat(begins, count)
        entry = _distinct(ids[ids < v] * FEW + np.repeat(rank, (ids < v).sum(axis=1)))
        opens = np.flatnonzero(np.diff(entry // FEW, prepend=-1))
        holders = np.zeros(v + 1, np.uint64)
        holders[entry[opens] // FEW] = np.add.reduceat(U(1) << (entry % FEW).astype(np.uint64), opens)
        a = np.repeat(np.arange(n), np.repeat(count, count))
        b = np.arange(len(a)) - np.repeat(np.cumsum(np.repeat(count, count)) - np.repeat(count, count), np.repeat(count, count))
        b += np.repeat(begins, count)[a]
        good = fits(a, b)
        a, b = a[good], b[good]
        cuts = np.flatnonzero(np.diff(a // max(1, 2048 // int(count.max())), prepend=-1))
        for x, y in zip(cuts, np.append(cuts, len(a))[1:], strict=True):
            hit = (holders[ids[a[x:y]]] >> rank[b[x:y]].astype(np.uint64)[:, None] & U(1)).astype(np.bool_)
            near = hit.sum(axis=1) >= need
            settle(a[x:y][near], b[x:y][near], hit[near])
    else:
        step = max(1, min(n, (1 << 25) // (v + 1)))
        for at in range(0, n, step):
            some = np.arange(at, min(at + step, n))
            holds = np.zeros((v + 1, len(some)), np.bool_)
            holds[ids[some], (some - at)[:, None]] = True
            holds[v] = False

            def nearby(a, some=some, holds=holds):
                hit = holds[ids[a]]
                hits = hit.sum(axis=0, dtype=np.uint16)
                near = (hits >= need) & fits(np.int64(a), some)
                if two:
                    near &= side[some] != side[a]
                near = np.flatnonzero(near)
                return some[near], hits[near], hit[:, near].T

            # First the partners with most hits; then whichever can still link a or cover more of it.
            for likeliest in (True, False):
                waiting, pairs = [], 0
                for a in range(n):
                    near, hits, hit = nearby(a)
                    if likeliest and len(near) > FIRST:
                        most = np.argpartition(-hits.astype(np.int64), FIRST)[:FIRST]
                        near, hit = near[most], hit[most]
                    elif not likeliest and len(near):
                        if len(near) <= FIRST:
                            continue
                        if not (covers(hit.any(axis=0)[None], length, similar)[0] & ~covered[a]).any():
                            apart = linked[near] != linked[a]
                            near, hit = near[apart], hit[apart]
                    if len(near):
                        waiting.append((np.full(len(near), a), near, hit))
                        pairs += len(near)
                    if pairs > 1024:
                        settle(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                        waiting, pairs = [], 0
                if waiting:
                    settle(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
    # What a holds of b may be no passage the other way round: then b takes the places of a's passage.
    lacks = useful[ids] & ~covered
    open_ = lacks.any(axis=1)
    if small:
        found &= ~found.T
        open_ &= found.any(axis=0)
    held = _distinct(ids[ids < v] * n + np.repeat(np.arange(n), (ids < v).sum(axis=1))) if open_.any() else None

    def holding(values, among):
        return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values

    own = np.zeros(v + 1, np.bool_)
    for b in np.flatnonzero(open_).tolist():
        own[ids[b]] = True
        own[v] = False
        if small:
            near = np.flatnonzero(found[:, b])
        else:
            # All contexts that hold a token that b lacks.
            wanted = _distinct(ids[b][lacks[b]])
            ends = np.searchsorted(held, np.stack([wanted * n, (wanted + 1) * n]))
            near = _distinct(np.concatenate([held[x:y] for x, y in ends.T.tolist()]) % n)
            near = near[fits(near, np.int64(b)) & ((side[near] != side[b]) | (not two))]
        for k in range(0, len(near), 1024):
            a = near[k:k + 1024]
            hit = own[ids[a]]
            some = hit.sum(axis=1) >= need
            a, hit = a[some], hit[some]
            some = _runs(hit, length, similar)
            a, hit = a[some], hit[some]
            theirs = holding(ids[b] * n + a[:, None], held) & (ids[b] < v)
            some = (theirs & ~covered[b]).any(axis=1) & ~_runs(theirs, length, similar)
            for c, cover, mine in zip(a[some], covers(hit[some], length, similar), theirs[some], strict=True):
                mine = np.flatnonzero(mine & np.isin(ids[b], ids[c][cover]))
                if len(mine):
                    covered[b, mine[0]:mine[-1] + 1] = True
                    partner[b] = other(b, c)
        own[ids[b]] = False
    row, start, stop = _stretches(covered & (ids < v) & alone[:, None])
    spans = np.stack([low[row], partner[row], begin[row] + start, begin[row] + stop], axis=1)
    return np.concatenate([*edges, spans])


def _verify(batches: Iterator[pa.RecordBatch], length: int, similar: float) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group; only the group at hand and a batch are held."""
    tail: list[pa.RecordBatch] = []

    def cuts(key):
        return np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1

    def done(table):
        columns = [table.column(c).to_numpy() for c in ("part", "low", "high", "begin")]
        edges = [0, *cuts(np.stack([table.column(c).to_numpy() for c in ("sig", "i", "j")])).tolist(), table.num_rows]
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        tokens = [np.frombuffer(x, np.uint32) for x in table.column("tokens").to_pylist()]
        found, a = [np.zeros((0, 4), np.int64)], 0
        for k in range(1, len(edges)):
            # Small groups are put together.
            after = edges[k + 1] - edges[k] if k + 1 < len(edges) else FEW + 1
            if after > FEW or edges[k] - edges[k - 1] > FEW or edges[k] - a > 16 * FEW:
                if edges[k] - a > 1:
                    found.append(group_links(group[a:edges[k]] - group[a], *(c[a:edges[k]] for c in columns), tokens[a:edges[k]], length, similar))
                a = edges[k]
        found = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(4)], names=["t", "u", "start", "stop"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = cuts(np.stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")]))
        if tail and any(tail[-1].column(c)[-1] != batch.column(c)[0] for c in ("sig", "i", "j")):
            yield done(pa.Table.from_batches(tail))
            tail = []
        if len(ends):
            yield done(pa.Table.from_batches([*tail, batch.slice(0, int(ends[-1]))]))
            tail = [batch.slice(int(ends[-1]))]
        else:
            tail.append(batch)
    if tail:
        yield done(pa.Table.from_batches(tail))


def _held(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values may be in a filter: their bits are set."""
    bit = (values >> U(3)) & U(64 * len(bitmap) - 1)
    return ((bitmap[bit >> U(6)] >> (bit & U(63))) & U(1)).astype(np.bool_)


def _bitmap(values: DataFrame) -> np.ndarray:
    """A filter of the longs of a stored table with one column: a bit each, about sixteen bits a value.

    Its size is bounded; a fuller filter holds back less and changes no result.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * values.count()).bit_length()))
    bit = F.shiftrightunsigned(F.col(values.columns[0]), 3).bitwiseAND((1 << bits) - 1)
    cells = values.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def links(texts: DataFrame, passage: int = PASSAGE, similar: float = SIMILAR) -> DataFrame:
    """``t, u, start, stop`` (tokens of t) of passages that texts of ``texts`` (t, text) share.

    Each passage of a text is covered by its rows, and linked texts are joined by rows, directly or through others.
    """
    spark, length = texts.sparkSession, passage - WORDS + 1
    if length >= 1 << _REACH:
        raise ValueError(f"passages of {1 << _REACH} words or more are not looked for")
    functions, schema = functions_for(similar), "sig long, t long, at long, context long"
    # Stored, so that the join below meets two plain shuffles and Spark can split a common token's rows.
    ends_path, windows_path, firsts_path = (fresh_path(spark, x) for x in ("window-ends", "windows", "window-firsts"))
    map_arrow(texts, lambda it: _windows(it, length, functions), "sig long, t long").groupBy("sig").agg(
        F.min("t").alias("low"), F.max("t").alias("high"),
    ).filter("low < high").select("sig").write.parquet(ends_path)
    released(spark)
    ends = spark.read.parquet(ends_path)
    # Most windows stand in one text alone: they are made again and passed by, never stored.
    shared = spark.sparkContext.broadcast(_bitmap(ends))
    map_arrow(texts, lambda it: _windows(it, length, functions, shared.value), schema).write.parquet(windows_path)
    windows = spark.read.parquet(windows_path)
    # The filter lets windows of one text by: they are groups of one context and one text.
    windows.groupBy("sig", "context").agg(F.min(F.struct("t", "at")).alias("o"), F.max("t").alias("high")).select(
        "sig", "context", F.col("o.t").alias("low"), F.col("o.at").alias("at"), "high").write.parquet(firsts_path)
    firsts = spark.read.parquet(firsts_path)
    # Windows of one context are passages as they are, up to ``length`` around their places.
    place, side = F.shiftright("at", _SIDES), (1 << _REACH) - 1
    end = place + F.shiftright("at", 2 * _REACH).bitwiseAND(side >> 1)
    before = F.least(F.shiftright("at", _REACH).bitwiseAND(side), F.lit(length))
    after = F.least(F.col("at").bitwiseAND(side), F.lit(length))
    copies = checkpointed(windows.join(
        firsts.filter("low < high").select("sig", "context", "low", "high"), ["sig", "context"]).select(
        "t", F.when(F.col("t") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("u"),
        (place - before).alias("start"), (end + after + 1).alias("stop")).distinct())
    shared.destroy()
    del windows, ends
    for path in (ends_path, windows_path):
        dropped(spark, path)
    # Different contexts of a group are compared each to each, those of a large group by pairs of its parts.
    groups = firsts.groupBy("sig").agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("high").alias("greatest")).filter(
        "n > 1 and least < greatest").select("sig", F.ceil(F.col("n") / GROUP).alias("parts"))
    nodes = firsts.join(groups, "sig").select("low", F.struct(
        "sig", "at", "high", "parts", F.pmod(F.xxhash64("context"), "parts").alias("part")).alias("one"))
    asked = checkpointed(nodes.groupBy(F.col("low").alias("t")).agg(F.collect_list("one").alias("asked")))
    del firsts, groups, nodes
    dropped(spark, firsts_path)
    bitmap = spark.sparkContext.broadcast(_bitmap(asked.select("t")))
    sources = map_arrow(texts, lambda it: _wanted_texts(it, bitmap.value), "t long, text string")
    reach = length + length // 2
    regions = map_arrow(
        sources.join(asked, "t"), lambda it: _regions(it, reach),
        "sig long, part long, parts long, low long, high long, begin long, tokens binary")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = regions.withColumn("o", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "sig", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "low", "high", "begin",
        "tokens").repartition(count, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return copies.union(map_arrow(
        sent, lambda it: _verify(it, length, similar), "t long, u long, start long, stop long"))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE,
             similar: float = SIMILAR) -> DataFrame:
    """``id, class_id, start_word, n_words``: a row for each repeated passage of each row of ``docs``.

    A passage has at least ``passage`` words and stands, with similarity 0.8 or more, in a
    row with another text, or its row is a copy of another row (then the whole text is one
    passage if long enough).  Overlapping passages of a row are one.  ``class_id`` is the
    least id among the rows linked by passages, directly or through others (null only if
    all ids are).  Null, empty and shorter texts have no passage; rows that share nothing
    are not returned.  Texts are told apart by a 64-bit hash.  Extra columns are not read.
    """
    texts = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    ids = docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.regexp_count(
            F.col(text), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long").alias("n"))
    found = checkpointed(links(texts, passage, similar))
    ids = checkpointed(ids)
    copies = ids.groupBy("t").agg(F.count("*").alias("rows"), F.max("n").alias("n"), F.min("id").alias("least"))
    copied = copies.filter((F.col("rows") > 1) & (F.col("n") >= passage)).select(
        "t", F.lit(0).cast("long").alias("start"), (F.col("n") - WORDS + 1).alias("stop"))
    spans = found.select("t", "start", "stop").union(copied).distinct()
    # Overlapping spans of a text: a new passage begins where none before reaches.
    order = Window.partitionBy("t").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn(
        "_passage", F.sum("_new").over(order)).groupBy("t", "_passage").agg(
        F.min("start").alias("start_word"), (F.max("stop") - F.min("start") + WORDS - 1).alias("n_words"),
    ).filter(F.col("n_words") >= passage)
    edges = found.select(F.col("t").alias("a"), F.col("u").alias("b")).union(copied.select("t", "t"))
    roots = checkpointed(components(edges))
    classes = roots.join(copies, roots["node"] == copies["t"]).groupBy("root").agg(F.min("least").alias("class_id"))
    named = roots.join(classes, "root").select(F.col("node").alias("t"), "class_id")
    return merged.join(named, "t").join(ids.select("id", "t"), "t").select("id", "class_id", "start_word", "n_words")
