"""License and rights notices in whole texts: exact phrases, and notices with a few errors.

A text is brought to its words, lower-cased and joined by one space.  A notice of n
characters may hold up to n // 10 errors; cut into one piece more than that, at
least one piece must stand unchanged (pigeonhole).  Exact search for the pieces gives
candidate places, and the regex library's bounded-error matching checks the text
around them and reports the span with the fewest errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow
from linewell.llm._words import text_chunks

#: Phrases found exactly, by label (fixed values of the contract).
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Short notices found with errors, by label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software": "isc",
    "no part of this publication may be reproduced": "reserved",
}
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_WORD[48:58] = True
_WORD[97:123] = True
FOUND = "array<struct<label:string,start_word:bigint,start_byte:bigint,end_byte:bigint,errors:int,score:double,base:boolean>>"


def _errors(notice: str) -> int:
    return len(notice) // 10


def _pieces(notice: str) -> list[tuple[int, bytes]]:
    """(offset, piece) of as many nearly equal pieces as errors are allowed, plus one."""
    n = _errors(notice) + 1
    cuts = [round(k * len(notice) / n) for k in range(n + 1)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_SEEDS = [(notice, label, _errors(notice), _pieces(notice)) for notice, label in NOTICES.items()]
_FUZZY = {notice: regex.compile(b"(?be)(?:" + notice.encode() + b"){e<=%d}" % _errors(notice)) for notice in NOTICES}


def words_only(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words of ``text``, A-Z lower-cased, one space between; where each byte comes from."""
    low = np.frombuffer(text.lower(), dtype=np.uint8)
    word = _WORD[low]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first byte of each gap becomes its space
    return np.where(word, low, 32)[keep].astype(np.uint8).tobytes(), np.flatnonzero(keep)


def _places(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def _hits(pattern: regex.Pattern, text: bytes, a: int, b: int, least: int) -> Iterator[regex.Match]:
    """The best hit in text[a:b], then those before and behind it, at least ``least`` bytes each."""
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        hit = pattern.search(text, a, b) if b - a >= least else None
        if hit and hit.end() > hit.start():
            yield hit
            waiting += [(a, hit.start()), (hit.end(), b)]


def scan_text(text: bytes) -> tuple[int, list[dict]]:
    """The number of words and all notices of one text, in order of their start."""
    plain, origin = words_only(text)
    n_words = len(plain.split())
    gaps = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
    found = []

    def add(label, start, end, errors, score, base):
        found.append({
            "label": label, "start_word": int(np.searchsorted(gaps, start)), "start_byte": int(origin[start]),
            "end_byte": int(origin[end - 1]) + 1, "errors": errors, "score": score, "base": base})

    for phrase, label in PHRASES.items():
        seek = phrase.encode()
        for at in _places(plain, seek):
            end = at + len(seek)
            if (at == 0 or plain[at - 1] == 32) and (end == len(plain) or plain[end] == 32):
                add(label, at, end, 0, 1.0, True)
    for notice, label, most, pieces in _SEEDS:
        windows = sorted(
            (max(0, at - offset - most), at - offset + len(notice) + most)
            for offset, piece in pieces for at in _places(plain, piece))
        regions: list[list[int]] = []
        for a, b in windows:
            if regions and a <= regions[-1][1]:
                regions[-1][1] = max(b, regions[-1][1])
            else:
                regions.append([a, b])
        for a, b in regions:
            for hit in _hits(_FUZZY[notice], plain, a, min(b, len(plain)), len(notice) - most):
                start, end = hit.span()
                while start < end and plain[start] == 32:
                    start += 1
                if start < end:
                    errors = sum(hit.fuzzy_counts)
                    add(label, start, end, errors, 1.0 - errors / len(notice), False)
    found.sort(key=lambda x: (x["start_byte"], x["label"], not x["base"]))
    return n_words, found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch, "text"):
            done = [scan_text((t or "").encode()) for t in part.column("text").to_pylist()]
            kind = pa.list_(pa.struct([
                ("label", pa.string()), ("start_word", pa.int64()), ("start_byte", pa.int64()),
                ("end_byte", pa.int64()), ("errors", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([n for n, _ in done], pa.int64()), pa.array([f for _, f in done], kind)],
                names=["id", "n_words", "found"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, found`` for every row: all notices with label, word, byte span and errors.

    Base phrases are exact (``base``), the others may hold errors.  Null and empty texts
    have no words and find nothing; repeated rows are scanned each; spans are bytes of the
    UTF-8 text.  Other columns are not read, so their names clash with nothing.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = dict(narrow.dtypes)["id"]
    return map_arrow(narrow, _scan, f"id {kind}, n_words bigint, found {FOUND}")


def digest(found: DataFrame) -> DataFrame:
    """One summary row a scanned row: counts, first and last base place, labels and score."""
    base = F.filter("found", lambda x: x["base"])
    at = F.transform(base, lambda x: x["start_word"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return found.select(
        "id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"))
