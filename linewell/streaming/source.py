"""A streaming source that follows growing text files, as ``tail -F`` does.

The offset of a micro-batch holds, per path, the file size seen, a hash of the
file's first bytes (HEAD at most), and an epoch.  A file that shrank, or whose first
bytes changed, was truncated or replaced: its epoch goes up and it is read from byte 0.
The driver lists files and reads no more than those first bytes; line ends are found
by the tasks.  A batch covers the bytes between two sizes, cut into ranges; a range
owns the lines whose LF lies in it and looks back for the begin of its first line.

Rows: file, epoch, byte_start, byte_end, terminated, line.  (file, epoch,
byte_start) identifies a line and orders the lines of a file.  ``file`` is written as
``scan_lines`` writes it.  A planned range that is gone when its task runs (the file was
truncated, replaced or removed meanwhile) is reported: one row with the range as
byte_start and byte_end, and NULL for terminated and line.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from linewell.sources.encoding import PYTHON_CODECS, READERS
from linewell.shared import shared_dir
from linewell.sources import uris
from linewell.sources.uris import open_fs, qualified

FORMAT = "linewell_follow"
SCHEMA = (
    "file string, epoch bigint, byte_start bigint, byte_end bigint, "
    "terminated boolean, line string"
)
BLOCK = 4 << 20
RANGE_BYTES = 64 << 20
# Fixed value: the default polling interval.
POLL = "2 seconds"


# Bytes at the begin of a file that tell it from a replacement.
HEAD = 1024
# Characters that a URI may hold as they are.
PLAIN = "!$&'()*+,;=:@~-._"


def _info(path: str) -> pafs.FileInfo:
    fs, inner = open_fs(path)
    return fs.get_file_info(inner)


def list_files(paths: Iterable[str]) -> list[str]:
    """The paths themselves, files directly inside folders, and files a pattern names.

    A pattern (``*``, ``?``, ``[...]``) may stand in the last part of a path.
    """
    found: dict[str, None] = {}
    for path in paths:
        base, _, last = path.rstrip("/").rpartition("/")
        pattern = unquote(last) if set("*?[") & set(unquote(last)) else None
        fs, inner = open_fs(base if pattern else path)
        kind = fs.get_file_info(inner).type
        if kind != pafs.FileType.Directory:
            if not pattern:
                found[path] = None
            continue
        base = base if pattern else path.rstrip("/")
        for item in sorted(fs.get_file_info(pafs.FileSelector(inner)), key=lambda f: f.path):
            wanted = fnmatchcase(item.base_name, pattern) if pattern else True
            if item.is_file and wanted and not item.base_name.startswith((".", "_")):
                found[f"{base}/{quote(item.base_name, safe=PLAIN) if ':' in base else item.base_name}"] = None
    return list(found)


def head_of(path: str, n: int = HEAD) -> bytes:
    """The first ``n`` bytes of a file, or all it has."""
    fs, inner = open_fs(path)
    with fs.open_input_file(inner) as f:
        return f.read_at(min(n, f.size()), 0)


def fingerprint(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


@dataclass
class ByteRange(InputPartition):
    path: str
    epoch: int
    start: int
    stop: int
    last: bool  # of the batch in this file
    head: int
    print_: str


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.partial = options.get("emitpartial", "false") == "true"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.codec = options.get("codec", "utf-8")
        self.state_file = options["statefile"]
        self.known = self._load()

    # The last state per path survives restarts here: Spark does not hand the
    # checkpointed offset to latestOffset().
    def _load(self) -> dict:
        fs, inner = open_fs(self.state_file)
        if fs.get_file_info(inner).type == pafs.FileType.NotFound:
            return {}
        with fs.open_input_stream(inner) as f:
            return json.loads(f.read())

    def _save(self) -> None:
        fs, inner = open_fs(self.state_file)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner + ".new") as f:
            f.write(json.dumps(self.known).encode())
        fs.move(inner + ".new", inner)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        before = json.dumps(self.known, sort_keys=True)
        for path in list_files(self.paths):
            self._look(path)
        if json.dumps(self.known, sort_keys=True) != before:
            self._save()  # before Spark logs the offset that uses it
        return json.loads(json.dumps(self.known))

    def _look(self, path: str) -> None:
        old = self.known.get(path)
        info = _info(path)
        if info.type != pafs.FileType.File:
            return  # gone for now: followed by name, it may come back
        size = info.size
        stamp = info.mtime_ns or 0
        if old and (old["seen"], old["mtime"]) == (size, stamp):
            return
        data = head_of(path)
        same = (
            old is not None
            and size >= old["seen"]
            and fingerprint(data[:old["head"]]) == old["print"]
        )
        epoch = 0 if old is None else old["epoch"] + (0 if same else 1)
        head = data[:size]
        self.known[path] = {
            "seen": size, "epoch": epoch, "head": len(head), "print": fingerprint(head), "mtime": stamp,
        }

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for path, new in end.items():
            old = start.get(path)
            if old and new["epoch"] < old["epoch"]:
                raise ValueError(f"{self.state_file} was lost; restart with a new checkpoint")
            first = old["seen"] if old and old["epoch"] == new["epoch"] else 0
            for begin in range(first, new["seen"], self.range_bytes):
                stop = min(begin + self.range_bytes, new["seen"])
                out.append(ByteRange(
                    path, new["epoch"], begin, stop, stop == new["seen"], new["head"], new["print"]))
        # Spark wants at least one partition of a non-empty offset range.
        return out or [ByteRange("", 0, 0, 0, False, 0, "")]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.start >= p.stop:
            return
        at = p.start
        if not self._still_there(p):
            yield _loss(p, at)
            return
        for base, lines, ended, at in self._blocks(p):
            if not lines:
                continue
            widths = np.fromiter((len(b) for b in lines), np.int64, len(lines)) + 1
            starts = base + np.cumsum(widths) - widths
            done = np.ones(len(lines), bool)
            done[-1] = ended
            yield _rows(p, starts, starts + widths, done, [b.decode(self.codec, "replace") for b in lines])
        if at < p.stop:
            yield _loss(p, at)

    @staticmethod
    def _still_there(p: ByteRange) -> bool:
        info = _info(p.path)
        if info.type != pafs.FileType.File or info.size < p.stop:
            return False
        return fingerprint(head_of(p.path, p.head)) == p.print_

    def _blocks(self, p: ByteRange) -> Iterator[tuple[int, list[bytes], bool, int]]:
        """(offset of first line, whole lines, last one LF-terminated?, bytes taken up to) per block."""
        fs, inner = open_fs(p.path)
        with fs.open_input_file(inner) as f:
            at, base, held = p.start, None, []  # held: parts of the line at hand
            while at < p.stop:
                data = f.read_at(min(BLOCK, p.stop - at), at)
                if not data:
                    yield 0, [], False, at  # shrank while it was read
                    return
                at += len(data)
                pieces = data.split(b"\n")
                if len(pieces) == 1:
                    held.append(data)
                    continue
                if base is None:
                    base, lead = self._lead(f, p.start)
                    held.insert(0, lead)
                pieces[0] = b"".join([*held, pieces[0]])
                held = [pieces.pop()]
                yield base, pieces, True, at
                base += sum(map(len, pieces)) + len(pieces)
            rest = []
            if p.last and self.partial:
                if base is None:
                    base, lead = self._lead(f, p.start)
                    held.insert(0, lead)
                rest = [x for x in [b"".join(held)] if x]
            yield base or 0, rest, False, at

    @staticmethod
    def _lead(f, start: int) -> tuple[int, bytes]:
        """Where the line that ``start`` lies in begins, and its bytes up to ``start``."""
        end, parts, size = start, [], 1 << 12
        while end > 0:
            begin = max(0, end - size)
            data = f.read_at(end - begin, begin)
            cut = data.rfind(b"\n")
            parts.append(data[cut + 1:])
            if cut >= 0:
                return begin + cut + 1, b"".join(reversed(parts))
            end, size = begin, min(BLOCK, 8 * size)
        return 0, b"".join(reversed(parts))


def _rows(p: ByteRange, starts, ends, done, lines) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "file": pa.array([p.path] * len(lines), pa.string()),
        "epoch": pa.array([p.epoch] * len(lines), pa.int64()),
        "byte_start": pa.array(starts, pa.int64()),
        "byte_end": pa.array(ends, pa.int64()),
        "terminated": pa.array(done, pa.bool_()),
        "line": pa.array(lines, pa.string()),
    })


def _loss(p: ByteRange, at: int) -> pa.RecordBatch:
    return _rows(p, [at], [p.stop], [None], [None])


class FollowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options)


def follow(
    spark: SparkSession,
    paths: str | Iterable[str],
    encoding: str = "UTF-8",
    emit_partial: bool = False,
    state_file: str | None = None,
    range_bytes: int = RANGE_BYTES,
    name: str = "",
) -> DataFrame:
    """Streaming lines of files (or of the files in folders) as they grow.

    An unterminated last line is held back until its LF arrives; with
    ``emit_partial`` it is sent at once with ``terminated=false`` and sent again
    as it grows (see ``latest_lines``).  Paths without a scheme are resolved as Spark
    resolves them.  ``state_file`` keeps epochs across restarts; by default it lies in
    the shared folder under a name made from ``paths`` and ``name``: give two queries
    over the same paths two names.  Encodings must end lines with a single LF byte, so
    not UTF-16.
    """
    codec = READERS.get(encoding.upper())
    if codec is None or codec.startswith("UTF-16"):
        raise ValueError(f"cannot follow files in encoding {encoding!r}")
    paths = [qualified(spark, p) for p in ([paths] if isinstance(paths, str) else dict.fromkeys(paths))]
    if state_file is None:
        name_of = hashlib.sha1(json.dumps([name, *paths] if name else paths).encode()).hexdigest()
        state_file = f"{qualified(spark, shared_dir(spark))}/follow-{name_of}/epochs.json"
    # Spark's planner process for streams gets no --py-files: the class goes by value.
    for module in (uris, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(FollowSource)
    return (
        spark.readStream.format(FORMAT)
        .option("paths", json.dumps(paths))
        .option("emitPartial", str(emit_partial).lower())
        .option("rangeBytes", str(range_bytes))
        .option("codec", PYTHON_CODECS[codec])
        .option("stateFile", state_file)
        .load()
    )
