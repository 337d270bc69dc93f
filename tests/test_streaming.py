import os

import pytest
from pyspark.sql import functions as F

from linewell.operators import search, search_update
from linewell.sources import scan_lines
from linewell.streaming import (
    batch_status, current_epoch, epochs_of, follow, follow_counts, follow_numbered,
    follow_search, follow_status, latest_lines,
)
from linewell.streaming.source import FollowReader

# 83 characters with the number, as the growing test file of the blueprint.
LINE = "A made-up record used to try out readers of very long files, with the number %06d\n"


class Sink:
    """A memory-sink query over followed files, run batch by batch."""

    def __init__(self, stream, name, mode="append"):
        self.query = (
            stream.writeStream.format("memory").queryName(name).outputMode(mode)
            .trigger(processingTime="0 seconds").start()
        )
        self.name = name

    def rows(self, spark):
        self.query.processAllAvailable()
        table = spark.table(self.name)
        # A copy: the memory sink's own table cannot be joined with itself.
        return spark.createDataFrame(table.collect(), table.schema)

    def stop(self):
        self.query.stop()


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def numbered(first, n):
    return "".join(LINE % i for i in range(first, first + n))


def test_growing_file_goldens(spark, tmp_path):
    """2,000 / 5,001 / 5,022 / 5,042 lines and 12 / 26 / 26 / 27 matches, partial lines shown."""
    path = str(tmp_path / "log")
    append(path, numbered(0, 2000))
    sink = Sink(follow(spark, path, emit_partial=True, range_bytes=50_000), "growing")
    try:
        for text, lines, matches in [
            ("", 2000, 12),
            (numbered(0, 3000) + "The first 123 half, ", 5001, 26),
            ("and the second 123 half\n" + numbered(0, 20) + "A half without, ", 5022, 26),
            ("and the second 123 half\n" + numbered(0, 20), 5042, 27),
        ]:
            append(path, text)
            now = latest_lines(sink.rows(spark))
            assert now.count() == lines
            assert search(now, "123").count() == matches
        now = now.orderBy("byte_start").collect()
        whole = open(path, "rb").read()
        assert [r.line for r in now] == whole.decode().split("\n")[:-1]
        at = 0
        for r in now:
            assert r.byte_start == at and r.terminated
            at = r.byte_end
        assert at == len(whole)
    finally:
        sink.stop()


def test_partial_line_is_held_back(spark, tmp_path):
    path = str(tmp_path / "log")
    append(path, "a\nb\npart")
    sink = Sink(follow(spark, path), "held")
    try:
        assert [r.line for r in sink.rows(spark).collect()] == ["a", "b"]
        append(path, "ial\nc\n")
        got = sink.rows(spark).orderBy("byte_start").collect()
        assert [(r.line, r.byte_start) for r in got] == [
            ("a", 0), ("b", 2), ("partial", 4), ("c", 12)
        ]
    finally:
        sink.stop()


def test_truncated_replaced_and_late_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    one, two = str(folder / "one"), str(folder / "two")
    append(one, "x1\nx2\nx3\n")
    sink = Sink(follow(spark, str(folder)), "epochs")
    try:
        assert sink.rows(spark).count() == 3
        append(two, "late\n")
        with open(one, "wb") as f:  # shorter, same first line
            f.write(b"x1\ny2\n")
        assert sink.rows(spark).count() == 6
        os.replace(two, one)  # rolled over: another file under the name
        append(one, "more\n" * 5)
        rows = sink.rows(spark)
        got = [(r.file[-3:], r.epoch, r.line) for r in rows.orderBy("file", "epoch", "byte_start").collect()]
        assert got == [
            ("one", 0, "x1"), ("one", 0, "x2"), ("one", 0, "x3"), ("one", 1, "x1"),
            ("one", 1, "y2"), ("one", 2, "late"), *[("one", 2, "more")] * 5, ("two", 0, "late"),
        ]
        marks = rows.select("file", "epoch", F.lit(1).alias("line_no")).distinct()
        kept = current_epoch(marks, epochs_of(rows)).collect()
        assert sorted((r.file[-3:], r.epoch) for r in kept) == [("one", 2), ("two", 0)]
    finally:
        sink.stop()


def test_follow_search_equals_batch_search(spark, tmp_path):
    path = str(tmp_path / "log")
    append(path, numbered(0, 50))
    sink = Sink(follow_search(follow(spark, path, range_bytes=997), "7$"), "fsearch")
    try:
        sink.rows(spark)
        append(path, numbered(50, 350))
        got = sorted(r.line for r in sink.rows(spark).collect())
    finally:
        sink.stop()
    want = search(scan_lines(spark, path, "UTF-8"), "7$").collect()
    assert got == sorted(r.line for r in want) and len(got) == 40


def test_follow_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    append(path, numbered(0, 200))
    sink = Sink(follow_counts(follow(spark, path), "123"), "fcounts", "complete")
    try:
        assert tuple(sink.rows(spark).first())[2:] == (200, 1, 83)
        append(path, "\twide 123\n")
        assert tuple(sink.rows(spark).first())[2:] == (201, 2, 83)
    finally:
        sink.stop()


def test_numbering_and_restart_from_checkpoint(spark, tmp_path):
    path, out, counters, check, state = (
        str(tmp_path / n) for n in ("log", "out", "counters", "check", "state/epochs.json")
    )

    def run():
        stream = follow(spark, path, state_file=state, range_bytes=1000)
        query = (
            follow_numbered(stream, out, counters)
            .option("checkpointLocation", check).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None

    append(path, numbered(0, 100) + "tail")
    run()
    append(path, " done\n" + numbered(100, 40))
    run()
    run()
    with open(path, "wb") as f:  # same first line, shorter: a new epoch
        f.write(numbered(0, 3).encode())
    run()
    rows = spark.read.parquet(out).orderBy("epoch", "line_no").collect()
    old = [r for r in rows if r.epoch == 0]
    assert [r.line_no for r in old] == list(range(141))
    assert old[100].line == "tail done" and old[140].line.endswith("000139")
    assert [(r.epoch, r.line_no) for r in rows[141:]] == [(1, 0), (1, 1), (1, 2)]


def test_default_state_survives_a_restart(spark, tmp_path):
    path, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))

    def run():
        query = (
            follow(spark, path).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", check).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)

    append(path, "same\nold\n")
    run()
    with open(path, "wb") as f:
        f.write(b"same\n")
    run()
    append(path, "new\n")
    run()
    got = sorted((r.epoch, r.line) for r in spark.read.parquet(out).collect())
    assert got == [(0, "old"), (0, "same"), (1, "new"), (1, "same")]


def test_batch_status_keeps_every_batch(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "status")
    append(path, "hit\n")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    query = follow_status(follow(spark, path), "hit", out).trigger(processingTime="0 seconds").option(
        "checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        query.processAllAvailable()
        for k in range(1, 5):
            append(path, "hit\n" if k % 2 == 0 else "miss\n")
            query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    got = [tuple(r) for r in batch_status(spark, out).orderBy("batch_id").collect()]
    assert got == [(k, "NEW_DATA" if k % 2 else "NEW_FILTERED_DATA") for k in range(5)]
    with pytest.raises(Exception, match="(?i)pattern"):
        follow_status(follow(spark, path), "(", out)


def test_lost_counters_stop_the_numbering(spark, tmp_path):
    import shutil

    path, out, counters = (str(tmp_path / x) for x in ("log", "out", "counters"))

    def run():
        query = follow_numbered(follow(spark, path), out, counters).trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.awaitTermination(120)

    append(path, "a\nb\n")
    run()
    append(path, "c\n")
    run()
    assert sorted((r.line_no, r.line) for r in spark.read.parquet(out).collect()) == [(0, "a"), (1, "b"), (2, "c")]
    shutil.rmtree(f"{counters}/batch=1")
    append(path, "d\n")
    with pytest.raises(Exception, match="(?i)path"):
        run()


def test_growth_with_search_update(spark, tmp_path):
    path = str(tmp_path / "log")
    append(path, numbered(0, 2000))
    lines = scan_lines(spark, path, "UTF-8")
    found, done = search(lines, "123"), lines.count()
    assert found.count() == 12
    for text, n_lines, n_matches in [
        (numbered(0, 3000) + "The first 123 half, ", 5001, 26),
        ("and the second 123 half\n" + numbered(0, 20) + "A half without, ", 5022, 26),
        ("and the second 123 half\n" + numbered(0, 20), 5042, 27),
    ]:
        found = spark.createDataFrame(found.collect(), found.schema)
        append(path, text)
        lines = scan_lines(spark, path, "UTF-8")
        table = spark.createDataFrame([(lines.first().file, done)], "file string, processed long")
        by_table = search_update(found, lines, table, "123", chunk=100)
        found = search_update(found, lines, done, "123")
        done = lines.count()
        assert (done, found.count()) == (n_lines, n_matches)
        assert sorted(by_table.collect()) == sorted(found.collect())
        assert sorted(search(lines, "123").collect()) == sorted(found.collect())


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 1000])
def test_ranges_own_the_lines_that_end_in_them(tmp_path, size, monkeypatch):
    import json

    import linewell.streaming.source as module

    monkeypatch.setattr(module, "BLOCK", 3)
    path = str(tmp_path / "log")
    append(path, "\n\nabc\nde\n\nfghijklm\nn\nopen")
    reader = FollowReader({
        "paths": json.dumps([path]), "rangebytes": str(size), "emitpartial": "true",
        "statefile": str(tmp_path / "s" / "epochs.json"),
    })
    got = []
    for p in reader.partitions({}, reader.latestOffset()):
        for batch in reader.read(p):
            got += [(r["byte_start"], r["line"], r["terminated"]) for r in batch.to_pylist()]
    at, want = 0, []
    for line in ["", "", "abc", "de", "", "fghijklm", "n", "open"]:
        want.append((at, line, line != "open"))
        at += len(line) + 1
    assert got == want


def test_a_range_that_is_gone_is_reported(tmp_path):
    import json

    path = str(tmp_path / "log")
    append(path, "one\ntwo\nthree\n")
    reader = FollowReader({
        "paths": json.dumps([path]), "rangebytes": "8", "statefile": str(tmp_path / "s" / "epochs.json")})
    parts = reader.partitions({}, reader.latestOffset())

    def rows():
        return [(r["byte_start"], r["byte_end"], r["terminated"], r["line"])
                for p in parts for b in reader.read(p) for r in b.to_pylist()]

    assert rows() == [(0, 4, True, "one"), (4, 8, True, "two"), (8, 14, True, "three")]
    with open(path, "wb") as f:
        f.write(b"one\n")
    assert rows() == [(0, 8, None, None), (8, 14, None, None)]
    with open(path, "wb") as f:
        f.write(b"another\nbegin\n")  # same size, other file
    assert rows() == [(0, 8, None, None), (8, 14, None, None)]
    os.remove(path)
    assert rows() == [(0, 8, None, None), (8, 14, None, None)]


def test_followed_files_are_named_as_scanned_ones(spark, tmp_path):
    for name in ("a b.log", "v+(1).log", "other.txt"):
        append(str(tmp_path / name), f"{name}\n")
    sink = Sink(follow(spark, f"{tmp_path}/*.log", name="named"), "named")
    try:
        got = sorted((r.file, r.line) for r in sink.rows(spark).collect())
    finally:
        sink.stop()
    scanned = scan_lines(spark, f"{tmp_path}/*.log", "UTF-8").collect()
    assert got == sorted((r.file, r.line) for r in scanned)


def test_a_long_line_over_many_ranges(tmp_path, monkeypatch):
    import json

    import linewell.streaming.source as module

    monkeypatch.setattr(module, "BLOCK", 64)
    path = str(tmp_path / "log")
    append(path, "x" * 50_000 + "\ny\n")
    reader = FollowReader({
        "paths": json.dumps([path]), "rangebytes": "1000", "statefile": str(tmp_path / "s" / "epochs.json")})
    offset = reader.latestOffset()
    got = [r["line"] for p in reader.partitions({}, offset) for b in reader.read(p) for r in b.to_pylist()]
    assert got == ["x" * 50_000, "y"]
    append(path, "half")
    middle = reader.latestOffset()
    assert [r for p in reader.partitions(offset, middle) for b in reader.read(p) for r in b.to_pylist()] == []
    append(path, " and half\n")
    last = reader.latestOffset()
    got = [(r["byte_start"], r["line"]) for p in reader.partitions(middle, last) for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(50_003, "half and half")]
