import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linewell.operators import page, range_max_length, search_update
from linewell.operators.ordered import dense_index, total_in_place
from linewell.sources import (
    append_ranged_table, detect_encoding, file_changes, file_info, file_moves, line_positions, list_tree, listing,
    number_lines, raw_lines, read_lines_table, read_logs, read_ranged_table, read_ranges, remember, scan_lines,
    synth_lines, write_lines_table, write_logs,
)
from linewell.sources.text_sink import TextWriter, Written, export_name


def rows_of(data: bytes):
    parts = data.split(b"\n")
    lines = [(p, True) for p in parts[:-1]] + ([(parts[-1], False)] if parts[-1] else [])
    out, at = [], 0
    for i, (raw, done) in enumerate(lines):
        out.append((i, raw, at, at + len(raw) + 1, done))
        at += len(raw) + 1
    return out


@pytest.mark.parametrize("split", ["37", "1000", "128m"])
def test_numbers_and_positions_for_any_split_size(spark, tmp_path, split):
    rng = random.Random(7)
    files = {
        "a.log": b"".join(b"x" * rng.randrange(0, 90) + b"\n" for _ in range(150)),
        "b.log": b"one\r\ntwo\n\n\nlast without end",
        "c.log": b"",
        "d.log": b"\n",
        "e.log": ("é\tü\n" * 50).encode(),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [str(tmp_path / n) for n in files]
        df = number_lines(raw_lines(spark, paths + paths), positions=True)
        got = {}
        for r in df.collect():
            name = r.file.rsplit("/", 1)[1]
            got.setdefault(name, []).append(
                (r.line_no, bytes(r.raw), r.byte_start, r.byte_end, r.terminated)
            )
            assert r.display_no == r.line_no + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, data in files.items():
        assert sorted(got.get(name, [])) == rows_of(data), name


def test_missing_files_are_empty(spark, tmp_path):
    (tmp_path / "here").write_bytes(b"a\nb")
    paths = [str(tmp_path / "gone"), str(tmp_path / "here"), str(tmp_path / "gone2")]
    got = scan_lines(spark, paths, "UTF-8", positions=True).orderBy("line_no").collect()
    assert [(r.line, r.terminated) for r in got] == [("a", True), ("b", False)]
    assert scan_lines(spark, [str(tmp_path / "gone")]).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_lines(spark, [str(tmp_path / "gone")], missing_ok=False, encoding="UTF-8")


@pytest.mark.parametrize("codec,name,text", [
    ("utf-8", "UTF-8", "naïve\tß\n漢字\n😀 end"),
    ("latin-1", "ISO-8859-1", "naïve\nß\nend"),
    ("utf-16-le", "UTF-16LE", "﻿Acérbe\nĊa ਊ\nfin\n"),
    ("utf-16-be", "UTF-16BE", "﻿Acérbe\nĊa ਊ\nfin\n"),
    ("cp1251", "windows-1251", "Привет\nмир"),
    ("cp1252", "CP1252", "€uro\nœ"),
    ("big5", "Big5", "漢字\n中文"),
    ("gb18030", "GB18030", "汉字\n中文"),
    ("shift_jis", "Shift-JIS", "日本\n語"),
    ("koi8-r", "KOI8-R", "Привет\nмир"),
])
def test_ten_encodings(spark, tmp_path, codec, name, text):
    (tmp_path / "f").write_bytes(text.encode(codec))
    got = scan_lines(spark, str(tmp_path / "f"), name).orderBy("line_no").collect()
    want = text.removeprefix("﻿").split("\n")
    assert [r.line for r in got] == (want[:-1] if want[-1] == "" else want)


def test_malformed_bytes_become_replacement_characters(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"ok\nbad \xff byte\n")
    got = scan_lines(spark, str(tmp_path / "f"), "UTF-8").orderBy("line_no").collect()
    assert [r.line for r in got] == ["ok", "bad � byte"]


GUESSES = [  # name, bytes, strict guess, lenient guess
    ("ascii", b"plain\ntext\n", "ASCII7", "ASCII7"),
    ("high", b"a\xff\n", "ASCII8", "ASCII8"),
    ("two", "é".encode(), "UTF8", "UTF8"),
    ("three", "漢".encode(), "UTF8", "UTF8"),
    ("four", "😀".encode(), "UTF8", "UTF8"),
    ("overlong2", b"a\xc1\x81", "ASCII8", "ASCII8"),
    ("overlong3", b"a\xe0\x80\x80", "ASCII8", "ASCII8"),
    ("overlong4", b"a\xf0\x80\xa0\x80", "ASCII8", "UTF8"),
    ("overlong4b", b"a\xf0\x80\x9f\xbf", "ASCII8", "ASCII8"),
    ("toolarge", b"a\xf7\xbf\xbf\xbf", "ASCII8", "UTF8"),
    ("truncated", b"a\xe6\xbc", "ASCII8", "ASCII8"),
    ("interrupted", b"a\xc3x\xa9", "ASCII8", "UTF8"),
    ("bomle", b"\xff\xfea\x00", "UTF16LE", "UTF16LE"),
    ("bombe", b"\xfe\xff\x00a", "UTF16BE", "UTF16BE"),
    ("latebom", b"\x10\x10\xfe\xff", "ASCII8", "ASCII8"),
    ("mixed", "é\n".encode() + b"\xe9\n", "ASCII8", "ASCII8"),
]


@pytest.mark.parametrize("mode,col", [("strict", 2), ("ref", 3)])
def test_encoding_guess(spark, tmp_path, mode, col):
    for name, data, *_ in GUESSES:
        (tmp_path / name).write_bytes(data)
    raw = raw_lines(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: r.guess for r in detect_encoding(raw, mode).collect()}
    assert got == {g[0]: g[col] for g in GUESSES}


def test_lenient_guess_over_all_sequences(spark, tmp_path):
    """Every 2-byte form and both ends of each lead byte of the longer ones."""
    from linewell.sources.encoding import _lenient
    import pandas as pd

    def form(cp, n):
        lead = {2: 0xC0, 3: 0xE0, 4: 0xF0}[n]
        tail = [0x80 | (cp >> (6 * i)) & 0x3F for i in reversed(range(n - 1))]
        return bytes([lead | cp >> (6 * (n - 1)), *tail])

    cases = [(form(cp, 2), cp >= 0x80) for cp in range(0x800)]
    cases += [(form(cp, 3), cp >= 0x800) for cp in range(0x10000)]
    cases += [(form(cp, 4), cp >= 0x800) for cp in range(0, 0x200000, 37)]
    given = spark.createDataFrame(pd.DataFrame({"n": range(len(cases)), "raw": [bytearray(c[0]) for c in cases]}))
    verdict = given.select("n", _lenient(F.col("raw")).alias("ok")).orderBy("n").collect()
    assert [r.ok for r in verdict] == [c[1] for c in cases]


def test_auto_encoding_reads_each_file_its_own_way(spark, tmp_path):
    (tmp_path / "a").write_bytes("é\nx".encode())
    (tmp_path / "b").write_bytes("é\nx".encode("latin-1"))
    (tmp_path / "c").write_bytes("﻿é\nx\n".encode("utf-16-le"))
    got = scan_lines(spark, [str(tmp_path / n) for n in "abc"]).orderBy("file", "line_no")
    assert [r.line for r in got.collect()] == ["é", "x"] * 3


def test_odd_file_names(spark, tmp_path):
    names = ["a b.log", "c%20d.log", "e[1].log", "f{x,y}.log", "g+h.log"]
    for name in names:
        (tmp_path / name).write_bytes(f"é {name}\n".encode())
    (tmp_path / "e1.log").write_bytes(b"other")
    got = scan_lines(spark, str(tmp_path)).collect()
    assert sorted(r.line for r in got) == sorted([f"é {n}" for n in names] + ["other"])


def test_file_info(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 2047 + b"\n")
    (tmp_path / "b").write_bytes("é\tlong\nx\n".encode())
    (tmp_path / "c").write_bytes("\ufeffone\n\u0a0atwo\nthree".encode("utf-16-le"))
    (tmp_path / "d").write_bytes(b"")
    (tmp_path / "e").write_bytes(b"\xff\xe9\n")
    rows = file_info(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r.n_lines, r.max_length, r.size, r.guess) for r in rows] == [
        (1, 2047, 2048, "ASCII7"), (2, 12, 10, "UTF8"), (3, 5, 30, "UTF16LE"), (0, 0, 0, "ASCII7"), (1, 2, 3, "ASCII8")]
    assert rows[0].size_label == "2.0 KiB" and all(r.mtime is not None for r in rows)


def test_names_that_spark_would_skip_are_refused(spark, tmp_path):
    for name in ("_h.log", ".h.log", "v.log"):
        (tmp_path / name).write_bytes(b"x\n")
    with pytest.raises(ValueError, match="_h.log"):
        scan_lines(spark, [str(tmp_path / n) for n in ("_h.log", ".h.log", "v.log")])
    assert scan_lines(spark, str(tmp_path / "v.log"), "UTF-8").count() == 1


def test_compressed_files_have_lines_but_no_positions(spark, tmp_path):
    import gzip

    (tmp_path / "a.gz").write_bytes(gzip.compress("".join(f"{k}\n" for k in range(20_000)).encode()))
    path = str(tmp_path / "a.gz")
    assert scan_lines(spark, path, "UTF-8").filter("line_no = cast(line as bigint)").count() == 20_000
    with pytest.raises(Exception, match="no byte positions"):
        scan_lines(spark, path, "UTF-8", positions=True).count()
        scan_lines(spark, path, "UTF-8", positions=True).collect()


def test_table_positions_match_file_positions(spark, tmp_path):
    lines = synth_lines(spark, 100, "line %03d é")
    got = line_positions(lines, chunk=7).orderBy("line_no").collect()
    data = "".join(f"line {i:03d} é\n" for i in range(100)).encode()
    want = rows_of(data)
    assert [(r.line_no, r.byte_start, r.byte_end) for r in got] == [
        (w[0], w[2], w[3]) for w in want
    ]


def test_lines_table_prunes_by_line_number(spark, tmp_path):
    path = str(tmp_path / "table")
    write_lines_table(synth_lines(spark, 1000, "l%d", partitions=4), path)
    page = read_lines_table(spark, path).filter(F.col("line_no").between(10, 12))
    assert "GreaterThanOrEqual(line_no,10)" in page._jdf.queryExecution().toString()
    assert sorted(r.line for r in page.collect()) == ["l10", "l11", "l12"]


def test_dense_index_over_chunks(spark):
    df = synth_lines(spark, 500, "%d").filter("line_no % 7 = 3")
    for r in dense_index(df, "idx", chunk=10).collect():
        assert r.idx == (r.line_no - 3) // 7


def test_file_changes(spark, tmp_path):
    for name in "abcd":
        (tmp_path / name).write_bytes(b"12345")
    before = spark.createDataFrame(listing(spark, str(tmp_path)).collect())
    (tmp_path / "a").write_bytes(b"123456")
    (tmp_path / "b").write_bytes(b"1")
    (tmp_path / "c").unlink()
    (tmp_path / "e").write_bytes(b"new")
    got = {r.path.rsplit("/", 1)[1]: r.change
           for r in file_changes(before, listing(spark, str(tmp_path))).collect()}
    assert got == {"a": "DATA_ADDED", "b": "TRUNCATED", "c": "DELETED", "d": "UNCHANGED",
                   "e": "CREATED"}


def test_tree_is_listed_as_spark_lists_it(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name in ("a", "with space", "per%cent", "h#sh", "caf\u00e9", "q?", "deep/b", "deep/er/[c]", "_hidden", ".hidden"):
        (tmp_path / name).write_bytes(name.encode() * 300)
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path: (r.size, r.mtime, bytes(r.head)) for r in list_tree(spark, str(tmp_path), head=10).collect()}
    flat = {r.path: (r.size, r.mtime) for r in listing(spark, [str(tmp_path), str(tmp_path / "deep"), str(tmp_path / "deep" / "er")]).collect()}
    assert {p: v[:2] for p, v in got.items()} == flat and len(got) == 9
    heads = {p.rsplit("/", 1)[1]: h for p, (_, _, h) in got.items()}
    assert heads["b"] == b"deep/bdeep" and heads["empty"] == b""
    assert [r.size for r in list_tree(spark, [str(tmp_path / "a"), str(tmp_path / "a")]).collect()] == [300]
    with pytest.raises(Exception, match="no%20such%20folder"):
        list_tree(spark, str(tmp_path / "no such folder"))


def test_moved_files_are_known_by_how_they_begin(spark):
    long = "".join(f"first line of log {k}\n" for k in range(200))

    def snapshot(files):
        rows = [(p, len(t), bytearray(t[:1024].encode()), "x") for p, t in files.items()]
        return spark.createDataFrame(rows, "path string, size long, head binary, k string").withColumn("mtime", F.lit(None).cast("timestamp"))

    one = {"app": long, "app.1": "yesterday " * 20, "short": "tiny", "kept": "k" * 90, "twin.1": "t" * 70, "twin.2": "t" * 70,
           "gone": "g" * 80, "reborn": "r" * 80, "empty": "", "cut": "c" * 50, "small": "s" * 10}
    two = {"app": "a new day " * 2, "app.1": long + "last line\n", "app.2": "yesterday " * 20, "moved": "tiny", "kept": "k" * 90,
           "copy": "k" * 90, "twin": "t" * 70, "empty": "", "cut": "c" * 20, "grown small": "s" * 30}
    got = {r.path: (r.change, r.moved_from, r.moved_to) for r in file_moves(snapshot(one), snapshot(two)).collect()}
    assert got == {
        "app": ("TRUNCATED", None, "app.1"), "app.1": ("REPLACED", "app", "app.2"), "app.2": ("RENAMED", "app.1", None),
        "short": ("DELETED", None, "moved"), "moved": ("RENAMED", "short", None), "kept": ("UNCHANGED", None, None),
        "copy": ("CREATED", None, None), "twin.1": ("DELETED", None, None), "twin.2": ("DELETED", None, None),
        "twin": ("CREATED", None, None), "gone": ("DELETED", None, None), "reborn": ("DELETED", None, None),
        "empty": ("UNCHANGED", None, None), "cut": ("TRUNCATED", None, None), "small": ("DELETED", None, None),
        "grown small": ("CREATED", None, None)}
    known = remember(snapshot(one), snapshot(two))
    three = {**two, "reborn": "another " * 20}
    got = {r.path: r.change for r in file_moves(known, snapshot(three)).collect()}
    assert got.pop("reborn") == "REAPPEARED" and set(got) == set(two) and set(got.values()) == {"UNCHANGED"}
    none = snapshot(two).limit(0)
    assert {r.change for r in file_moves(none, snapshot(two)).collect()} == {"CREATED"} and not file_moves(none, none).count()


def test_totals_in_place_equal_totals_by_shuffle(spark):
    rows = [(f, k, "x" * (k * 7 % 11)) for f in ("a", "b", None) for k in range(500) if k % 3]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")
    want = {}
    for f in ("a", "b", None):
        total = 0
        for n, (_, k, line) in enumerate(r for r in rows if r[0] == f):
            want[f, k] = (n, total)
            total += len(line) + 1
    width = F.length("line") + 1
    layouts = {
        "stretches": lines.repartitionByRange(6, "file", "line_no"), "one task": lines.coalesce(1),
        "packed": lines.repartition(3, F.expr("line_no div 100")), "in turn": lines.repartition(4, "line"),
    }
    for name, layout in layouts.items():
        both = total_in_place(total_in_place(layout, "idx", chunk=50), "at", width, chunk=30)
        got = {(r["file"], r["line_no"]): (r["idx"], r["at"]) for r in both.collect()}
        assert got == want, name
    assert total_in_place(lines.limit(0), "idx").count() == 0


def test_text_is_not_shuffled_for_indexes_and_positions(spark, tmp_path):
    lines = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.lit("text").alias("line"))
    lines.write.parquet(f"{tmp_path}/lines")
    stored = spark.read.parquet(f"{tmp_path}/lines")
    for df in (total_in_place(stored, "idx"), line_positions(stored)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert df.agg(F.count("*")).first()[0] == 20_000


def ranged(spark, path, rows, width=10):
    for part in rows:
        append_ranged_table(spark.createDataFrame(part, "file string, line_no long, line string").repartition(3), path, width)
    return read_ranged_table(spark, path)


def test_ranged_search_reads_only_grown_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    text = lambda f, k: f"{f} line {k}" + (" hit" if k % 3 == 0 else "")
    old = [("a", k, text("a", k)) for k in range(57)] + [("b", k, text("b", k)) for k in range(64)]
    new = [("a", k, text("a", k)) for k in range(57, 75)] + [("b", k, text("b", k)) for k in range(64, 66)]
    lines = ranged(spark, path, [old, new])
    previous = spark.createDataFrame([r for r in old if "hit" in r[2]], "file string, line_no long, line string")
    done = spark.createDataFrame([("a", 57), ("b", 64)], "file string, processed long")
    # What lies in ranges searched before cannot even be read.
    for file in (tmp_path / "t" / "lines").glob("line_range=[0-4]/*/*.parquet"):
        file.write_bytes(b"not a table")
    for checksum in (tmp_path / "t" / "lines").glob("line_range=[0-4]/*/.*.crc"):
        checksum.unlink()
    got = search_update(previous, lines, done, "hit", ranges=read_ranges(spark, path))
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for r in old + new if "hit" in r[2])
    same = search_update(previous, lines, 64, "hit").filter("file = 'b'")
    assert sorted(r["line_no"] for r in same.collect()) == [k for k in range(66) if k % 3 == 0]
    assert [r["line_no"] for r in page(lines, 68, 5).orderBy("line_no").collect()] == [68, 69, 70, 71, 72]
    assert range_max_length(lines, 74, 60).count() == 2


def test_ranged_table_grows_and_keeps_its_width(spark, tmp_path):
    path = str(tmp_path / "t")
    lines = ranged(spark, path, [[("a", k, "x") for k in range(25)], [("a", k, "x") for k in range(25, 40)], [("b", 0, "y")]])
    append_ranged_table(lines.limit(0).drop("line_range"), path, width=999)
    assert lines.count() == 41 and lines.schema["line_range"].metadata == {"width": 10}
    got = sorted(tuple(r) for r in read_ranges(spark, path).collect())
    assert got == [("a", 0, 0, 9, 10), ("a", 1, 10, 19, 10), ("a", 2, 20, 29, 10), ("a", 3, 30, 39, 10), ("b", 0, 0, 0, 1)]
    files = search_update(lines.limit(0).drop("line_range"), lines, spark.createDataFrame([], "file string, processed long"), "x|y",
                          ranges=read_ranges(spark, path))
    assert files.count() == 41  # files that were never searched, from their start
    lines.filter("file = 'b'").drop("line_range").withColumn("line_range", F.lit(0)).withColumn("batch", F.lit(9)).write.mode(
        "append").partitionBy("line_range", "batch").parquet(f"{path}/lines")
    with pytest.raises(ValueError, match="cut off"):
        append_ranged_table(lines.drop("line_range"), path)
    with pytest.raises(ValueError, match="no ranged table"):
        read_ranged_table(spark, str(tmp_path / "nothing"))


LOG_NAMES = ["a.log", "file:/logs/b c.log", "100%", "x%2Fy", "_hidden", ".dot", "日志", "", "n" * 300, "m" * 299 + "n"]


def test_logs_are_written_a_file_each_and_in_order(spark, tmp_path):
    rows = [(name, k, f"{name[:9]} {k}") for name in LOG_NAMES for k in range(25)]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string").orderBy(F.rand(1)).repartition(4)
    out = tmp_path / "out"
    write_logs(lines, str(out), part_lines=10)
    texts = {p.name: p.read_text() for p in out.glob("*.txt")}
    assert len(texts) == 3 * len(LOG_NAMES) and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    for name in LOG_NAMES:
        whole = "".join(texts[export_name(name, part)] for part in range(3))
        assert whole == "".join(f"{name[:9]} {k}\n" for k in range(25))
    back = {(r["file"], r["part"], r["line"]) for r in read_logs(spark, str(out)).collect()}
    short = [n for n in LOG_NAMES if len(n) < 50]
    assert {b for b in back if b[0] in short} == {(n, k // 10, f"{n[:9]} {k}") for n in short for k in range(25)}
    with pytest.raises(ValueError, match="exists"):
        write_logs(lines, str(out), part_lines=10)
    write_logs(lines.limit(0), str(tmp_path / "none"), part_lines=10)
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"]


def test_a_failed_export_leaves_nothing_and_a_repeated_task_no_second_file(spark, tmp_path):
    lines = spark.range(2000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(
        F.col("id") == 1999, F.raise_error(F.lit("lost"))).otherwise("text").alias("line"))
    with pytest.raises(Exception, match="lost"):
        write_logs(lines, str(tmp_path / "out"), part_lines=10)
    assert list(tmp_path.iterdir()) == []
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * 5 + ["g"], "part": [0] * 6, "line": [str(k) for k in range(6)]})

    def broken():
        yield batch.slice(0, 3)
        raise RuntimeError("executor lost")

    writer = TextWriter(str(tmp_path / "t"), str(tmp_path / "t.partial"))
    with pytest.raises(RuntimeError):
        writer.write(broken())
    messages = [writer.write(iter([batch.slice(0, 2), batch.slice(2)])) for _ in range(2)]  # a task that ran twice
    assert messages[0] == messages[1] == Written(2, 6)
    writer.commit(messages)
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir()} == {
        "_SUCCESS": "", export_name("f", 0): "0\n1\n2\n3\n4\n", export_name("g", 0): "5\n"}
    other = TextWriter(str(tmp_path / "u"), str(tmp_path / "u.partial"))
    other.abort([other.write(iter([batch])), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_guesses_reach_lines_by_split_and_only_wide_files_are_read_again(spark, tmp_path):
    names = ["plain [1].log", "wi?de {2}*.log", "big%20 \\3.log", "latin.log"]
    texts = {"plain [1].log": "é plain\nline".encode(), "wi?de {2}*.log": "﻿wide ö\nline\n".encode("utf-16-le"),
             "big%20 \\3.log": "﻿big ü\nline".encode("utf-16-be"), "latin.log": "caf\xe9\n".encode("latin-1")}
    for name in names:
        (tmp_path / name).write_bytes(texts[name])
    lines = scan_lines(spark, str(tmp_path), positions=True)
    got = sorted((r["line_no"], r["line"], r["terminated"]) for r in lines.collect())
    assert got == sorted([(0, "é plain", True), (1, "line", False), (0, "wide ö", True), (1, "line", True),
                          (0, "big ü", True), (1, "line", False), (0, "café", True)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scan_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not re.search(r"hashpartitioning\(file#\d+, \d+\)", plan.replace("coalesce", ""))
    info = {r["file"].rsplit("/", 1)[-1]: (r["n_lines"], r["reader_encoding"]) for r in file_info(spark, str(tmp_path)).collect()}
    assert sorted(info.values()) == [(1, "ISO-8859-1"), (2, "UTF-16BE"), (2, "UTF-16LE"), (2, "UTF-8")]
