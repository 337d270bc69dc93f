"""Jobs whose tasks must not take a fixed share of an input that grows."""

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linewell.operators import filtered_search
from linewell.plans import workload
from linewell.plans.inspect import physical_plan
from linewell.sources import moves, text_sink
from linewell.sources.text_sink import read_logs, write_logs

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture
def parted(spark, tmp_path):
    """The documents in twelve files, each read by a task of its own."""
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(12, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_are_asked_only_at_lengths_of_files_that_begin_alike(spark):
    heads = [(f"{k} ".encode() * 300)[:64 + k] for k in range(300)]
    earlier = spark.createDataFrame([(f"o{k}", len(h), bytearray(h)) for k, h in enumerate(heads)], "moved_from string, n int, _h binary")
    later = spark.createDataFrame(
        [(f"n{k}", 5000, bytearray((f"{k} ".encode() * 300)[:1024])) for k in range(300)], "moved_to string, size int, _g binary")
    asked = [(r["moved_to"], r["n"]) for r in moves._asked(earlier, later, 64).collect()]
    assert sorted(asked) == sorted((f"n{k}", 64 + k) for k in range(300))


def test_files_that_begin_alike_are_asked_at_every_length(spark):
    head = bytes(k % 251 for k in range(1024))
    earlier = spark.createDataFrame([(f"o{n}", n, bytearray(head[:n])) for n in range(64, 1025)], "moved_from string, n int, _h binary")
    later = spark.createDataFrame([("new", 5000, bytearray(head)), ("short", 700, bytearray(head[:700]))], "moved_to string, size int, _g binary")
    asked = sorted((r["moved_to"], r["n"]) for r in moves._asked(earlier, later, 64).collect())
    assert asked == [("new", n) for n in range(64, 1025)] + [("short", n) for n in range(64, 701)]
    # Another byte behind the first 200: of the lengths above, those below the next step are asked.
    other = spark.createDataFrame([("other", 5000, bytearray(head[:200] + b"\xff" + head[201:]))], later.schema)
    assert sorted(r["n"] for r in moves._asked(earlier, other, 64).collect()) == list(range(64, 256))


def test_files_of_the_watched_table_grow_in_number(spark, parted, monkeypatch):
    written, write = [], workload.src.write_lines_table
    monkeypatch.setattr(workload.src, "write_lines_table", lambda lines, path: (written.append(path), write(lines, path)))
    tasks = workload.table(spark, parted, "documents").rdd.getNumPartitions()
    assert tasks > 5
    out = workload._watched(spark, parted)
    files = spark.read.parquet(written[0]).select(F.input_file_name()).distinct().count()
    assert files > tasks
    assert 1 < spark.read.parquet(f"{out}/progress").count() <= 6


def test_written_files_grow_in_number(spark, parted, monkeypatch):
    seen, info = [], workload.src.file_info
    monkeypatch.setattr(workload.src, "file_info", lambda s, paths: (seen.append(info(s, paths)), seen[0])[1])
    assert workload.JOBS["file_info"](spark, parted).count() == 5
    assert seen[0].count() == 12 * 5


def test_text_that_is_not_asked_for_stays_with_the_scan(spark):
    lines = spark.createDataFrame([("f", k, f"line {k}") for k in range(20)], "file string, line_no bigint, line string")
    marks = lines.filter("line_no % 5 = 0").select("file", "line_no")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical_plan(filtered_search(lines, "line 1", marks).select("file", "line_no"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
    joins = [row for row in plan.splitlines() if "Project" in row and "_hit" in row]
    assert joins and not any(part.strip().startswith("line#") for row in joins for part in row.split("[")[1].split(","))


def test_many_small_logs_are_read_by_few_tasks(spark, tmp_path):
    lines = spark.range(3000).selectExpr("cast(id div 3 as string) as file", "id % 3 as line_no", "concat('é line ', id) as line")
    write_logs(lines, str(tmp_path / "out"), part_lines=2)
    logs = read_logs(spark, str(tmp_path / "out"))
    assert logs.rdd.getNumPartitions() <= 16  # 2,000 files
    order = Window.partitionBy("file").orderBy("part", F.monotonically_increasing_id())
    got = {(r["file"], r["pos"], r["line"]) for r in logs.select("file", F.row_number().over(order).alias("pos"), "line").collect()}
    assert got == {(str(k // 3), k % 3 + 1, f"é line {k}") for k in range(3000)}


def test_logs_larger_than_a_read_keep_their_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_sink, "READ_BYTES", 7)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.0000000000.txt").write_bytes(b"one long line\n\nx\r\nopen end")
    (folder / "b.0000000001.txt").write_bytes(b"")
    batch = pa.RecordBatch.from_pydict({"path": [f.as_uri() for f in sorted(folder.iterdir())]})
    got = [r["line"] for b in text_sink._read(iter([batch])) for r in b.to_pylist()]
    assert got == [b"one long line", b"", b"x\r", b"open end"]
