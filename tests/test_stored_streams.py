"""Open lines that give way to longer ones, and searches that are watched while they run."""

import random

import pytest
from pyspark.sql import functions as F

from linewell import streaming as st
from linewell.operators import match_count, search
from linewell.sources import synth_lines, write_lines_table
from linewell.streaming.source import SCHEMA


def growing_batches(rng, files, n):
    """Batches as a followed set of files gives them: lines, the open ends, now and then a truncation or a loss."""
    state = {f"log{k}": [0, 0, ""] for k in range(files)}  # epoch, begin of the open line, its text
    for _ in range(n):
        rows = []
        for name in rng.sample(sorted(state), rng.randrange(1, files)):
            epoch, start, text = state[name]
            if rng.random() < 0.15:
                epoch, start, text = epoch + 1, 0, ""
            for _ in range(rng.randrange(4)):
                text += rng.choice(["", "a", "bc"])
                rows.append((name, epoch, start, start + len(text) + 1, True, text))
                start, text = start + len(text) + 1, ""
            if rng.random() < 0.7:
                text += rng.choice("xyz")
                rows.append((name, epoch, start, start + len(text), False, text))
            elif text:
                rows.append((name, epoch, start, start + len(text) + 1, True, text))
                start, text = start + len(text) + 1, ""
            if rng.random() < 0.1:
                rows.append((name, epoch, start, start + 9, None, None))
            state[name] = [epoch, start, text]
        yield rows


@pytest.mark.parametrize("buckets", [1, 4])
def test_upserted_lines_are_the_latest(spark, tmp_path, buckets):
    out, received = str(tmp_path / "out"), []
    assert st.upserted(spark, out).count() == 0
    for number, rows in enumerate(growing_batches(random.Random(buckets), 6, 9)):
        received += rows
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(1 + number % 3 // 2):  # every third batch is tried twice
            st.upsert_batch(batch, number, out, buckets)
        want = st.latest_lines(spark.createDataFrame(received, SCHEMA)).collect()
        assert sorted(st.upserted(spark, out).collect()) == sorted(want)
    lost = [r[:4] for r in received if r[5] is None]
    assert sorted(tuple(r) for r in st.upserted_losses(spark, out).collect()) == sorted(lost)
    versions = list((tmp_path / "out" / "open").glob("bucket=*/batch=*"))
    assert len(versions) <= 2 * buckets  # whatever the number of batches


def test_a_batch_reads_open_lines_only(spark, tmp_path):
    out = tmp_path / "out"
    rows = lambda n: [(f"f{k}", 0, 10 * n, 10 * n + 10, True, "x" * 9) for k in range(5)] + [
        (f"f{k}", 0, 10 * n + 10, 10 * n + 11, False, "y") for k in range(5)]
    for n in range(4):
        st.upsert_batch(spark.createDataFrame(rows(n), SCHEMA), n, str(out), 2)
    sizes = sum(p.stat().st_size for p in (out / "open").rglob("batch=3/*.parquet"))
    assert sizes == sum(p.stat().st_size for p in (out / "open").rglob("batch=2/*.parquet"))
    for file in (out / "lines").rglob("*.parquet"):
        file.write_bytes(b"history that no batch reads")
    st.upsert_batch(spark.createDataFrame(rows(4), SCHEMA), 4, str(out), 2)
    st.upsert_batch(spark.createDataFrame([], SCHEMA), 5, str(out), 2)
    assert not (out / "lines" / "batch=5").exists()


def test_search_progress_grows_to_the_counts(spark, tmp_path):
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    write_lines_table(synth_lines(spark, 5000, "row %d", partitions=7), table)
    query = st.search_with_progress(spark, table, "77?1", out, files_per_step=2)
    query.awaitTermination()
    steps = st.progress_of(spark, out).orderBy("step").collect()
    assert len(steps) == 4 and [s["percent"] for s in steps] == sorted(s["percent"] for s in steps)
    lines = spark.read.parquet(table)
    counts = match_count(lines, "77?1").first()
    assert (steps[-1]["n_lines"], steps[-1]["n_matches"], steps[-1]["percent"]) == (5000, counts["n_matches"], 100)
    found = spark.read.parquet(f"{out}/matches").select("line_no")
    assert found.exceptAll(search(lines, "77?1").select("line_no")).isEmpty() and found.count() == counts["n_matches"]
    # Lines added later are searched by a new run over the same folder.
    synth_lines(spark, 100, "row 771 %d").withColumn("line_no", F.col("line_no") + 5000).write.mode("append").parquet(table)
    st.search_with_progress(spark, table, "77?1", out).awaitTermination()
    last = st.progress_of(spark, out).orderBy(F.desc("step")).first()
    assert (last["n_lines"], last["n_matches"]) == (5100, counts["n_matches"] + 100)


def test_search_with_progress_checks_its_pattern(spark, tmp_path):
    write_lines_table(synth_lines(spark, 10, "row %d"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="PATTERN"):
        st.search_with_progress(spark, str(tmp_path / "t"), "(", str(tmp_path / "out"))
