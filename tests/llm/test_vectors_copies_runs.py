"""Whitening, exact copies and periodic runs against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewell.llm import exact_dedup, periodic_runs, queries, whitening

BLANK = re.compile(r"[\x20\x09-\x0d]")
WORD = re.compile(r"[^\x20\x09-\x0d]+")

# -- whitening -----------------------------------------------------------------------


def vectors_of(spark, rows):
    """(vec_id, x) with extra columns of names that the operator uses inside."""
    schema = "vec_id long, x array<long>, id int, n long, component string, whitened string, i int, v int"
    return spark.createDataFrame([(k, x, 1, 2, "c", "w", 3, 4) for k, x in rows], schema).repartition(5)


def numpy_whitening(rows, k):
    x = np.array([v for _, v in rows], dtype=np.longdouble)
    centred = x - x.sum(axis=0) / len(x)
    cov = (centred.T @ centred / len(x)).astype(float)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order], np.trace(cov), centred.astype(float)


def collected(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["id"]][r["component"]] = r
    return out


@pytest.mark.parametrize("scale", [1, 10_000])
def test_whitening_equals_an_eigendecomposition(spark, monkeypatch, scale):
    monkeypatch.setattr(whitening, "ROWS", 64)
    rng = np.random.default_rng(scale)
    mixed = rng.normal(size=(700, 12)) * np.geomspace(1, 300, 12) @ rng.normal(size=(12, 12))
    rows = [(k, [int(c) + 100_000 for c in np.floor(scale * v)]) for k, v in enumerate(mixed)]
    rows += [rows[0]] * 3 + [(None, rows[1][1])]
    left_out = [(901, None), (902, [*rows[0][1][:-1], None])]
    got = collected(whitening.whiten(vectors_of(spark, rows + left_out), components=8))
    values, vectors, total, centred = numpy_whitening(rows, 8)
    assert set(got) == {k for k, _ in rows}
    n, sums = len(rows), [sum(c) for c in zip(*[v for _, v in rows], strict=True)]
    sign = {}
    for (key, x), c in zip(rows, centred, strict=True):
        assert got[key][1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for j in range(8):
            row, want = got[key][j + 1], c @ vectors[:, j] / np.sqrt(values[j])
            sign.setdefault(j, np.sign(row["whitened"]) * np.sign(want))
            assert row["whitened"] == pytest.approx(sign[j] * want, rel=1e-7, abs=1e-7)
            assert row["explained"] == pytest.approx(values[j] / total, rel=1e-9)
            assert row["n"] == n and row["identity_error"] < 1e-10


def test_whitening_of_small_variances_beside_large_ones(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(-10**9, 10**9, 400), rng.integers(-3, 4, 400), rng.integers(-2 * 10**4, 2 * 10**4, 400)])
    got = collected(whitening.whiten(vectors_of(spark, [(k, v.tolist()) for k, v in enumerate(x)]), components=8))
    white = np.array([[got[k][j]["whitened"] for j in (1, 2, 3)] for k in range(400)])
    assert np.abs(white.T @ white / 400 - np.eye(3)).max() < 1e-9
    assert got[0][1]["identity_error"] < 1e-9


def test_dependent_dimensions_have_no_whitened_entry(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-500, 500, (300, 3))
    x = np.column_stack([a, a[:, 0] + a[:, 1], 2 * a[:, 2], np.full(300, 7)])
    got = collected(whitening.whiten(vectors_of(spark, [(k, v.tolist()) for k, v in enumerate(x)]), components=8))
    values, vectors, total, centred = numpy_whitening(list(enumerate(x.tolist())), 3)
    for k in range(300):
        assert sorted(got[k]) == [1, 2, 3, 4, 5, 6]
        assert all(got[k][j]["whitened"] is None and got[k][j]["explained"] == 0 for j in (4, 5, 6))
        for j in range(3):
            assert abs(got[k][j + 1]["whitened"]) == pytest.approx(abs(centred[k] @ vectors[:, j]) / np.sqrt(values[j]), rel=1e-8, abs=1e-8)
            assert got[k][j + 1]["explained"] == pytest.approx(values[j] / total)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors_of(spark, [(1, [5, 6])] * 3)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in one)
    uneven = collected(whitening.whiten(vectors_of(spark, [(1, [3]), (2, [1, 4]), (3, [2, 2])])))
    assert uneven[1][1]["deviation"] == (3 * 3 - 6) ** 2 + (0 - 6) ** 2
    huge = collected(whitening.whiten(vectors_of(spark, [(1, [2**62]), (2, [-(2**62)]), (3, [0])])))
    assert huge[1][1]["deviation"] is None  # beyond 38 digits
    far = collected(whitening.whiten(vectors_of(spark, [(1, [2**60]), (2, [0]), (3, [0])])))
    assert int(far[1][1]["deviation"]) == (2 * 2**60) ** 2


def test_query_scales_entries(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.25]), (2, [0.5, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [1e30, 0.0]), (7, [-0.0001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, e array<float>").select("vec_id", queries._scaled(queries.F.col("e")).alias("x"))
    got = {r["vec_id"]: r["x"] for r in df.collect() if r["x"] is not None and None not in r["x"]}
    assert got == {1: [100512, 99744], 7: [99999, 100000]}


# -- exact copies --------------------------------------------------------------------


def docs_of(spark, rows):
    schema = "doc_id long, text string, id int, row int, entry string, body int, best int, cell int, size int"
    return spark.createDataFrame([(*r, 1, 2, "e", 3, 4, 5, 6) for r in rows], schema).repartition(4)


def copies_by_brute_force(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=str)


def texts_with_copies(rng):
    alphabet = ["a", "b", " ", "\n", "\t", "\x0b", "é", "日", " ", "\x1f"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(9)))) for k in range(700)]
    base = "a long text that many others begin like " * 20
    rows += [(1000 + k, base + "x" * rng.randrange(30)) for k in range(150)]
    rows += [(2000 + k, " " * rng.randrange(3) + "one copy of a third of all rows") for k in range(500)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (None, "one copy of a third of all rows"), (None, "alone"), (3003, "w " * 60_000)]
    return rows + [rows[5], rows[5], rows[900], rows[900]]


@pytest.mark.parametrize("scan_bytes, trie_bytes", [(exact_dedup.SCAN_BYTES, exact_dedup.TRIE_BYTES), (9000, 100_000)])
def test_owners_equal_brute_force(spark, scan_bytes, trie_bytes):
    rows = texts_with_copies(random.Random(3))
    got = exact_dedup.owners(docs_of(spark, rows), scan_bytes=scan_bytes, trie_bytes=trie_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == copies_by_brute_force(rows)


def test_copies_of_an_empty_table_and_of_named_ids(spark):
    assert exact_dedup.owners(docs_of(spark, [])).count() == 0
    rows = [("b", "x y"), ("a", "xy "), ("c", "x"), (None, "x")]
    got = exact_dedup.owners(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["id"] or "-", r["keep_id"], r["group_size"], r["kept"]) for r in got) == [
        ("-", "c", 2, False), ("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 2, True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.text("ab", max_size=40).map(str.encode), max_size=60), st.integers(0, 60))
def test_trie_holds_each_text_once(texts, cut):
    trie, spilled = exact_dedup.Trie(), {}
    for k, text in enumerate(texts):
        node = trie.find(text)
        if node.cell is not None:
            spilled[text] = spilled.get(text, 0) + 1
            continue
        if node.item is None:
            node.item = [0, []]
        node.item[0] += 1
        if k == cut and (found := trie.spill()):
            path, below, top = found
            top.cell = 1
            assert all(t.startswith(path) for t, _ in below)
            spilled |= {t: item[0] for t, item in below}
    held = {t: item[0] for t, item in trie.texts()}
    assert not set(held) & set(spilled)
    assert held | spilled == {t: texts.count(t) for t in texts}


def test_trie_weighs_what_it_holds():
    rng, trie = random.Random(1), exact_dedup.Trie()
    for _ in range(400):
        node = trie.find(bytes(rng.choice(b"abc") for _ in range(rng.randrange(30))))
        node.item = node.item or [0, []]
    assert trie.bytes == trie._weight(trie.root)
    while (cut := trie.spill()):
        cut[2].cell = 1
        assert trie.bytes == trie._weight(trie.root)
    assert 1 <= sum(1 for _ in trie.texts()) < 20  # texts that begin one another


# -- periodic runs -------------------------------------------------------------------


def runs_by_brute_force(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(6, 4 * q) and not any(
                    words[start:i - r] == words[start + r:i] for r in range(1, q)):
                out.append((start, i - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(texts):
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    text, *rest = periodic_runs.runs(np.array([w for t in texts for w in t], dtype=np.int64), begin)
    out = [[] for _ in texts]
    for t, *run in zip(text.tolist(), *(x.tolist() for x in rest), strict=True):
        out[t].append(tuple(run))
    return out


def repetitive(rng):
    letters = rng.choice([1, 2, 3, 6])
    words = [rng.randrange(letters) for _ in range(rng.randrange(rng.choice([8, 60, 160])))]
    while words and rng.random() < 0.6:
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, max(2, len(words) // 5)))]
        at, n = rng.randrange(len(words)), rng.randrange(1, len(words) + 1)
        words[at:at + n] = (unit * n)[:n][:len(words) - at]
    return words


@pytest.mark.parametrize("step", [1, 3, 50, periodic_runs.STEP])
def test_runs_equal_brute_force(monkeypatch, step):
    monkeypatch.setattr(periodic_runs, "STEP", step)
    rng = random.Random(step)
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 6))]
        assert found_runs(texts) == [runs_by_brute_force(t) for t in texts]


def test_runs_of_famous_words():
    fibonacci, thue = [[0], [0, 1]], [0]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for _ in range(9):
        thue += [1 - x for x in thue]
    cubes = [0, 1] * 60 + [1, 1, 0] * 50 + [0] * 50
    for words in (fibonacci[-1], thue, cubes, [7] * 300, (thue[:32] * 6) + [5] + thue[:32] * 6):
        assert found_runs([words]) == [runs_by_brute_force(words)]


def test_long_runs_take_time_in_proportion():
    texts = [[1] * 200_000, [1, 2, 3] * 60_000, list(range(30_000)) * 5, list(range(100)) * 2000]
    assert found_runs(texts) == [[(0, 200_000, 1)], [(0, 180_000, 3)], [(0, 150_000, 30_000)], [(0, 200_000, 100)]]


def collapsed_by_brute_force(words):
    runs = [] if len(set(words)) == len(words) else runs_by_brute_force(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts(rng):
    rows = [(k, " ".join(f"w{x}" for x in repetitive(rng))) for k in range(300)]
    rows += [(1000 + k, "spam\tspam\x0b\n " * 20 + "é x \x85 y " * 5) for k in range(100)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (None, "a b " * 9), (2003, "one"), (2004, "a " * 400), (2005, " ".join(f"v{k}" for k in range(40_000)))]
    return rows + rows[:3]


def test_collapse_equals_brute_force(spark):
    rows = run_texts(random.Random(8))
    docs = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "doc_id long, text string, id int, runs int, collapsed string")
    got = periodic_runs.collapse(docs.repartition(3)).collect()
    want = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        runs, kept = collapsed_by_brute_force(words)
        want.append((doc, len(words), runs, kept))
    assert sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(want, key=str)


def test_run_query_digests(spark, tmp_path):
    rng = random.Random(9)
    rows = run_texts(rng)[:200] + [(5000 + k, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(80)))) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, original = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                words[i] = original[a + (i - a) % p]
        runs, kept = collapsed_by_brute_force(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 50


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0
