"""Mixing, sharding, scoring, search, pages and notices against brute force on small tables."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from linewell.llm import html_extract, licenses, mixing, sharding, topk, toxicity


def docs_of(spark, rows):
    """(doc_id, text, source) with extra columns of clashing names."""
    schema = ("doc_id long, text string, source string, size long, copies long, shard int, slot int, "
              "key string, target double, _row int, score double, _words int")
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "k", 0.5, 6, 0.1, 9) for r in rows], schema).repartition(3)


# -- mixing --------------------------------------------------------------------------


def expected_targets(sizes):
    """Words by source, dealt and dealt again until no target is above twice its source."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(k, " ".join("w" * (1 + k % 3) for _ in range(int(rng.lognormvariate(4, 1)))), f"s{k % 7}") for k in range(900)]
    rows += [(1000 + k, "same size " * 20, "s1") for k in range(400)]  # ties
    rows += [(2000 + k, "tiny", None) for k in range(30)] + [(3000, None, "s2"), (3001, "", "empty"), (None, "a b", "s3")]
    rows += [rows[0]] * 3
    docs = docs_of(spark, rows)
    got = mixing.allocate(docs).collect()
    assert sum(r["rows"] for r in got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = expected_targets(dict(sizes))
    taken, largest, goal = Counter(), Counter(), {}
    for r in got:
        source = None if r["key"] == "null" else r["key"][1:]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[source] += r["taken"] * r["rows"]
        largest[source] = max(largest[source], r["size"] * r["rows"])
        goal[source] = r["target"]
    for source, target in want.items():
        assert goal[source] == pytest.approx(target)
        assert abs(taken[source] - target) <= max(1, largest[source])
    again = mixing.allocate(docs.repartition(5)).collect()
    assert sorted((str(r["id"]), r["key"], r["copies"]) for r in again) == sorted((str(r["id"]), r["key"], r["copies"]) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] * r["rows"] for r in got)


def test_rates_tilt_exponentially(spark):
    histogram = spark.createDataFrame([("=a", s, 10) for s in (1, 5, 20, 100)], "key string, size long, n long")
    total = 10 * 126
    goals = spark.createDataFrame([("=a", total, 0.4 * total), ("=b", 0, 0.0)], "key string, source_size long, target double")
    row = {r["key"]: r for r in mixing.tilts(histogram, goals).collect()}
    rates = [min(2, math.exp(row["=a"]["_tilt"] * s / row["=a"]["_scale"])) for s in (1, 5, 20, 100)]
    assert sum(10 * s * r for s, r in zip((1, 5, 20, 100), rates, strict=True)) == pytest.approx(0.4 * total)
    assert row["=b"]["_tilt"] is None


def test_tilts_that_do_not_converge_are_an_error(spark, monkeypatch):
    histogram = spark.createDataFrame([("=a", s, 10) for s in (1, 5, 20, 100)], "key string, size long, n long")
    goals = spark.createDataFrame([("=a", 1260, 504.0)], "key string, source_size long, target double")
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(ArithmeticError, match="=a"):
        mixing.tilts(histogram, goals)


def test_rows_of_one_id_are_rounded_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 64)  # rows of one id in several runs
    rng = random.Random(5)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(1, 60))), f"s{k % 2}") for k in range(400)]
    rows += [(7000, "one id " * 10, "s0")] * 150 + [(None, f"no id {k} " * 8, "s1") for k in range(150)]
    docs = docs_of(spark, rows)
    got = mixing.allocate(docs).collect()
    assert sum(r["rows"] for r in got) == len(rows)
    taken, goal = Counter(), {}
    for r in got:
        taken[r["key"]] += r["taken"] * r["rows"]
        goal[r["key"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)
    copies = Counter()
    for r in got:
        copies[r["id"], r["key"], r["size"]] += r["copies"] * r["rows"]
    mixed = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], f"={r['source']}", len(r["text"].split())) for r in mixed) == +copies
    by_text = Counter(r["text"] for r in mixed if r["doc_id"] is None)
    assert all(n <= 2 for n in by_text.values()) and len(set(by_text.values())) > 1


def test_mixing_of_an_empty_table(spark):
    assert mixing.allocate(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")])).count() == 2


# -- sharding ------------------------------------------------------------------------


def int_hash(seed_parts, last):
    """Spark's xxhash64 of the parts and a last int: texts, longs, and ints as one-element tuples."""
    seed = 42
    for p in seed_parts:
        if isinstance(p, str):
            data = p.encode()
        elif isinstance(p, tuple):
            data = p[0].to_bytes(4, "little", signed=True)
        else:
            data = p.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return xxhash.xxh64(last.to_bytes(4, "little", signed=True), seed=seed).intdigest()


def expected_shard(doc_id, weights):
    key = 42 if doc_id is None else xxhash.xxh64(doc_id.to_bytes(8, "little", signed=True), seed=42).intdigest()
    key = key - (1 << 64) if key >= 1 << 63 else key  # the hash of a null is its seed

    def draw(children, *path):
        best = None
        for i, w in enumerate(children):
            u = ((int_hash((key, *path), i) >> 11) + 0.5) / 2.0**53
            d = -math.log(u) / w if w > 0 else math.inf
            best = min(best, (d, i)) if best else (d, i)
        return best[1]

    r = draw([sum(map(sum, x)) for x in weights], "region")
    q = draw([sum(x) for x in weights[r]], "rack", (r,))
    s = draw(weights[r][q], "shard", (r,), (q,))
    return sum(len(x) for y in weights[:r] for x in y) + sum(len(x) for x in weights[r][:q]) + s


def test_sharding_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 8)  # many runs a shard
    rows = [(k * 37, "é" * (k % 5), "s") for k in range(600)] + [(5, None, "s"), (None, "x", None), (6, "", "s")]
    rows += [(7, "again", "s")] * 3
    got = sharding.assign(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] == expected_shard(r["doc_id"], sharding.tree(24))
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[37]["size"] == 8 + 2 and by_id[37]["text_crc32"] == zlib.crc32("é".encode())
    assert by_id[5]["size"] == 8 and by_id[5]["text_crc32"] is None and by_id[6]["text_crc32"] == 0
    assert 0 < sum(r["grown_shard"] == 24 for r in got) < len(rows) / 8
    assert sharding.assign(docs_of(spark, [])).count() == 0


def test_weight_changes_move_rows_only_into_the_subtree_that_grew(spark):
    before, after = sharding.tree(24), sharding.tree(24)
    after[1][0][2] = 5.0
    rows = spark.range(4000).select(
        sharding.shard_of(F.xxhash64("id"), before).alias("a"), sharding.shard_of(F.xxhash64("id"), after).alias("b"))
    moved = [(r["a"], r["b"]) for r in rows.filter("a <> b").collect()]
    assert moved and all(8 <= b < 16 for _, b in moved)  # region 1
    counts = Counter(r["a"] for r in rows.collect())
    assert len(counts) == 24 and max(counts.values()) < 250


def test_with_shards_keeps_columns(spark):
    docs = docs_of(spark, [(1, "a", "s"), (None, None, None)])
    assert sharding.with_shards(docs).columns == docs.columns


# -- toxicity ------------------------------------------------------------------------


def toxic_corpus(n=900):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        bad = k % 6 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "awful", "nasty"]))
        rows.append((k, " ".join(text), "s"))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_on_the_held_out_fold(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None, None), (5001, "", "s"), (None, "vile nasty awful", "s"), rows[0]]
    marks = spark.createDataFrame(labels + [(1, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs_of(spark, rows), marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["id"] for r in held} == {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum((r["score"] >= 0.5) == bool(truth[r["id"]]) for r in held if r["id"] in truth)
    assert right >= 0.97 * sum(r["id"] in truth for r in held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert next(r["score"] for r in got if r["id"] is None) > 0.5 > next(r["score"] for r in got if r["id"] == 5000)
    docs = docs_of(spark, rows)
    clean = toxicity.without_toxic(docs, marks)
    assert clean.columns == docs.columns
    assert clean.count() == sum(r["score"] < 0.5 for r in got)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs_of(spark, [(1, "a", "s")]), none).collect()] == [0.0]
    assert toxicity.score(docs_of(spark, []), none).count() == 0


# -- exact top-k ---------------------------------------------------------------------


def expected_top(rows, is_query, top=5):
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, q, v in ok:
        if q is None or not is_query(q):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0)
                        for n, i, w in ok if n != own)[:top]
        out += [(q, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(scored)]
    return in_order(out)


def in_order(found):
    return sorted(found, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))


@pytest.mark.parametrize("blocks", [(16_384, 1_024), (40, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(200)]
    rows += [(300 + k, rows[5][1]) for k in range(20)]  # ties
    rows += [(400, None), (410, [1.0, None] * 4), (420, [float("nan")] * 8), (430, [float("inf")] * 8), (None, [1.0] * 8),
             (440, []), (450, [0.5, 0.5])]
    # Repeated ids and repeated rows: only the query's own row is no candidate.
    rows += [(0, rows[0][1]), (0, rows[7][1]), (10, rows[10][1]), (11, rows[10][1]), (None, rows[20][1]), (None, rows[20][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, id int, v string").repartition(3)
    got = topk.search(frame, F.col("vec_id") % 10 == 0)
    assert in_order(tuple(r) for r in got.collect()) == expected_top(rows, lambda i: i % 10 == 0)
    assert topk.search(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk.search(few, F.col("vec_id") == 0).count() == 2


def test_elimination_stops_early():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(90, 110, (50, 16)), rng.integers(-5, 5, (5000, 16))]).astype(np.int64)
    pivots = x[rng.integers(0, len(x), 16)].astype(float)
    table = np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(2))

    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, at):
            Counted.seen += len(at)
            return np.asarray(self)[at]

    found = topk._best(x[0], table[0], 0, x.view(Counted), table, (x.astype(float) ** 2).sum(1),
                       np.arange(len(x)), list(range(len(x))), 5)
    scores = x @ x[0]
    want = sorted((-int(s), i) for i, s in enumerate(scores) if i)[:5]
    assert found == [(-s, i) for s, i in want] and Counted.seen < 1000


# -- pages ---------------------------------------------------------------------------

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<div id="cookie-notice">We use cookies.</div><header><h2>Site name</h2></header>
<nav><ul><li><a href="/">Home</a><li><a href="/x">Other</a></ul></nav>
<main><article><header><h1>A &amp; B</h1></header><p>First   paragraph, with <b>bold</b>
and <a href="#">a link</a> in it, long enough to be read.<div class="ad">Buy now!</div>
<p>Short.<ul><li>An item of the list in the article.</ul><script>var x = "<p>no</p>";</script>
<blockquote>Quoted &lt;text&gt; of the article, as it was said.</blockquote></article>
<section class="comments"><p>Great article, thanks for writing all of this down!</p></section></main>
<aside><p>Related: another story that you may like to read now.</p></aside>
<form><label>Name</label><input></form><footer><p>&copy; Someone</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.extract(ARTICLE).split("\n") == [
        "A & B", "First paragraph, with bold and a link in it, long enough to be read.", "Short.",
        "An item of the list in the article.", "Quoted <text> of the article, as it was said."]


def test_main_text_without_semantic_tags():
    page = ('<div class="menu"><a href=1>Home</a> <a href=2>News</a></div><div class="content"><p>' + "Real words of a page. " * 10 +
            "</p><p>Ok.</p><p>" + "More words of the page. " * 10 + '</p></div><div id="footer">Impressum</div>')
    got = html_extract.extract(page)
    assert got.startswith("Real words") and "\nOk.\n" in got and "Home" not in got and "Impressum" not in got


def test_class_names_that_only_describe_the_page():
    page = ('<div class="page has-sidebar"><div class="entry-header"><h1>The title of it</h1></div><div class="post-body"><p>' +
            "Words of the post. " * 12 + '</p></div><div class="post-comments"><p>A reader says a word or two here.</p></div></div>')
    assert html_extract.extract(page).split("\n") == ["The title of it", ("Words of the post. " * 12).strip()]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "<a <b <c>", "&#0;", "<p a=\"x>y"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_extract.extract(page), str)


def test_page_that_breaks_off_is_read_to_its_end():
    cut = ARTICLE[:ARTICLE.index("<div class=\"ad\">")]
    assert html_extract.extract(cut).split("\n")[-1].endswith("long enough to be read.")


def test_very_deep_and_very_long_pages():
    assert html_extract.extract("<div>" * 20_000 + "x" + "</div>" * 20_000) in ("x", "")
    long = "<article>" + "<p>Some words that are content.</p>" * 20_000 + "</article>"
    assert html_extract.extract(long).count("\n") == 19_999


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.data())
def test_min_cut_equals_the_cheapest_labelling(terminal, data):
    pairs = list(itertools.combinations(range(len(terminal)), 2))
    edges = {p: data.draw(st.integers(1, 4)) for p in data.draw(st.lists(st.sampled_from(pairs), unique=True, max_size=8))} if pairs else {}

    def cost(sides):
        cut = sum(w for (a, b), w in edges.items() if sides[a] != sides[b])
        return cut + sum(t for t, s in zip(terminal, sides, strict=True) if t > 0 and not s) + sum(
            -t for t, s in zip(terminal, sides, strict=True) if t < 0 and s)

    got = html_extract.min_cut([float(t) for t in terminal], {p: float(w) for p, w in edges.items()})
    assert cost(got) == min(cost(s) for s in itertools.product([True, False], repeat=len(terminal)))


def test_pages_table(spark):
    rows = [(1, "u", ARTICLE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", ARTICLE, "x")]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((str(r["id"]), len(r["text"])) for r in got.collect()) == sorted(
        (str(i), len(html_extract.extract(h))) for i, _, h, _ in rows)


# -- license notices -----------------------------------------------------------------


def brute_notices(text):
    """Every notice searched with errors over the whole text, without seeds."""
    plain, _ = licenses.words_only((text or "").encode())
    found = set()
    for notice, label in licenses.NOTICES.items():
        n = len(notice) // 10
        if regex.search(b"(?be)(?:" + notice.encode() + b"){e<=%d}" % n, plain):
            found.add(label)
    return found


def test_notices_equal_a_search_without_seeds():
    rng = random.Random(7)
    for notice, label in licenses.NOTICES.items():
        for errors in (0, 1, len(notice) // 10, len(notice) // 10 + 4):
            text = list(notice)
            for at in rng.sample(range(2, len(text) - 2), errors):
                text[at] = rng.choice("xyz")
            text = "Some words before. " + "".join(text).upper() + ", and after"
            _, found = licenses.scan_text(text.encode())
            assert {f["label"] for f in found if not f["base"]} == brute_notices(text)
            for f in found:
                assert text.encode()[f["start_byte"]:f["end_byte"]].strip()
        assert label in {f["label"] for f in licenses.scan_text(notice.encode())[1]}


def test_base_phrases(spark):
    rows = [(1, "CC-BY and cc  by, not ccby or xcc by; cc by9", "s"), (2, None, None), (3, "", "s"),
            (4, "All rights\nreserved. GNU General Public License", "s"), (5, "é cc by é" * 2000, "s"), (1, "cc by", "s")]
    got = {(r["id"], r["n_words"]): r for r in licenses.digest(licenses.scan(docs_of(spark, rows))).collect()}
    first = got[1, 12]
    assert (first["n_base"], first["first_word"], first["last_word"], first["base_labels"]) == (2, 0, 3, "cc-by")
    assert got[2, 0]["labels"] == "" and got[2, 0]["score"] == 0 and got[3, 0]["first_word"] is None
    row = next(r for r in got.values() if r["id"] == 4)
    assert row["base_labels"] == "gpl,reserved" and row["first_word"] == 0 and row["last_word"] == 4 and row["score"] == 1
    assert next(r for r in got.values() if r["id"] == 5)["n_base"] == 2000
    assert licenses.scan(docs_of(spark, [])).count() == 0


# -- the pipeline --------------------------------------------------------------------


def test_pipeline_runs_and_keeps_the_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*docs.columns, "shard"]
    assert got.select(docs.columns).exceptAll(docs.union(docs)).count() == 0
    assert 0 < got.select("doc_id").distinct().count() < docs.count()


def test_every_stage_takes_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, _row int"
    rows = [(1, None, None, None, None, "x", 1), (None, "", "en", "a", 0, "x", 2), (2, "same text of six words here", "en", "a", 1, "x", 3),
            (2, "same text of six words here", "en", "a", 1, "x", 3)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns
            assert out.count() <= 2 * len(data)


def test_pages_that_break_off_and_formulas(spark):
    import time

    begin = time.perf_counter()
    for n in (30, 200, 20_000):
        for tail in ('<a ' + 'x="' * n, "<p title='" + "\"'" * n, "<" * n + '<b "' * n):
            blocks = html_extract.blocks_of("<p>some words stay</p>" + tail)
            assert [text for text, _ in blocks][:1] == ["some words stay"]
    assert time.perf_counter() - begin < 5
    text = lambda page: [t for t, _ in html_extract.blocks_of(page)]
    assert text('<p>mass <math><mi>m</mi><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup></math> here</p>') == ["mass m=c2 here"]
    assert text('<p title="a > b">x</p><p data-html="<b>y</b>">z</p><a title="open>w</a>') == ["x", "z", "w"]
    deep = '<p><a href="#">' + "<font>" * 30 + "linked</a> free</p><p class=notice>" + "<b>" * 30 + "note<p>plain text"
    found = html_extract.blocks_of(deep)
    assert [t for t, _ in found] == ["linked free", "note", "plain text"]
    assert found[0][1].linked == len("linked") and found[1][1].region and not found[2][1].region


def test_a_notice_in_front_of_a_better_one_is_found():
    good = b"licensed under the apache license version 2 0"
    bad = good.replace(b"under", b"undr")
    for text, spans in ((bad + b" and " + good, 2), (good + b" and " + bad, 2), (bad + b" x " + good + b" y " + bad, 3)):
        found = [f for f in licenses.scan_text(text)[1] if not f["base"] and f["label"] == "apache-2.0"] or [
            f for f in licenses.scan_text(text)[1] if not f["base"]]
        assert len({f["start_byte"] for f in found}) >= spans
        assert all(f["start_word"] == text[:f["start_byte"]].count(b" ") for f in found)
