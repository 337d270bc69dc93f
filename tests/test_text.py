import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewell.functions import (
    Term, expand_tabs, first_span, last_span, match_spans, portion, span_count,
    visible_length, word_at,
)
from linewell.functions.patterns import (
    any_matches, any_of_texts, line_matches, required_text, shift_backrefs,
)

LINES = [
    "", "plain", "a\tb", "\t\t", "12345678\tx", "x\x00y", "foo bar foo", "baac", "aaaa",
    "ÉTÉ été", "cr at end\r", "a\rb", "under_score 42", "tab\tand foo\tfoo", "﷐odd﷑",
]


def frame(spark, lines):
    return spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")


def shown(line):
    return line.replace("\x00", " ").expandtabs(8)


def values(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_tabs_and_lengths(spark):
    df = frame(spark, LINES)
    assert values(df, expand_tabs("line")) == [shown(s) for s in LINES]
    assert values(df, visible_length("line")) == [len(shown(s)) for s in LINES]


def test_long_lines_stay_cheap(spark):
    """Quadratic work on these lines would take minutes."""
    word = "w" * 400_000
    lines = [word, word + "\t" + word, " ".join(["foo"] * 100_000), "\t" * 20_000]
    df = frame(spark, lines)
    assert values(df, visible_length("line")) == [len(shown(s)) for s in lines]
    got = values(df, word_at("line", 399_999))
    assert [g.word if g else None for g in got] == [word, word, None, None]
    firsts = values(df, first_span(F.col("line"), "w$|o f", 10))
    assert [(f.start, f.len) if f else None for f in firsts] == [
        (399_999, 1), (len(lines[1]) - 1, 1), (10, 3), None]
    assert values(df, last_span(F.col("line"), "foo"))[2].start == 399_996
    found = values(df, match_spans("line", "foo"))[2]
    assert [tuple(s) for s in found] == [(4 * i, 3) for i in range(100_000)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab\t\x00é😀", max_size=30), min_size=60, max_size=60))
def test_tabs_property(spark, lines):
    assert values(frame(spark, lines), expand_tabs("line")) == [shown(s) for s in lines]


@pytest.mark.parametrize("low,high", [(0, 0), (2, 5), (5, 2), (4, 400)])
def test_portion(spark, low, high):
    a, b = min(low, high), max(low, high)
    want = [shown(s)[a:b + 1] for s in LINES]
    assert values(frame(spark, LINES), portion("line", low, high)) == want


@pytest.mark.parametrize("column", [0, 3, 8, 9, 30])
def test_word_at(spark, column):
    want = []
    for s in LINES:
        hits = [m for m in re.finditer("[A-Za-z0-9_]+", shown(s)) if m.start() <= column < m.end()]
        want.append((hits[0][0], hits[0].start(), hits[0].end() - 1) if hits else None)
    got = values(frame(spark, LINES), word_at("line", column))
    assert [tuple(g) if g else None for g in got] == want


@pytest.mark.parametrize("pattern", ["a*", "foo", "o|a", "(a)\\1", "^a", "$", "b?", "[a-c]+"])
def test_spans(spark, pattern):
    df = frame(spark, LINES)
    want = [[(m.start(), m.end() - m.start()) for m in re.finditer(pattern, s)] for s in LINES]
    got = [[tuple(x) for x in spans] for spans in values(df, match_spans("line", pattern))]
    assert got == want
    assert values(df, span_count("line", pattern)) == [len(w) for w in want]
    ends = [tuple(x) if x else None for x in values(df, last_span(F.col("line"), pattern))]
    assert ends == [w[-1] if w else None for w in want]


@pytest.mark.parametrize("pattern", ["foo", "(o)\\1", "a", "o$", "^f", "(?<=o)o", "a*"])
@pytest.mark.parametrize("at", [0, 1, 9])
def test_first_span_from_column(spark, pattern, at):
    df = frame(spark, LINES)
    compiled = re.compile(pattern)
    want = []
    for s in LINES:
        m = compiled.search(s, at) if at <= len(s) else None
        want.append((m.start(), m.end() - m.start()) if m else None)
    for column in (at, F.lit(at) + F.col("i") * 0):
        got = values(df, first_span(F.col("line"), pattern, column))
        assert [tuple(x) if x else None for x in got] == want


def test_fixed_text_is_literal(spark):
    df = frame(spark, ["a.b", "axb", "A.B", "\\Qa.b"])
    fixed = Term("a.b", syntax="fixed")
    assert values(df, line_matches("line", fixed)) == [True, False, False, True]
    anycase = Term("a.b", ignore_case=True, syntax="fixed")
    assert values(df, line_matches("line", anycase)) == [True, False, True, True]
    got = values(df, first_span(F.col("line"), fixed, F.lit(0)))
    assert [g.start if g else None for g in got] == [0, None, None, 2]
    odd = "#x y&~[]{}()*+-?^$|\\."
    one = frame(spark, [odd])
    assert values(one, line_matches("line", Term(odd, True, "fixed"))) == [True]


def test_dialect(spark):
    df = frame(spark, ["é", "É", "foo\r", "a\rb"])
    assert values(df, line_matches("line", r"^\w$")) == [True, True, False, False]
    assert values(df, line_matches("line", Term("é", True))) == [True, True, False, False]
    assert values(df, line_matches("line", "foo$")) == [False] * 4
    assert values(df, line_matches("line", "a.b")) == [False, False, False, True]


def test_empty_terms_match_nothing(spark):
    df = frame(spark, LINES)
    assert not any(values(df, line_matches("line", "")))
    assert not any(values(df, any_matches("line", ["", Term("", syntax="fixed")])))
    assert values(df, match_spans("line", "")) == [[]] * len(LINES)


def test_backreferences_are_shifted():
    assert shift_backrefs(r"(a)\1\\1\Q\1\E\1", 1) == r"(a)\2\\1\Q\1\E\2"


def test_open_quotes_are_closed(spark):
    df = frame(spark, ["a+b c", "aab", "\\Q"])
    got = values(df, first_span(F.col("line"), "\\Qa+b"))
    assert [tuple(g) if g else None for g in got] == [(0, 3), None, None]
    assert values(df, line_matches("line", r"\\Q")) == [False, False, True]
    assert [bool(g) for g in values(df, first_span(F.col("line"), r"\\Q"))] == [False, False, True]


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        Term("x", syntax="wildcard")


@pytest.mark.parametrize("pattern, needed", [
    ("abc", "abc"), ("ab?cde", "cde"), ("ab*c+de", "de"), ("xab{2}c", "xa"), ("xab{0,}?c", "xa"), ("a|b", None), ("(a|b)cd", "cd"),
    (r"a\.b\dcdef", "cdef"), (r"a\.b", "a.b"), ("[abc]def[^]x]gh", "def"), ("[a[b]]cd", None), (r"\Qa.b\E", None), ("(?i)abc", None),
    ("(?x) a b c", None), ("a(?:b(c)d)*efg", "efg"), (r"\tabc", None), ("^abc$", "abc"), (".*", None), ("", None), (r"a\\bc", "a\\bc"),
    ("ab(?=cd)ef", "ab"), ("é+日本", "日本"), (r"[\]a]xyz", "xyz"),
])
def test_required_text(pattern, needed):
    assert required_text(Term(pattern)) == needed


def test_required_texts_are_in_every_match(spark):
    rng = random.Random(4)
    atoms = ["a", "b", "ab", "x", ".", "a?", "b*", "x+", "[ab]", "[^x]", "(ab|x)", "(?:a)?", r"\.", r"\w", "a{2}", "b{0,1}", "^", "$"]
    patterns = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    lines = ["".join(rng.choice("abx.") for _ in range(rng.randrange(12))) for _ in range(120)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    for k in range(0, len(patterns), 50):
        part = patterns[k:k + 50]
        hits = df.select("line", *[line_matches("line", p).alias(f"p{i}") for i, p in enumerate(part)]).collect()
        for i, p in enumerate(part):
            needed = required_text(Term(p))
            assert all(needed in r["line"] for r in hits if needed and r[f"p{i}"]), p


def test_any_of_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab.(") for _ in range(rng.randrange(3, 8))) for _ in range(30)] + ["x" * 40 + "y"]
    lines = ["".join(rng.choice("ab.(") for _ in range(rng.randrange(20))) for _ in range(200)] + ["x" * 40 + "y", "x" * 20]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", F.rlike("line", F.lit(any_of_texts(texts))).alias("hit")).collect():
        assert r["hit"] == any(t[:24] in r["line"] for t in texts)
    assert any_of_texts(["abc", "abd", "ab"]) == "ab"
