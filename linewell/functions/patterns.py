"""Search terms and how they become Catalyst predicates.

Two syntaxes: ``regex`` (Java regular expressions) and ``fixed`` (literal text).
Regexes always run with the flags d (only LF ends a line, a CR is an ordinary
character) and U (Unicode-aware classes and case folding).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SYNTAXES = ("regex", "fixed")


@dataclass(frozen=True)
class Term:
    """One search term.  An empty text means "no search": it matches nothing."""

    text: str
    ignore_case: bool = False
    syntax: str = "regex"

    def __post_init__(self):
        if self.syntax not in SYNTAXES:
            raise ValueError(f"syntax must be one of {SYNTAXES}, not {self.syntax!r}")


# A quoted stretch, an escaped character, or a numbered back reference.
_TOKEN = re.compile(r"\\Q.*?(?:\\E|$)|\\\\|\\([1-9][0-9]*)|\\.", re.S)


def as_term(term: Term | str, ignore_case: bool = False, syntax: str = "regex") -> Term:
    return term if isinstance(term, Term) else Term(term, ignore_case, syntax)


def escape_text(text: str) -> str:
    """Java regex that matches exactly this text."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~ " else c for c in text)


def body_of(term: Term) -> str:
    """The term as a regex that can be put inside a group."""
    if term.syntax == "fixed":
        return escape_text(term.text)
    last = [m.group(0) for m in _TOKEN.finditer(term.text)][-1:]
    is_open = bool(last) and last[0].startswith("\\Q") and not last[0].endswith("\\E")
    body = term.text + "\\E" if is_open else term.text
    # In comment mode a line end closes a comment, and is ignored where there is none.
    return body + "\n" if ends_in_comment_mode(body) else body


# What counts for the comment mode: quotes, escapes, groups with and without flags, classes.
_PART = re.compile(r"\\Q.*?(?:\\E|$)|\\.|\(\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])|[()\[\]#\n]", re.S)


def ends_in_comment_mode(body: str) -> bool:
    """Is the flag x on where the regex ends?"""
    modes, depth, comment = [False], 0, False
    for m in _PART.finditer(body):
        part = m.group(0)
        if comment:
            comment = part != "\n"
        elif part == "#":  # begins a comment in a class too
            comment = modes[-1]
        elif depth:
            depth += (part == "[") - (part == "]")
        elif part == "[":
            depth = 1
        elif m.group(3):
            now = (modes[-1] or "x" in m.group(1)) and "x" not in (m.group(2) or "")
            if m.group(3) == ":":
                modes.append(now)
            else:
                modes[-1] = now
        elif part == "(":
            modes.append(modes[-1])
        elif part == ")" and len(modes) > 1:
            modes.pop()
    return modes[-1]


def flags_of(ignore_case: bool) -> str:
    return "(?diU)" if ignore_case else "(?dU)"


def regex_of(term: Term | str) -> str:
    """The full Java regex of a term, flags included."""
    term = as_term(term)
    return flags_of(term.ignore_case) + body_of(term)


def line_matches(line: Column | str, term: Term | str) -> Column:
    """Does the term occur anywhere in the (raw) line?"""
    term = as_term(term)
    line = F.col(line) if isinstance(line, str) else line
    if term.text == "":
        return F.lit(False)
    if term.syntax == "fixed" and not term.ignore_case:
        # Reaches the Parquet scan as a StringContains filter.
        return F.contains(line, F.lit(term.text))
    return F.rlike(line, F.lit(regex_of(term)))


def any_matches(line: Column | str, terms: Iterable[Term | str]) -> Column:
    """OR of several terms, each with its own syntax and case rule."""
    tests = [line_matches(line, t) for t in terms if as_term(t).text != ""]
    return reduce(or_, tests) if tests else F.lit(False)


def check_pattern(spark: SparkSession, term: Term | str) -> None:
    """Raise Spark's own invalid-pattern error before any job over data starts.

    The one-row query is folded by the optimizer; it starts no tasks over a table.
    """
    check_patterns(spark, [as_term(term)])


def check_patterns(spark: SparkSession, terms: list[Term]) -> None:
    """``check_pattern`` for many terms, a few queries in all.

    The form that stands inside a group is checked too, as finds and spans use it.
    """
    regexes = [x for t in terms if t.text != "" and t.syntax == "regex"
               for x in (regex_of(t), f"{flags_of(t.ignore_case)}({shift_backrefs(body_of(t), 1)})")]
    for k in range(0, len(regexes), 200):
        spark.range(1).selectExpr(*[f"rlike('', {sql_text(x)})" for x in regexes[k:k + 200]]).collect()


def sql_text(text: str | None) -> str:
    """A string as SQL, whatever it holds and whatever the session's escape rules are."""
    return "CAST(NULL AS STRING)" if text is None else f"CAST(X'{text.encode().hex()}' AS STRING)"


def line_matches_sql(line: str, term: Term) -> str:
    """``line_matches`` as SQL text."""
    if term.text == "":
        return "false"
    if term.syntax == "fixed" and not term.ignore_case:
        return f"contains({line}, {sql_text(term.text)})"
    return f"rlike({line}, {sql_text(regex_of(term))})"


# Quoted text, an escaped character, a counted repeat, a class, or any character.
_ATOM = re.compile(r"\\Q|\\(.)|(\{[0-9]+(?:,[0-9]*)?\}[?+]?)|\[|(.)", re.S)


def required_text(term: Term) -> str | None:
    """The longest text that every match of a term surely holds; None where that is not plain to see.

    Only characters outside groups and classes are looked at.  Alternatives, quotes and
    flags inside the pattern give None.
    """
    if term.syntax == "fixed":
        return term.text or None
    if re.search(r"\\Q|\(\?[a-zA-Z-]", term.text):
        return None
    runs, depth, at, text = [""], 0, 0, term.text
    while at < len(text):
        m = _ATOM.match(text, at)
        escaped, repeat, plain = m.groups()
        at = m.end()
        if m.group(0) == "[":
            end = re.compile(r"\^?\]?(?:\\.|[^\]\\\[&])*\]", re.S).match(text, at)
            if end is None:
                return None  # a class inside a class, or an operation on classes
            at = end.end()
            runs.append("")
        elif plain == "(":
            depth += 1
            runs.append("")
        elif plain == ")":
            depth -= 1
            runs.append("")
        elif depth:
            continue
        elif plain == "|":
            return None
        elif repeat or plain in ("?", "*"):
            runs[-1] = runs[-1][:-1]
            runs.append("")
        elif plain in ("+", ".", "^", "$"):
            runs.append("")
        elif escaped is not None:
            if escaped.isalnum():
                if escaped not in "dDsSwWbBAzZGhHvVRX":
                    return None
                runs.append("")
            else:
                runs[-1] += escaped
        else:
            runs[-1] += plain
    return max(runs, key=len) or None


def any_of_texts(texts: Iterable[str], most: int = 24) -> str:
    """A regex that occurs in a line if one of the texts does; common beginnings are tried once.

    Only the first ``most`` characters of a text count.
    """
    branches: dict[str, list[str]] = {}
    for t in texts:
        branches.setdefault(t[:1], []).append(t[1:most])
    if "" in branches:
        return ""
    parts = []
    for first, rests in branches.items():
        parts.append(escape_text(first) + any_of_texts(rests, most - 1))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def shift_backrefs(body: str, by: int) -> str:
    """Renumber ``\\1``-style references for a regex that gains ``by`` leading groups."""
    def renumber(m: re.Match) -> str:
        return f"\\{int(m.group(1)) + by}" if m.group(1) else m.group(0)

    return _TOKEN.sub(renumber, body)
