"""Classifying lines by an ordered list of regex rules; the first match wins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.patterns import (
    Term, any_of_texts, check_patterns, flags_of, line_matches_sql, required_text, sql_text,
)

# Rules per CASE expression; a longer list is several of them, tried one after the other.
BLOCK = 64
# A block of at least GATED rules that need a text of NEEDED characters each is gated by these texts.
GATED, NEEDED = 8, 3

RULE_COLUMNS = ("priority", "pattern", "ignore_case", "fore", "back")
RULE_TYPE = "struct<priority:int,fore:string,back:string>"


@dataclass(frozen=True)
class Rule:
    pattern: str
    ignore_case: bool = False
    fore: str = ""
    back: str = ""


def _with_rule(lines: DataFrame, rule: Column) -> DataFrame:
    return lines.withColumn("_rule", rule).select(
        *lines.columns,
        F.col("_rule.priority").alias("rule"),
        F.col("_rule.fore").alias("fore"),
        F.col("_rule.back").alias("back"),
    )


def classify(lines: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add rule (position in the list), fore and back; NULL when no rule matches.

    One pass; a line is tested only up to its first matching rule.
    """
    numbered = list(enumerate(rules))
    check_patterns(lines.sparkSession, [Term(r.pattern, r.ignore_case) for _, r in numbered])
    return _with_rule(lines, _first_of(numbered))


def _first_of(numbered: list[tuple[int, Rule]]) -> Column:
    """The first rule that matches, as one SQL text; a block of rules is tried if a text that its rules need occurs."""
    blocks = []
    for gated, run in groupby(numbered, key=lambda x: len(_needed(x[1])) >= NEEDED):
        run = list(run)
        for k in range(0, len(run), BLOCK):
            blocks.append(_case(run[k:k + BLOCK], gated and len(run) >= GATED))
    return F.expr(f"coalesce({', '.join([*blocks, f'CAST(NULL AS {RULE_TYPE})'])})")


def _term(rule: Rule) -> Term:
    return Term(rule.pattern, rule.ignore_case)


def _needed(rule: Rule) -> str:
    return required_text(_term(rule)) or ""


def _case(numbered: list[tuple[int, Rule]], gated: bool) -> str:
    whens = [
        f"WHEN {line_matches_sql('line', _term(r))} THEN named_struct('priority', "
        f"CAST({'NULL' if priority is None else int(priority)} AS INT), 'fore', {sql_text(r.fore)}, 'back', {sql_text(r.back)})"
        for priority, r in numbered]
    case = f"CASE {' '.join(whens)} END"
    if not gated:
        return case
    gate = flags_of(any(r.ignore_case for _, r in numbered)) + any_of_texts(_needed(r) for _, r in numbered)
    return f"CASE WHEN rlike(line, {sql_text(gate)}) THEN {case} END"


def classify_join(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """``classify`` with rules from a table (priority, pattern, ignore_case, fore, back).

    The lowest priority wins; equal ones are tried by pattern, exact case before any
    case, then by fore and back (NULLs last throughout).  NULL and empty patterns match nothing;
    a NULL ``ignore_case`` means exact case.  Every pattern is checked before the job.
    A rule list is written by people and is part of the plan, however long it is:
    each pattern is compiled once a task, and no (line, rule) pairs are built.  In a long list
    one regex of the texts that the rules need decides whether a block of them is tried at all.
    """
    stored = rules.select(*RULE_COLUMNS).filter("pattern IS NOT NULL AND pattern <> ''").collect()

    def order(r) -> tuple:
        parts = (r.priority, r.pattern, bool(r.ignore_case), r.fore, r.back)
        return tuple(x for p in parts for x in ((p is None), "" if p is None else p))

    listed = [(r.priority, Rule(r.pattern, bool(r.ignore_case), r.fore, r.back)) for r in sorted(stored, key=order)]
    check_patterns(lines.sparkSession, [Term(r.pattern, r.ignore_case) for _, r in listed])
    return _with_rule(lines, _first_of(listed))


def rule_counts(classified: DataFrame) -> DataFrame:
    """Lines per rule."""
    return classified.groupBy("rule").agg(F.count("*").alias("n_lines"))
