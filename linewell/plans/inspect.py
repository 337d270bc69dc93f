"""Reading physical plans: what the tests hold plans to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The executed plan as text; run an action first to see the adaptive one."""
    return df._jdf.queryExecution().executedPlan().toString()


def count_nodes(df: DataFrame, name: str) -> int:
    return len(re.findall(rf"(?<![A-Za-z]){name}(?![A-Za-z])", physical_plan(df)))


def unpartitioned_windows(df: DataFrame) -> list[str]:
    """Window nodes that would gather all rows in one task."""
    first_args = re.findall(r"(windowspecdefinition\(([^,]*),.*)", physical_plan(df))
    return [
        whole for whole, first in first_args
        if first.startswith("specifiedwindowframe") or re.search(r" (ASC|DESC) ", first + " ")
    ]


def uses_python(df: DataFrame) -> bool:
    return bool(re.search(r"ArrowEvalPython|BatchEvalPython|MapInArrow|InPandas", physical_plan(df)))


def pairs_all_rows(df: DataFrame) -> bool:
    return bool(re.search(r"CartesianProduct|BroadcastNestedLoopJoin", physical_plan(df)))
