"""Every registered query against its SQL on the same tables."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


FAMILIES = {
    "bigint": "int", "int": "int", "string": "str", "double": "float", "boolean": "bool",
    "timestamp_ntz": "ts", "BIGINT": "int", "INTEGER": "int", "VARCHAR": "str",
    "DOUBLE": "float", "BOOLEAN": "bool", "TIMESTAMP": "ts",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries()[name](spark, SF_DIR)
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    kinds = {d[0]: FAMILIES[str(d[1])] for d in want.description}
    assert {n: FAMILIES[t] for n, t in got.dtypes} == kinds
    expected = canonical(want.fetchall(), names)
    rows = [tuple(r) for r in got.collect()]
    assert canonical(rows, got.columns) == expected
    if name != "search_empty":
        assert expected


def test_entry(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
