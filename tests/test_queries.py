"""Every query of the library against DuckDB, or against the expected rows of its case table."""

import math
import os

import duckdb
import pytest

from termgraph import plans
from termgraph.plans.registry import EXPECTED

QUERIES, SQL = plans.queries(), {**plans.oracle_sql(), **EXPECTED}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry_and_contract():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(plans.oracle_sql()) <= set(e.oracle_sql())


def test_what_has_no_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"cooccur_capped"}
