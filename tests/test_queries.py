"""Each query against its SQL over the small tables."""

import math
import os

import duckdb
import pytest

from covalens.plans.registry import FLAGSHIP, ORACLES, QUERIES
from covalens.session import ship


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return "~" if value is None else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](ship(spark), sf_dir)
    expected = duck.sql(ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    at = [expected.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](ship(spark), sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
