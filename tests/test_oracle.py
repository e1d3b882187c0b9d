"""Registered queries against their SQL in DuckDB, and the driver's entry points."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallymill.plans import inventory, registry

#: The inventory's queries load files and fit models: a tenth of the others' rows.
SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    out = {}
    for sf in (SF, SMALL):
        out[sf] = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            out[sf].execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_as_sql(spark, duck, name):
    sf = SMALL if name in inventory.QUERIES else SF
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck[sf].execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=str)


def test_entry_points(spark):
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(registry.QUERIES) <= set(queries) and set(oracle) <= set(queries)
    rows = entry_points.entry(spark)
    assert rows.count() > 0 and rows.columns == ["column", "mean_shift_sigmas", "std_ratio", "missing_frequency_delta", "severity"]
