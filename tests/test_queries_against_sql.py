"""Every registered core query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest
from marketloom.plans import registry


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(columns: list[str], rows: list) -> list[str]:
    """Rows as texts, columns by name; NaN is a value of its own, not null."""

    def one(v):
        if isinstance(v, (bool, type(None), str)):
            return v
        if isinstance(v, (list, tuple)):
            return [one(x) for x in v]
        if isinstance(v, (int, float, Decimal)):
            return "NaN" if math.isnan(v) else round(float(v), 5)
        return str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([one(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, db, data, name):
    df = registry.QUERIES[name](spark, data)
    got = db.execute(registry.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.columns, df.collect()) == plain(columns, got.fetchall())


def test_nan_is_not_null():
    assert plain(["a"], [(float("nan"),)]) != plain(["a"], [(None,)])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and len(df.collect()) > 0


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
