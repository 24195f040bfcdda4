"""Every query against its SQL in DuckDB on the same tables."""

import math

import duckdb
import pytest

from brieflake.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.item() if hasattr(v, "item") else v


def order(row):
    return tuple((x is not None, str(type(x)) if x is not None else "", str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS.get(t, t) for c, t in got.dtypes} == {c: kinds[c] for c in got.columns}
    a = sorted((tuple(plain(v) for v in r) for r in got.select(*cols).collect()), key=order)
    b = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=order)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
