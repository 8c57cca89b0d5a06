"""Every registered query of the library against its SQL, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from skein.plans import catalog
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[k]) for k in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    want = tables.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
