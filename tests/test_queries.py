"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skytally.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
