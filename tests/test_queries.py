"""Every registered query of the library proper against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from plazamill import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, con, name):
    out = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in out.columns]
    got = sorted(tuple(plain(v) for v in r) for r in out.collect())
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, con, name):
    out = registry.QUERIES[name](spark, SF)
    rows = out.collect()
    assert rows and all(len(r) == len(out.columns) for r in rows)
    key = next((c for c in ("id", "page_id", "source_id") if c in out.columns), None)
    assert key is None or all(r[key] is not None for r in rows)


def test_fuzzy_names_looks_up_every_customer(spark, con):
    out = registry.QUERIES["j08_fuzzy_names"](spark, SF).collect()
    names = dict(con.sql("SELECT c_custkey, lower(c_name) FROM customer").fetchall())
    assert len(out) == len(names) and {r["id"] for r in out} == set(names)
    assert all(r["match_id"] == r["id"] for r in out)
