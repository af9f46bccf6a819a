"""Every query against its oracle SQL in DuckDB, compared as the driver does."""

import math
import os

import duckdb
import pytest

from tessera.plans.catalog import CASES
from tessera.sources.fixtures import TABLES, Tables, with_derived

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if sql])
def test_against_sql(spark, con, name):
    make, sql = CASES[name]
    df = make(Tables(spark, SF))
    rel = con.execute(with_derived(sql))
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert want, "the oracle gives no rows"
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if not sql])
def test_runs(spark, name):
    assert CASES[name][0](Tables(spark, SF)).count() >= 0
