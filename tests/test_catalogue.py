"""Every query with SQL gives the SQL's rows; every other one runs and has rows."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from rainloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if name not in catalogue.ORACLES:
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = db.sql(catalogue.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(res.columns)
    at = [res.columns.index(c) for c in order]
    key = lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) else (v is None, "n", round(v, 3)) for v in r)
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(v, (int, float)) for v in b) else all(x == y or (isinstance(x, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
