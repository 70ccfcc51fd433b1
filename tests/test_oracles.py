"""Every query with SQL against DuckDB, as the driver does; no rows may differ."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def compare(frame, con, sql):
    names = sorted(frame.columns)
    ours = sorted(str([plain(r[n]) for n in names]) for r in frame.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    theirs = sorted(str([plain(dict(zip(columns, r, strict=True))[n]) for n in names]) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, sf_dir, con):
    compare(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
