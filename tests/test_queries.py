"""Every query of the library against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tidewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    said = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(said.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    want = sorted(tuple(plain(dict(zip(said.columns, r))[c]) for c in columns) for r in said.fetchall())
    assert rows == want


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
