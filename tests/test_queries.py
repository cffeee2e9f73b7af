"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from veridian import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"r10_bootstrap"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows):
    def one(v):
        if v is None:
            return "null"
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.6f}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    names = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {names} FROM ({registry.ORACLES[name]})").fetchall()
    assert canonical(got) == canonical(want)


def test_every_query_runs_without_sql(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, FOLDER).count() > 0, name
