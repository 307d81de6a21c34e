"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    if hasattr(x, "as_py"):
        x = x.as_py()
    return round(x, 9) if isinstance(x, float) else x


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) == 74


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda k: names[k])
    want = sorted(repr([plain(r[k]) for k in order]) for r in cur.fetchall())
    assert got == want
