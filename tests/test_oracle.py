"""Every core query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from brindle.plans.queries import ORACLES, QUERIES

NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else v
    return sorted(([one(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
