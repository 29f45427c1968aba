"""Every core query against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from tessera import queries as q
from tessera.sources.fixtures import TABLES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, D)
    got = [tuple(r) for r in df.collect()]
    if name not in q.SQL:
        assert got
        return
    res = duck.execute(q.SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(got, df.columns) == rows_of(res.fetchall(), cols)
