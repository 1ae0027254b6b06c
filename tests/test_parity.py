"""Every query with an oracle gives the rows that its SQL gives on the smallest data."""

import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _names():
    from opsloom.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", _names())
def test_parity(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    assert columns == sorted(duck.sql(sql).columns)
    want = sorted(([plain(v) for v in r] for r in duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall()), key=repr)
    assert sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
