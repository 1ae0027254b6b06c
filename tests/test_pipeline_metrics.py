"""Windows of sketches: of a table, of a stream, and merged."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.streaming import metrics as M
from opsloom.streaming.medallion import drain

DDL = "id string, type string, time timestamp, arrived timestamp, data string"
T0 = datetime(2026, 1, 1)


def delivered(n=3000):
    rnd = random.Random(1)
    rows = [(f"e{rnd.randint(0, n)}", rnd.choice("ab"), T0 + timedelta(seconds=rnd.randint(0, 6 * 3600 - 1)), None, rnd.choice(["x", "x", "x", None])) for _ in range(n)]
    return [(i, t, at, at + timedelta(seconds=rnd.randint(0, 100)), d) for i, t, at, _, d in rows] + [("no time", "a", None, T0, "x")]


def figures(df):
    return {r.type: (r.events, r.rejected, r.rejection_rate, r.distinct_ids, r.lag_s) for r in df.collect()}


def test_merged_windows(spark):
    rows = delivered()
    got = figures(M.merged(M.window_sketches(spark.createDataFrame(rows, DDL), F.col("data").isNotNull()), ["type"]))
    for t in "ab":
        own = [r for r in rows if r[1] == t and r[2] is not None]
        ok = [r for r in own if r[4]]
        lags = sorted((r[3] - r[2]).total_seconds() for r in ok)
        assert got[t][:3] == (len(own), len(own) - len(ok), pytest.approx(1 - len(ok) / len(own)))
        assert abs(got[t][3] - len({r[0] for r in ok})) <= 0.03 * len(ok) and lags[int(0.93 * len(ok))] <= got[t][4] <= lags[int(0.97 * len(ok))]


def test_stream_of_windows_equals_the_table(spark, tmp_path):
    rows, end = delivered(), [(f"z{k}", "z", T0 + timedelta(days=3 + k), T0, "x") for k in range(2)]
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    for part in (rows[:1500], rows[1500:], end[:1], end[1:]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(src)
        drain(M.window_sketches(spark.readStream.schema(DDL).parquet(src), F.col("data").isNotNull(), late="1 day"), out, str(tmp_path / "c"))
    stored = spark.read.parquet(out).filter("type <> 'z'")
    table = M.window_sketches(spark.createDataFrame(rows, DDL), F.col("data").isNotNull())
    keys = ["start", "type", "events", "rejected"]
    assert sorted(map(tuple, stored.select(keys).collect())) == sorted(map(tuple, table.select(keys).collect()))
    a, b = figures(M.merged(stored, ["type"])), figures(M.merged(table, ["type"]))
    assert a.keys() == b.keys() and all(a[t][:3] == b[t][:3] and abs(a[t][3] - b[t][3]) <= 0.03 * b[t][3] for t in a)


def test_nothing_accepted(spark):
    df = spark.createDataFrame([("a", "t", T0, T0, None)], DDL)
    r = M.merged(M.window_sketches(df, F.col("data").isNotNull()), ["type"]).first()
    assert (r.events, r.rejected, r.rejection_rate, r.distinct_ids, r.duplicate_rate, r.lag_s) == (1, 1, 1.0, 0, None, None)
    assert M.rejected_rows(df, F.col("data").isNotNull()).count() == 1 and M.backlog(df, df.limit(0), ["type"]).first().depth == 1
