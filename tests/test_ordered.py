"""Sliced running figures against plain windows, with a key that holds most rows, ties and missing keys and times."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    out = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([None, *[datetime(2026, 1, 1) + timedelta(hours=rnd.randint(0, 2400)) for _ in range(9)]]), i, rnd.choice([None, i])) for i in range(1500)]
    return spark.createDataFrame(out, "k string, at timestamp, i int, v int").cache()


@pytest.mark.parametrize("days", [1, 30, 3650])
def test_running_number_and_last_known(rows, days, monkeypatch):
    monkeypatch.setattr(O, "SLICE_DAYS", days)
    w = W.partitionBy("k").orderBy("at", F.desc("i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    good = F.col("v").isNotNull()
    want = rows.select("i", F.count_if(good).over(w).alias("n"), F.last("v", ignorenulls=True).over(w).alias("l")).collect()
    got = O.running_number(rows, ["k"], ["at", F.desc("i")], good, "n").select("i", "n").collect()
    assert sorted((r.i, r.n) for r in got) == sorted((r.i, r.n) for r in want)
    got = O.last_known(rows, ["k"], ["at", F.desc("i")], "v", "l").select("i", "l").collect()
    assert sorted((r.i, r.l) for r in got if r.l is not None) == sorted((r.i, r.l) for r in want if r.l is not None) and len(got) == len(want)


@pytest.mark.parametrize(("k", "block"), [(1, 7), (5, 5), (5, 6), (5, 64), (20, 3), (3, 10_000)])
def test_last_values(rows, k, block):
    w = W.partitionBy("k").orderBy("at", "i")
    numbered = rows.withColumn("g", F.row_number().over(w))
    want = numbered.withColumn("l", F.collect_list("i").over(w.rowsBetween(-(k - 1), 0))).select("i", "l").collect()
    got = O.last_values(numbered, ["k"], "g", "i", k, "l", block).select("i", "l").collect()
    assert sorted((r.i, r.l) for r in got) == sorted((r.i, r.l) for r in want)


def test_a_hot_key_is_many_windows(rows, monkeypatch):
    """No window is partitioned by the key alone but those over one row a slice."""
    monkeypatch.setattr(O, "SLICE_DAYS", 10)
    sizes = rows.filter("k = 'hot' and at is not null").groupBy(O._slice("at")).count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 2.5 * sum(r["count"] for r in sizes) / len(sizes)


@pytest.mark.parametrize(("days", "k"), [(1, 3), (30, 3), (30, 20), (3650, 5)])
def test_values_before(spark, days, k, monkeypatch):
    """Rows and ends of their own numbers, samples of a key and of a key and band, missing keys, bands and times, values far back."""
    monkeypatch.setattr(O, "SLICE_DAYS", days)
    rnd = random.Random(days + k)
    at = lambda: datetime(1969, 6, 1) + timedelta(hours=rnd.choice([rnd.randint(0, 9000), rnd.randint(0, 50)]))
    key, band = lambda: rnd.choice(["hot", "hot", "hot", "a", None]), lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])
    ends = [(key(), band(), at(), i, float(i)) for i in range(600)]
    rows = [(key(), band(), rnd.choice([None, *[at() for _ in range(9)]]), 1000 + i, f"p{i}") for i in range(500)]
    df = O.values_before(
        spark.createDataFrame(rows, "k string, b int, at timestamp, i int, p string"), spark.createDataFrame(ends, "k string, b int, at timestamp, i int, v double"), {"every": ["k"], "same": ["k", "b"]}, ["at", "i"], "v", k
    )
    assert df.columns == ["k", "b", "at", "i", "p", "every", "same"]
    got = {r.p: (r.every, r.same) for r in df.collect()}
    for key, band, at, i, p in rows:
        past = sorted(((e[2], e[3], e[1], e[4]) for e in ends if e[0] == key and at is not None and (e[2], e[3]) < (at, i)), reverse=True)
        assert got[p] == ([e[3] for e in past][:k], [e[3] for e in past if e[2] == band][:k])
    assert len(got) == len(rows) and any(len(s) == k for _, s in got.values())
