"""Exact quantiles of groups against sorted lists, with the sketch in use and without."""

import random
import statistics

import numpy as np
import pytest

from opsloom.functions import quantiles as Q

WANTED = {"p0": (0.0, Q.INCLUSIVE), "low": (0.05, Q.INCLUSIVE), "median": (0.5, Q.INCLUSIVE), "p95": (0.95, Q.INCLUSIVE), "p100": (1.0, Q.INCLUSIVE), "x90": (0.9, Q.EXCLUSIVE), "x10": (0.1, Q.EXCLUSIVE)}


def groups():
    rnd = random.Random(2)
    made = {f"g{n}": [rnd.choice([rnd.gauss(0, 1), 7.0, float(rnd.randint(-3, 3))]) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 10, 11, 99)}
    return made | {"hot": [rnd.lognormvariate(0, 3) for _ in range(40_000)], "copies": [3.0] * 30_000 + [1.0], "halves": [1.0] * 20_000 + [2.0] * 20_000}


@pytest.mark.parametrize("small", [50_000, 500])
def test_against_sorted_lists(spark, small, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", small)
    made = groups()
    df = spark.createDataFrame([(g, v) for g, some in made.items() for v in some] + [("g1", None), ("none", None)], "g string, v double").repartition(7)
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", WANTED).collect()}
    assert set(got) == set(made)
    for g, some in made.items():
        r = got[g]
        assert r.n == len(some)
        for name, (p, method) in WANTED.items():
            if method == Q.INCLUSIVE:
                want = np.quantile(some, p)
            else:
                want = some[0] if len(some) == 1 else statistics.quantiles(some, n=10)[0 if p < 0.5 else -1]
            assert getattr(r, name) == pytest.approx(want, rel=1e-9, abs=1e-12), (g, name)


def test_little_is_sent_on(spark, monkeypatch):
    """Of a large group only values near the wanted rank are ranked."""
    monkeypatch.setattr(Q, "SMALL", 500)
    df = spark.range(100_000).selectExpr("1 g", "cast(id as double) v")
    plan = Q.exact_quantiles(df, ["g"], "v", {"median": (0.5, Q.INCLUSIVE)})
    assert plan.first().median == 49_999.5
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and " percentile(" not in text and "median(" not in text


def test_without_keys_and_without_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert Q.exact_quantiles(df, [], "v", {"m": (0.5, Q.INCLUSIVE)}).first().asDict() == {"n": 2, "m": 1.5}
    assert Q.exact_quantiles(df.filter("v is null"), [], "v", {"m": (0.5, Q.INCLUSIVE)}).collect() == []
