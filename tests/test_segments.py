"""The regression fold in segments gives what one pass over a job gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.operators import baselines as B

RUN = "run_id string, job_id string, start_time timestamp, end_time timestamp, execution_s double, duration_s double, result_state string, input_rows long"
T0 = datetime(2026, 1, 1)


def runs(seed, n=400):
    """A job that drifts, jumps and overlaps itself, with failures, other bands and missing times; and two small ones."""
    rnd, out, level = random.Random(seed), [], 100.0
    for i in range(n):
        level = level * rnd.choice([1.0, 1.0, 1.0, 1.02, 0.97]) if rnd.random() < 0.98 else rnd.choice([60.0, 100.0, 400.0])
        start = T0 + timedelta(minutes=10 * i + rnd.randint(0, 9))
        took = level * rnd.choice([1.0, 1.1, 0.9, 1.0, 3.0])
        end = start + timedelta(seconds=took * rnd.choice([1, 1, 1, 40]))
        job = "hot" if rnd.random() < 0.8 else rnd.choice(["a", None])
        out.append((f"r{i:04d}", job, start if rnd.random() < 0.98 else None, end if rnd.random() < 0.98 else None, took if rnd.random() < 0.9 else None, took + 5, rnd.choice(["SUCCESS", "SUCCESS", "SUCCESS", "FAILED"]), rnd.choice([None, 100, 120, 5000])))
    return out


def lines(df):
    return sorted(map(tuple, df.select("run_id", "job_id", "metric", "value", "median", "mad", "threshold", "n", "band", "band_fallback", "verdict", "opens").collect()), key=repr)


@pytest.mark.parametrize(("seed", "size"), [(2, 60), (3, 150)])
def test_segments_equal_one_pass(spark, seed, size):
    df = spark.createDataFrame(runs(seed), RUN)
    regimes = spark.createDataFrame([("hot", T0 + timedelta(hours=9))], "job_id string, regime_start timestamp") if seed == 2 else None
    closed = spark.createDataFrame([("hot", T0 + timedelta(hours=30))], "job_id string, closed_until timestamp") if seed == 3 else None
    active = spark.createDataFrame([("hot", [f"r{i:04d}" for i in range(0, 120, 7)])], "job_id string, excluded array<string>") if seed == 3 else None
    whole = B.detect_runtime_regressions(df, regimes, closed, active)
    got = lines(B.detect_runtime_regressions(df, regimes, closed, active, segment=size))
    assert got == lines(whole) and any(r[-2] == "regression" for r in got)


def test_a_history_as_text():
    import pandas as pd

    history = {("execution",): ([pd.Timestamp(T0)], [1.5]), ("execution", None): ([pd.Timestamp(T0)], [1.5]), ("total", 3): ([], [])}
    assert B._known(B._told(history)) == {k: v for k, v in history.items() if v[0]} and B._known(None) == {}


def test_few_segments_are_folded_again(spark, monkeypatch):
    """After the second fold hardly a segment begins with something else than what the one before leaves."""
    folded, real = [], B._folded

    def counted(rows, begins, floor, lines):
        if not lines:
            folded.append(begins.count())
        return real(rows, begins, floor, lines)

    monkeypatch.setattr(B, "_folded", counted)
    rows = [(f"r{i:05d}", "j", T0 + timedelta(minutes=i), T0 + timedelta(minutes=i, seconds=30), 100.0 + i % 7, None, "SUCCESS", 100) for i in range(2000)]
    got = B.detect_runtime_regressions(spark.createDataFrame(rows, RUN), segment=200)
    assert got.filter("verdict = 'healthy'").count() == 1995 and folded[0] == 10 and folded[1] == 9 and sum(folded[2:]) == 0
