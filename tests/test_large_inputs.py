"""Steps that must not grow faster than their input: what they send on, and that their rows stay the same."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.operators import baselines as B
from opsloom.operators import incidents as I
from opsloom.operators import knowledge as K
from opsloom.operators import lineage as L
from opsloom.operators import profiling as P
from opsloom.sources.scratch import cut

T0 = datetime(2026, 1, 1)


def test_runs_meet_only_changes_near_their_window(spark):
    """The rows of all pairs of a job, although a run is joined with the slices of time that its window touches."""
    rnd = random.Random(1)
    at = lambda: T0 + timedelta(hours=rnd.choice([0, 24, 168]) * rnd.randint(0, 30) + rnd.choice([0, 0, 5]))
    runs = [(f"r{i}", rnd.choice(["a", "b", None]), rnd.choice(["s1", "s2", None]), at() if i % 11 else None, at() if i % 3 == 0 else None) for i in range(60)]
    commits = [(rnd.choice(["a", "b"]), rnd.choice(["s1", "s2", "s3"]), at() if i % 13 else None) for i in range(120)]
    df = I.changes_in_window(
        spark.createDataFrame(runs, "run_id string, job_id string, git_sha string, start_time timestamp, healthy_end timestamp"),
        spark.createDataFrame(commits, "job_id string, sha string, committed_at timestamp"),
    )
    want = []
    for run, job, sha, start, healthy in runs:
        if start is None:
            continue
        since = healthy or start - timedelta(days=7)
        met = [(0 if s == sha else 1, -(c - T0).total_seconds(), s) for j, s, c in commits if j == job and c is not None and since < c <= start]
        want += [(run, m[2], n + 1) for n, m in enumerate(sorted(met))]
    assert sorted(map(tuple, df.select("run_id", "sha", "nth").collect())) == sorted(want) and len(want) > 100
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    (join,) = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "_slice" in join


def test_equal_sources_are_read_once(spark):
    """Copies of a text, however few files they lie in, are parsed once and all get their rows."""
    code = "def f(df):\n    return df.groupBy('k').agg(F.sum('x').alias('m'), F.max('y').alias('n'))\n"
    files = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") % 3 == 1, F.lit(code)).when(F.col("id") % 3 == 2, F.lit("def (")).alias("value"))
    df = K.observed_metrics(files)
    got = {tuple(r) for r in df.groupBy("metric_id", "formula", "extraction_status").count().collect()}
    assert got == {("m", "F.sum('x')", "extraida", 1000), ("n", "F.max('y')", "extraida", 1000), ("", "", "nao_extraivel", 1000)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Aggregate [")


def test_edges_of_a_walk_are_made_once(spark, monkeypatch):
    """The grouped edges are written before the first hop, with the number that its join begins with."""
    written, real = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: written.append(df.columns) or real(df))
    edges = spark.createDataFrame([("a", "b", "job", "", 1.0), ("b", "c", "dashboard", "", 0.5), ("b", "c", "job", "", 0.5), ("c", "a", "job", "", 1.0)], "source string, target string, entity_type string, entity_id string, weight double")
    got = L.traverse(edges, spark.createDataFrame([("a",)], "origin string"))
    assert sorted((r.node, r.score, r.hops, r.entity_type) for r in got.collect()) == [("b", 0.5, 1, "job"), ("c", 0.125, 2, "job")]
    assert written[0] == ["hash", "k", "to", "weight", "entity_type"] and len(written) == 3


def test_scratch_tables_are_columns(spark):
    df = spark.createDataFrame([("a", [1, None], {"k": 1.5}, T0), (None, None, None, None)], "s string, a array<int>, m map<string,double>, t timestamp")
    out = cut(df)
    assert out.schema == df.schema and sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert all(f.endswith(".parquet") for f in out.inputFiles()) and cut(df.limit(0)).count() == 0


def test_operators_in_plans(spark):
    """Looking at first letters only finds what the plain pattern finds."""
    texts = [" ".join(P.PLAN_OPERATORS), "SortMergeJoinSort", "Exchange\nhashpartitioning", "BBroadcastExchange xWindow[", "Exchange hashpartitioningSortAggregateGenerate", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.plan_operators(F.col("t")).alias("o"))
    for r in got.collect():
        assert r.o == sorted(set(re.findall("|".join(P.PLAN_OPERATORS), r.t)))
    assert "(?=[" in got._jdf.queryExecution().optimizedPlan().toString()


def test_differences_are_shaped_after_the_joins(spark):
    """Runs are joined with their own columns; no map of texts goes through a shuffle."""
    runs = spark.createDataFrame([("1", 10.04, {"run_id": "1", "a": "x"}, ["Sort"], 5), ("2", 10.0, {"run_id": "2", "a": "x"}, [], None), ("3", 11.0, {"a": "y"}, ["Sort"], 5)], "run_id string, duration_s double, job_parameters map<string,string>, plan_operators array<string>, input_rows long")
    pairs = spark.createDataFrame([("2", "1"), ("3", "1"), ("1", None)], "run_id string, healthy_run_id string")
    df = B.diff_runs(pairs, runs)
    got = {(r.run_id, r.dimension): (r.healthy, r.current, r.status) for r in df.collect()}
    assert len(got) == 3 * len(B.DIMENSIONS) and got["2", "duration_s"] == ("10.0", "10.0", "equal") and got["3", "duration_s"] == ("10.0", "11.0", "changed")
    assert got["2", "job_parameters"] == ("a=x", "a=x", "equal") and got["3", "job_parameters"] == ("a=x", "a=y", "changed")
    assert got["2", "plan_operators"] == ("Sort", None, "not_available") and got["2", "input_rows"][2] == "not_available" and got["3", "gc_ms"] == (None, None, "not_available")
    assert got["1", "duration_s"] == (None, "10.0", "not_available")
    assert "map_from_arrays" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_segments_are_guessed_from_tails(spark, monkeypatch):
    """The first fold reads the first segment and the ends of the others; memory is that of a segment."""
    folded, real = [], B._folded

    def counted(rows, begins, floor, *more):
        folded.append(rows.count())
        return real(rows, begins, floor, *more)

    monkeypatch.setattr(B, "_folded", counted)
    monkeypatch.setattr(B, "TAIL", 40)
    rows = [(f"r{i:05d}", "j", T0 + timedelta(minutes=i), T0 + timedelta(minutes=i, seconds=30), 100.0 + i % 7 + (500 if i % 97 == 0 else 0), None, "SUCCESS", 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "run_id string, job_id string, start_time timestamp, end_time timestamp, execution_s double, duration_s double, result_state string, input_rows long")
    got = B.detect_runtime_regressions(df, segment=200)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, B.detect_runtime_regressions(df).collect()), key=repr)
    assert folded[0] == 200 + 4 * 40 and folded[1] == 800 and B.SEGMENT <= 50_000


def test_samples_of_bands_and_metrics_are_made_in_one_stream(spark, monkeypatch):
    """the second sample was made of the rows of the first, so that the runs were read over and over, and lists of values were dealt anew."""
    from opsloom.functions import ordered as O

    monkeypatch.setattr(O, "SLICE_DAYS", 3)
    rnd = random.Random(5)
    start = [datetime(2026, 1, 1) + timedelta(minutes=rnd.randint(0, 60_000)) for _ in range(700)]
    rows = [(f"r{i:03}", rnd.choice(["a", "a", "b"]), s, rnd.choice([None, s, s + timedelta(minutes=rnd.randint(-2, 3000)), s + timedelta(minutes=9)]), rnd.choice([None, float(rnd.randint(1, 400))]), rnd.choice([None, 50.0, 90.0]), rnd.choice([None, 0, 7, 7, 7, 100]), rnd.choice(["SUCCESS", "SUCCESS", "SUCCESS", "FAILED"])) for i, s in enumerate(start)]
    runs = spark.createDataFrame(rows, "run_id string, job_id string, start_time timestamp, end_time timestamp, execution_s double, duration_s double, input_rows long, result_state string")
    excluded = [r[0] for r in rows if int(r[0][1:]) % 9 < 2]
    regimes = spark.createDataFrame([("b", datetime(2026, 1, 20))], "job_id string, regime_start timestamp")
    df = B.banded_baseline(runs, excluded=spark.createDataFrame([(x,) for x in excluded * 2], "run_id string"), regimes=regimes)
    got = {r.run_id: (r["sample"], r.n, r.band_fallback) for r in df.collect()}

    shaped = [(r[0], r[1], r[2], r[3], "total" if r[4] is None else "execution", r[5] if r[4] is None else r[4], r[6].bit_length() - 1 if r[6] else None, r[7]) for r in rows]
    good = [r for r in shaped if r[7] == "SUCCESS" and r[5] is not None and r[3] is not None and r[0] not in excluded and (r[1] != "b" or r[2] >= datetime(2026, 1, 20))]
    for run, job, begun, end, metric, _, band, _ in shaped:
        instant = end is not None and end <= begun
        limit = (end, 0, run) if instant else (begun, 1, run)
        past = sorted((g for g in good if g[1] == job and g[4] == metric and (g[3], 0, g[0]) < limit), key=lambda g: (g[3], g[0]), reverse=True)
        same = [g[5] for g in past if g[6] == band][:20]
        use = band is not None and len(same) >= 5
        sample = same if use else [g[5] for g in past][:20]
        assert got[run] == (sample, len(sample), band is not None and not use)
    assert len(got) == len(rows) and len({f for _, _, f in got.values()}) == 2

    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 16


@pytest.mark.parametrize(("block", "few", "odd"), [(3, 0, True), (3, 100, False), (1000, 100, True)])
def test_changes_of_a_window_are_placed_without_a_sort(spark, monkeypatch, block, few, odd):
    """all pairs of a run and a commit went through a shuffle and a sort, which filled the disk; now a row's place is counted."""
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "FEW", few)
    rnd = random.Random(block + few)
    at = lambda: T0 + timedelta(hours=rnd.choice([rnd.randint(0, 500), 24 * rnd.randint(0, 9)]))
    sha = lambda *more: rnd.choice(["s1", "s1", *[f"s{k}" for k in range(2, 9)], *more])
    ids = [rnd.choice([f"r{i}", f"r{i}", "twice", None]) if odd else f"r{i}" for i in range(120)]
    runs = [(r, rnd.choice(["a", "a", "b", "c", "d", None]), sha(None, "gone"), rnd.choice([None, *[at() for _ in range(9)]]), rnd.choice([None, None, at()])) for r in ids]
    commits = [(rnd.choice(["a", "a", "b", "e", None]), sha(), rnd.choice([None, *[at() for _ in range(9)]])) for _ in range(300)]
    commits += [("c", sha(None) if odd else "s1", at()) for _ in range(40)]
    df = I.changes_in_window(
        spark.createDataFrame(runs, "run_id string, job_id string, git_sha string, start_time timestamp, healthy_end timestamp"),
        spark.createDataFrame(commits, "job_id string, sha string, committed_at timestamp"),
    )
    met = {}
    for run, job, own, start, healthy in runs:
        if start is not None and job is not None:
            since = healthy or start - timedelta(days=7)
            place = lambda s: 2 if own is None or s is None else int(s != own)  # noqa: B023, E731
            met.setdefault(run, []).extend((place(s), -(c - T0).total_seconds(), s or "", s) for j, s, c in commits if j == job and c is not None and since < c <= start)
    want = [(run, m[3], n + 1) for run, rows in met.items() for n, m in enumerate(sorted(rows, key=lambda m: m[:3]))]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and len(want) > 1000
    assert ("twice" in met) == odd
    if not odd:
        above = df._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
        assert "Exchange" not in above and "Window" not in above
