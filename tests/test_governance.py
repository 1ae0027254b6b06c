"""Changed files and their assets, incidents after changes, secret patterns: against plain restatements."""

import random
from datetime import datetime, timedelta

import pytest

from opsloom.operators import governance as G
from opsloom.operators import incidents as I


def test_files_and_paths(spark):
    """A file stands for a path if it ends with it, whatever stands before, or has the same last part."""
    rnd = random.Random(5)
    part = lambda: rnd.choice(["a", "b", "daily", "xdaily", "daily.py", "x.py", "sales", "", "é"])
    path = lambda: "/".join(part() for _ in range(rnd.randint(1, 4)))
    files = [(f"c{k % 40}", path()) for k in range(150)] + [("n", None), ("s", "src/jobs/sales/daily.py")]
    sources = [(path(), f"t{k}") for k in range(80)] + [(None, "never"), ("sales/daily.py", "one"), ("jobs/sales/daily.py", "two"), ("aily.py", "three"), ("other/daily.py", "four"), ("sales/daily.sql", "five"), ("", "all")]
    got = {(r.sha, r.asset) for r in G.assets_for_change(spark.createDataFrame(files, "sha string, file string"), spark.createDataFrame(sources, "path string, asset string")).collect()}
    want = {(sha, asset) for sha, f in files for p, asset in sources if f is not None and p is not None and (f == p or f.endswith(p) or f.split("/")[-1] == p.split("/")[-1])}
    assert got == want
    assert {a for s, a in got if s == "s"} >= {"one", "two", "three", "four", "all"} and ("s", "five") not in got and not any(a == "never" for _, a in got)


def test_incidents_after_changes(spark):
    rnd = random.Random(6)
    start = datetime(2026, 1, 1)
    at = lambda: start + timedelta(hours=rnd.randint(-2000, 2000))
    touched = [(f"a{rnd.randint(0, 9)}", at()) for _ in range(60)] + [("a1", None), ("edge", start), ("edge", start)]
    incidents = [(f"a{rnd.randint(0, 11)}", f"i{k}", at()) for k in range(200)] + [("a1", "never", None)]
    incidents += [("edge", "same", start), ("edge", "last", start + timedelta(days=14)), ("edge", "late", start + timedelta(days=14, seconds=1)), ("edge", "before", start - timedelta(seconds=1))]
    t, i = spark.createDataFrame(touched, "asset string, committed_at timestamp"), spark.createDataFrame(incidents, "asset string, incident_id string, detected_at timestamp")
    got = {(r.asset, r.incident_id) for r in G.incidents_after_changes(t, i).collect()}
    assert got == {(a, k) for a, k, d in incidents for b, c in touched if a == b and c is not None and d is not None and timedelta(0) <= d - c <= timedelta(days=14)}
    assert {k for a, k in got if a == "edge"} == {"same", "last"}


@pytest.mark.parametrize("many", [1, 2, 3, 50])
def test_history_counts_no_further_than_it_matters(spark, many):
    """One incident on two assets counts once; an asset's incidents beyond the third change nothing."""
    now = datetime(2026, 1, 1)
    ca = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "sha string, asset string")
    changes = spark.createDataFrame([("c", now), ("d", now)], "sha string, committed_at timestamp")
    inc = spark.createDataFrame([(a, f"i{k}", now) for k in range(many) for a in "xy"], "asset string, incident_id string, detected_at timestamp")
    assert {r.sha: r.history for r in G.history_score(ca, changes, inc).collect()} == {"c": pytest.approx(min(1, many / 3)), "d": 0.0}


def test_secret_patterns(spark):
    hits = {"aws_access_key": "AKIA" + "A1" * 8, "private_key": "-----BEGIN EC PRIVATE KEY-----", "databricks_token": "dapi" + "0a" * 16, "generic_secret": "Token: 'two words here'"}
    misses = ["AKIA" + "a1" * 8, "-----BEGIN ec PRIVATE KEY-----", "dapi" + "0g" * 16, "token: 'seven77'", "token: two words here", None, ""]
    rows = [(k, t) for k, t in hits.items()] + [(f"no{i}", t) for i, t in enumerate(misses)]
    df = spark.createDataFrame(rows, "sha string, text string")
    found = {(r.sha, r.pattern, r.severity, r.masked) for r in G.secret_findings(df).collect() if r.pattern != "entropy"}
    assert found == {(k, k, "média" if k == "generic_secret" else "alta", t[:4] + "***") for k, t in hits.items()}
    own = {(r.sha, r.pattern, r.severity, r.masked) for r in G.secret_findings(df, patterns=[("seven", "seven77", "alta")], shown=2, least_bits=9.0).collect()}
    assert own == {("no3", "seven", "alta", "se***")}


def test_join_is_a_word(spark):
    rows = [("a", "+x.join(y)"), ("b", "+joined_at = 1"), ("c", "+rejoin()"), ("d", "+LEFT JOIN t"), ("e", "+join_key"), ("f", None), ("g", "+ window"), ("h", "-f(partitionby)")]
    df = spark.createDataFrame([(i, p, None, None, None, None, None, False) for i, p in rows], "incident_id string, patch string, skew_ratio double, new_operators array<string>, input_rows double, healthy_rows double, env_changed boolean, has_change boolean")
    assert {r.incident_id for r in I.runtime_hypotheses(df).collect()} == {"a", "d", "g", "h"}
