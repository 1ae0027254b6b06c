"""Contract evaluation: isolation of broken rules, samples against brute force, one scan an asset."""

import hashlib
import random
from datetime import datetime

import pytest

from opsloom.operators import contracts as C

DDL = "contract_id string, status string, asset string, rule_id string, kind string, column string, argument string, threshold string, severity string, window string"
NOW = datetime(2026, 1, 2)


def declared(spark, *rules):
    """(rule, kind, column, argument, threshold) of one active contract of the asset t."""
    return spark.createDataFrame([("c", "active", "t", *r, "high", None) for r in rules], DDL)


def run(spark, rules, tables, **more):
    return {r.rule_id: r for r in C.run_contracts(declared(spark, *rules), tables, NOW, **more).collect()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    return [(i, rnd.choice([None, *range(12)]), rnd.choice(["a1", "b2", "xx", None])) for i in range(500)] + [(1000, 99, "copy")] * 3000


@pytest.fixture(scope="module")
def t(spark, rows):
    return spark.createDataFrame(rows, "id long, k int, s string")


def smallest(ids, n=5):
    return [i for _, i in sorted({(hashlib.md5(i.encode()).hexdigest()[:15], i) for i in ids})][:n]


def test_counts_and_samples(spark, t, rows):
    parent = spark.createDataFrame([(float(k),) for k in range(10)] + [(3.0,), (None,)], "key double")
    rules = [("null_k", "completeness", "k", "", "<=0%"), ("low", "range", "k", "..5", "<=50%"), ("form", "regex", "s", "[a-z][0-9]", "<=10%"), ("one", "uniqueness", "k", "", "<=0%"), ("ids", "uniqueness", "id", "", "<=0%"), ("par", "referential", "k", "p.key", "<=1%"), ("good", "validity", "", "id >= 0", "<=0%")]
    got = run(spark, rules, {"t": t, "p": parent}, identity={"t": ["id"]})
    bad = {"null_k": [r for r in rows if r[1] is None], "low": [r for r in rows if r[1] is not None and r[1] > 5], "form": [r for r in rows if r[2] in ("xx", "copy")], "good": []}
    for name, some in bad.items():
        assert got[name].numerator == len(some) and got[name].denominator == len(rows)
        assert (got[name].sample_keys or []) == smallest([str(r[0]) for r in some])
    assert got["good"].status == "passed" and got["form"].status == "violated" and got["null_k"].status == "violated"
    assert got["one"].numerator == len(rows) and got["ids"].numerator == 3000 and got["ids"].sample_keys == ["1000"]
    assert got["par"].numerator == sum(r[1] is None or r[1] >= 10 for r in rows)
    assert '"id":' in got["low"].sample[0] and got["ids"].sample == ['{"key":"1000","n":3000}']
    assert all(r.severity == "high" and len(r.query_hash) == 16 and r.evaluated_at == NOW for r in got.values())


def test_copies_do_not_hide_other_violations(spark, t, rows, monkeypatch):
    """The bound on the hash rises until enough different rows are found, or all are."""
    monkeypatch.setattr(C, "DRAWN", 1)
    got = run(spark, [("all", "validity", "", "id < 0", "<=0%"), ("two", "validity", "", "id not in (1, 1000)", "<=0%")], {"t": t}, identity={"t": ["id"]})
    assert got["all"].sample_keys == smallest([str(r[0]) for r in rows]) and set(got["two"].sample_keys) == {"1", "1000"}


def test_broken_rules_stand_alone(spark, t):
    broken = [("no_table", "referential", "k", "q.key", "<=0%"), ("no_key", "referential", "k", "p.nope", "<=0%"), ("no_column", "completeness", "nope", "", "<=0%"), ("no_sql", "validity", "", "k >", "<=0%"), ("no_bool", "validity", "", "k + 1", "<=0%"), ("aggregate", "validity", "", "sum(k) > 1", "<=0%")]
    broken += [("late", "validity", "", "cast(s as int) > 0", "<=0%"), ("late_too", "range", "1 / (k - k)", "0..1", "<=0%"), ("no_range", "range", "k", "low..high", "<=0%"), ("empty", "completeness", " ", "", "<=0%"), ("kind", "magic", "k", "", "<=0%"), ("bad_custom", "custom", "", "sum(nope)", "<=0%"), ("no_time", "freshness", "", "", "1h"), ("limit", "completeness", "k", "", "some")]
    good = [("fine", "completeness", "id", "", "<=0%"), ("fine_too", "custom", "", "count_if(k is null)", "<=99%"), ("also", "uniqueness", "id", "", "<=100%"), ("rows", "volume", "", "", "0.5")]
    parent = spark.createDataFrame([(1,)], "key int")
    got = run(spark, [*broken, *good], {"t": t, "p": parent})
    assert len(got) == len(broken) + len(good)
    assert all(got[r[0]].status == "evaluation_error" and got[r[0]].error_message for r in broken), {r[0]: got[r[0]] for r in broken if got[r[0]].status != "evaluation_error"}
    assert all(got[r[0]].status == "passed" and got[r[0]].error_message is None for r in good)
    assert len(got["no_column"].error_message) <= C.MOST_ERROR_CHARS
    lost = C.run_contracts(spark.createDataFrame([("c", "active", "u", "r", "completeness", "x", "", "<=0%", "info", "day"), ("d", "draft", "t", "r", "completeness", "x", "", "<=0%", "info", "day")], DDL), {"t": t}, NOW).collect()
    assert [(r.contract_id, r.status, r.window) for r in lost] == [("c", "evaluation_error", "day")]


def test_rules_of_metadata(spark, t):
    columns = spark.createDataFrame([("c", "ID", "long"), ("c", "s", "varchar(10)"), ("other", "x", "int")], "contract_id string, column_name string, data_type string")
    writes = spark.createDataFrame([("t", datetime(2026, 1, 1, 12)), ("t", datetime(2025, 1, 1)), ("u", NOW)], "asset string, timestamp timestamp")
    history = spark.createDataFrame([("t", "rows", n, "passed", k, str(k)) for k, n in enumerate([1, 10**6, 10**6, 10**6])] + [("t", "rows", 0, "evaluation_error", 9, "9")], "asset string, rule_id string, numerator long, status string, evaluated_at int, result_id string")
    rules = [("shape", "schema", "", "", ""), ("now", "freshness", "", "", "<=12h"), ("late", "freshness", "", "", "11h"), ("rows", "volume", "", "", "0.5"), ("new", "volume", "", "", "0.5"), ("bad", "volume", "", "", "half")]
    got = run(spark, rules, {"t": t}, columns=columns, writes=writes, history=history)
    assert (got["shape"].status, got["shape"].numerator, got["shape"].denominator, got["shape"].detail) == ("passed", 2, 2, "new: k")
    assert (got["now"].status, got["now"].numerator, got["late"].status) == ("passed", 43200, "violated")
    assert (got["rows"].status, got["new"].status, got["bad"].status) == ("violated", "passed", "evaluation_error") and got["rows"].numerator == 3500
    none = run(spark, [("shape", "schema", "", "", "")], {"t": t})
    assert none["shape"].status == "passed" and none["shape"].detail == "no columns declared"


def test_empty_table_and_no_rules(spark, t):
    got = run(spark, [("a", "completeness", "k", "", "<=0%"), ("b", "uniqueness", "k", "", "<=0%"), ("c", "referential", "k", "t.k", "<=0%")], {"t": t.limit(0)})
    assert {(r.status, r.numerator, r.denominator) for r in got.values()} == {("passed", 0, 0)}
    assert C.run_contracts(spark.createDataFrame([], DDL), {}, NOW).collect() == []


def test_one_scan_for_all_rules(spark, t, tmp_path):
    t.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    rules = [C.Rule(r) for r in declared(spark, ("a", "completeness", "k", "", ""), ("b", "validity", "", "k > 1", ""), ("c", "uniqueness", "id", "", ""), ("d", "uniqueness", "k", "", "")).collect()]
    for r in rules:
        C.planned(r, {"t": df})
    plan = C.long_form(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "s#" not in plan.split("ReadSchema")[1]
