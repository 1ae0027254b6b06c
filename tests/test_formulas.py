"""Formulas of named aggregations: a small corpus of sources labelled by hand."""

import pytest

from opsloom.functions.formulas import declared_hash, formula_hash, metrics_of
from opsloom.operators.knowledge import observed_metrics

HEAD = "import pyspark.sql.functions as F\nfrom pyspark.sql import Window\nKEY = 'id'\nRATE = 2\n"


def of(body, head=HEAD):
    return metrics_of(head + "def build(df, flag, rate, keys):\n" + "".join(f"    {x}\n" for x in body.split("\n")))


@pytest.mark.parametrize(
    ("body", "status", "same_as"),
    [
        ("return df.groupBy('d').agg(F.countDistinct(KEY).alias('m'))", "extraida", "countDistinct('id')"),
        ("return df.groupBy('d').agg(F.countDistinct(F.col('id')).alias('m'))", "extraida", "F.countDistinct('id')"),
        ("return df.agg(F.sum(F.col('a') * RATE).alias('m'))", "extraida", "sum(F.col('a') * 2)"),
        ("return df.agg(F.sum(F.col('a') * rate).alias('m'))", "parcial", None),
        ("return df.agg(F.max(F.row_number().over(Window.partitionBy('k'))).alias('m'))", "parcial", None),
        ("df = df.withColumn('x', F.col('a') - F.col('b'))\nreturn df.agg(F.sum('x').alias('m'))", "extraida", "sum(F.col('a') - F.col('b'))"),
        ("df = df.withColumn('x', F.col('a')).withColumn('y', F.col('x') + 1).withColumn('z', F.col('y'))\nreturn df.agg(F.sum('z').alias('m'))", "extraida", "sum(F.col('a') + 1)"),
        ("df = df.withColumn('x', F.col('x') + 1)\nreturn df.agg(F.sum('x').alias('m'))", "extraida", "sum(F.col('x') + 1 + 1 + 1)"),
        ("df = df.withColumn('x', F.lit(1)) if flag else df.withColumn('x', F.lit(2))\nreturn df.agg(F.sum('x').alias('m'))", "ambigua", None),
        ("df = df.withColumn('x', F.lit(1)) if flag else df.withColumn('x', F.lit(1))\nreturn df.agg(F.sum('x').alias('m'))", "extraida", "sum(lit(1))"),
        ("df = df.withColumn('x', F.lit(1)) if flag else df.withColumn('x', F.lit(2))\nreturn df.agg(F.sum('other').alias('m'))", "extraida", "sum('other')"),
        ("return df.groupBy(*keys).agg(F.sum('a').alias('m'))", "nao_extraivel", None),
        ("return df.groupBy(KEY).agg(F.sum('a').alias('m'))", "nao_extraivel", None),
        ("return df.groupBy('k').pivot('p').agg(F.sum('a').alias('m'))", "extraida", "sum('a')"),
    ],
)
def test_states(body, status, same_as):
    (m,) = of(body)
    assert (m.metric_id, m.status) == ("m", status), m
    assert (m.canonical is None) == (status in ("ambigua", "nao_extraivel")) and bool(m.detail) == (status != "extraida")
    if same_as:
        assert formula_hash(m.canonical) == declared_hash(same_as)


def test_different_formulas_differ():
    """A method's receiver is part of its meaning, and values count, not the names of constants."""
    pairs = [("F.max(F.row_number().over(w))", "F.max(F.sum('x').over(w))"), ("F.sum('a')", "F.avg('a')"), ("F.sum(F.col('a') + 'b')", "F.sum(F.col('b') + 'a')"), ("F.sum('a')", "sum(a)"), ("F.sum(1)", "F.sum('1')"), ("F.f('a', 'b')", "F.f('a b')"), ("F.f(x='a')", "F.f(y='a')"), ("F.f([1], 2)", "F.f([1, 2])")]
    assert all(declared_hash(a) != declared_hash(b) for a, b in pairs)
    a, b = (metrics_of(f"K = '{k}'\ndef f(df):\n    return df.agg(F.countDistinct(K).alias('m'))\n")[0].canonical for k in "xy")
    assert a != b and declared_hash("F.sum(") is None


def test_scopes_grain_and_lines():
    code = "LOCAL = 1\ndef one(df):\n    LOCAL = 2\n    return df.withColumn('n', F.col('a'))\ndef two(df):\n    return (df.groupBy('b', 'a')\n        .agg(F.sum(LOCAL).alias('m'), F.max('q'), F.sum('n').alias('k')))\nx.agg(F.sum('a').alias('outside'))\n"
    got = metrics_of(code)
    assert [(m.metric_id, m.grain, m.line, m.status) for m in got] == [("m", "b,a", 7, "extraida"), ("k", "b,a", 7, "extraida")]
    assert got[0].canonical == "sum(1|)" and got[1].canonical == "sum('n'|)"
    assert metrics_of("def f(:")[0][1:6] == ("", None, "", 0, "nao_extraivel") and metrics_of("") == [] and metrics_of("spark.sql('select 1')") == []


def test_corpus(spark):
    files = spark.createDataFrame([("a", HEAD + "def f(df):\n    return df.agg(F.sum('x').alias('m'))\n"), ("b", None), ("c", "def ("), ("d", "x\x00")], "path string, value string")
    assert sorted((r.path, r.metric_id, r.extraction_status, r.formula_hash is None) for r in observed_metrics(files).collect()) == [("a", "m", "extraida", False), ("c", "", "nao_extraivel", True), ("d", "", "nao_extraivel", True)]
