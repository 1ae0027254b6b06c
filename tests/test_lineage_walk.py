"""Best paths over random graphs against exhaustive search, and what a hop sends on."""

import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import lineage as L

DDL = "source string, target string, entity_type string, entity_id string, weight double"


def every_path(edges, origin, depth, least=0.0):
    """Best (score, fewest hops) to each node, trying every path of at most ``depth`` edges."""
    out = {}

    def walk(node, score, hops):
        if hops == depth:
            return
        for s, t, _, _, w in edges:
            if s == node and t != origin and score * w * L.DECAY >= least:
                found = (round(score * w * L.DECAY, 12), -(hops + 1))
                out[t] = max(out.get(t, (0.0, 0)), found)
                walk(t, score * w * L.DECAY, hops + 1)

    walk(origin, 1.0, 0)
    return {n: (round(s, 6), -h) for n, (s, h) in out.items()}


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_against_every_path(spark, depth):
    rnd = random.Random(depth)
    nodes = [f"n{i}" for i in range(9)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes), rnd.choice(["job", "dashboard", ""]), str(i), rnd.choice([0.05, 0.3, 0.8, 1.0])) for i in range(30)]
    df, origins = spark.createDataFrame(edges, DDL), spark.createDataFrame([(n,) for n in nodes], "origin string")
    for least in (0.0, 0.02):
        got = {}
        for r in L.traverse(df, origins, depth=depth, least=least).collect():
            got.setdefault(r.origin, {})[r.node] = (r.score, r.hops)
        for n in nodes:
            assert got.get(n, {}) == every_path(edges, n, depth, least)


def test_a_longer_path_that_is_no_better_is_not_followed(spark):
    """In a ladder of two rungs a node the number of paths doubles each hop; what goes on does not."""
    edges = [(f"n{i}", f"n{j}", "job", "x", 0.5 if j > i + 1 else 1.0) for i in range(12) for j in range(i + 1, 12)]
    e = L._usable(spark.createDataFrame(edges, DDL), "down", None)
    level, known, sizes = spark.createDataFrame([("n0", "n0", 1.0)], "origin string, node string, score double"), None, []
    for hop in range(1, 6):
        level = L.expand(level, known, e, hop)
        known = level if known is None else known.unionByName(level)
        sizes.append(level.count())
    assert sizes[0] == 11 and sum(sizes[1:]) == 0  # one hop of half weight is as good as two of full weight


def test_star_of_a_hub(spark):
    """A hub's edges are met once an origin, and nothing more is sent on in later hops."""
    star = spark.range(20_000).select(F.lit("hub").alias("source"), F.concat(F.lit("leaf"), "id").alias("target"), F.lit("job").alias("entity_type"), F.lit("").alias("entity_id"), F.lit(1.0).alias("weight"))
    into = spark.createDataFrame([("a", "hub", "job", "", 1.0), ("b", "hub", "job", "", 1.0)], DDL)
    reached = L.traverse(star.unionByName(into), spark.createDataFrame([("a",), ("b",)], "origin string"))
    assert {r.origin: (r.assets, r.impact_score) for r in L.impact_score(reached).collect()} == {"a": (20_001, 5000.5), "b": (20_001, 5000.5)}


def test_excluded_by_the_end_of_a_name(spark):
    edges = [("a", "x.tmp", "job", "", 1.0), ("x.tmp", "b", "job", "", 1.0), ("a", "c", "job", "", 1.0)]
    got = L.traverse(spark.createDataFrame(edges, DDL), spark.createDataFrame([("a",)], "origin string"), excluded=[".tmp", ""])
    assert [r.node for r in got.collect()] == ["c"]
