"""Exact quantiles of many groups without gathering, or sorting, a group's values.

A sketch that is merged map-side gives two values between which a wanted rank must lie; the values between them, counted
by value, and the count below them give the rank itself. A group of any size sends about ``6 / ACCURACY`` of its values on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relative accuracy of the sketch, and values of a group that are ranked without one.
ACCURACY, SMALL = 10_000, 50_000
#: Position of a quantile among n sorted values (from 1): both ends included, or the exclusive method.
INCLUSIVE, EXCLUSIVE = "inclusive", "exclusive"


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """keys, n (values that are not null) and a column for each name of ``wanted``: name -> (probability, method).

    Between two ranks the value is interpolated. Groups without a value are left out; without keys there is one row,
    if any value is there.
    """
    names = keys or ["_all"]
    base = rows.filter(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    ends = [min(1.0, max(0.0, p + side * 3 / ACCURACY)) for p, _ in wanted.values() for side in (-1, 1)]
    sketch = base.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e"))
    n, small = F.col("n"), F.col("n") <= SMALL
    each = []
    for i, (p, method) in enumerate(wanted.values()):
        at = (1 + p * (n - 1)) if method == INCLUSIVE else p * (n + 1)
        low = F.greatest(F.least(F.floor(at), n - 1), F.lit(1))
        part = F.when(n == 1, F.lit(0.0)).otherwise(at - low)
        under = F.when(small | F.lit(p <= 3 / ACCURACY), F.lit(float("-inf"))).otherwise(F.col("_e")[2 * i])
        over = F.when(small | F.lit(p >= 1 - 3 / ACCURACY), F.lit(float("inf"))).otherwise(F.col("_e")[2 * i + 1])
        each.append(F.struct(F.lit(i).alias("q"), low.cast("long").alias("low"), part.cast("double").alias("part"), under.alias("under"), over.alias("over")))
    brackets = sketch.select(*names, "n", F.explode(F.array(*each)).alias("_b")).select(*names, "n", "_b.*")
    met = base.join(brackets, names).filter(F.col("_v") <= F.col("over"))
    inside = F.when(F.col("_v") >= F.col("under"), F.col("_v"))  # what lies below counts as one value
    counted = met.groupBy(*names, "n", "q", "low", "part", inside.alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*names, "q").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counted.withColumn("_upto", upto)
    at_rank = lambda r: F.max(F.when((F.col("_upto") >= r) & (F.col("_upto") - F.col("c") < r), F.col("_v")))
    picked = ranked.groupBy(*names, "n", "q", "part").agg(at_rank(F.col("low")).alias("a"), at_rank(F.col("low") + 1).alias("b"))
    found = picked.withColumn("_x", F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a"))))
    return found.groupBy(*names, "n").agg(*[F.max(F.when(F.col("q") == i, F.col("_x"))).alias(name) for i, name in enumerate(wanted)]).drop("_all")
