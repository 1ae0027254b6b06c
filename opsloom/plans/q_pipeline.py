"""Figures of the event pipeline from sketches, within their bounds of the exact ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.plans.fixtures import table
from opsloom.registry import query
from opsloom.streaming import metrics as M

_EVENTS = """WITH e AS (SELECT event_id, event_type AS type, ts, event_id % 60 + CASE WHEN event_id % 50 = 0 THEN 600 ELSE 0 END AS lag, event_id % 11 = 0 AS bad FROM events UNION ALL SELECT event_id, event_type, ts, event_id % 60 + CASE WHEN event_id % 50 = 0 THEN 600 ELSE 0 END, event_id % 11 = 0 FROM events WHERE event_id % 7 = 0)"""


def _delivered(spark, sf_dir):
    """Events with their arrival; every seventh comes twice, every eleventh has no valid payload."""
    e = table(spark, sf_dir, "events")
    e = e.unionByName(e.filter("event_id % 7 = 0"))
    return e.selectExpr("event_id id", "event_type type", "ts time", "ts + interval '1' second * cast(event_id % 60 + case when event_id % 50 = 0 then 600 else 0 end as int) arrived", "case when event_id % 11 <> 0 then 'payload' end data")


@query(_EVENTS + " SELECT type, count(*) AS events, count(CASE WHEN bad THEN 1 END) AS rejected, round(count(CASE WHEN bad THEN 1 END) / count(*), 8) AS rejection_rate, true AS ids_in_bound, true AS duplicates_in_bound, true AS lag_in_bound FROM e GROUP BY type")
def pipeline_figures(spark, sf_dir):
    """Sketches of hours merged a type; ids within 3 %, the p95 lag between the exact p93 and p97."""
    e = _delivered(spark, sf_dir)
    valid = F.col("data").isNotNull()
    got = M.merged(M.window_sketches(e, valid), ["type"])
    lag = M.lag_s(F.col("arrived"), F.col("time"))
    exact = e.filter(valid).groupBy("type").agg(F.countDistinct("id").alias("d"), F.count(F.lit(1)).alias("n"), F.percentile(lag, F.lit(0.93)).alias("lo"), F.percentile(lag, F.lit(0.97)).alias("hi"))
    both = got.join(exact, "type")
    return both.select(
        "type", "events", "rejected", F.round("rejection_rate", 8).alias("rejection_rate"), (F.abs(F.col("distinct_ids") - F.col("d")) <= 0.03 * F.col("d")).alias("ids_in_bound"),
        (F.abs(F.col("duplicate_rate") - (1 - F.col("d") / F.col("n"))) <= 0.03).alias("duplicates_in_bound"), F.col("lag_s").between(F.col("lo"), F.col("hi")).alias("lag_in_bound"))


@query(_EVENTS + " SELECT type, CAST(date_trunc('day', ts) AS string) AS day, count(*) AS depth FROM e WHERE bad AND event_id % 3 <> 0 GROUP BY 1, 2")
def dead_letter_depth(spark, sf_dir):
    """Rejected events a type and day that no replay has settled."""
    bad = M.rejected_rows(_delivered(spark, sf_dir), F.col("data").isNotNull()).withColumn("day", F.date_trunc("day", "time").cast("string"))
    return M.backlog(bad, bad.filter("id % 3 = 0"), ["type", "day"])
