"""Figures of the event pipeline out of mergeable sketches: stored a window, merged over any span.

A window keeps counts, a HyperLogLog sketch of the ids and a KLL sketch of the lags. Windows of a day, a week or of several
streams are merged without going back to the events. The same aggregation runs over a table and over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of the id sketch; size of the lag sketch.
LG_K, KLL_K = 14, 800


def lag_s(arrived: Column, time: Column) -> Column:
    """Seconds from an event to its arrival."""
    return arrived.cast("timestamp").cast("double") - time.cast("timestamp").cast("double")


def window_sketches(events: DataFrame, valid: Column, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, type, events, rejected, ids and lags (sketches of accepted events) a window and type.

    ``events`` has id, type, time, arrived; ``valid`` says what is accepted, null is rejected. With ``late`` the events are a
    stream whose windows close at that watermark. An event without a time is in no window (of a stream as of a table).
    """
    ok = F.coalesce(valid, F.lit(False))
    rows = events.select(F.col("id").cast("string").alias("id"), "type", "time", "arrived", ok.alias("_ok"))
    if late:
        rows = rows.withWatermark("time", late)
    lag = F.when(F.col("_ok"), lag_s(F.col("arrived"), F.col("time")))
    out = rows.groupBy(F.window("time", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("_ok")).alias("rejected"), F.hll_sketch_agg(F.when(F.col("_ok"), F.col("id")), F.lit(LG_K)).alias("ids"), F.kll_sketch_agg_double(lag, F.lit(KLL_K)).alias("lags"))
    return out.select(F.col("w.start").alias("start"), "type", "events", "rejected", "ids", "lags")


def rejected_rows(events: DataFrame, valid: Column) -> DataFrame:
    """The side output: events that are not accepted."""
    return events.filter(~F.coalesce(valid, F.lit(False)))


def merged(windows: DataFrame, keys: list[str], quantile: float = 0.95) -> DataFrame:
    """keys, events, rejected, rejection_rate, distinct_ids, duplicate_rate, lag_s over all windows of a key."""
    g = windows.groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("rejected").alias("rejected"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("distinct_ids"), F.kll_merge_agg_double("lags").alias("_l"))
    accepted = F.col("events") - F.col("rejected")
    g = g.withColumns({"rejection_rate": F.col("rejected") / F.col("events"), "duplicate_rate": F.when(accepted > 0, F.greatest(1 - F.col("distinct_ids") / accepted, F.lit(0.0)))})
    return g.withColumn("lag_s", F.when(accepted > 0, F.kll_sketch_get_quantile_double("_l", F.lit(quantile)))).drop("_l")


def backlog(rejected: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, depth: rejected events (id) that nothing has settled."""
    return rejected.join(settled.select("id").distinct(), "id", "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"))
