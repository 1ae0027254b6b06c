"""Run features as a stream: runs joined with their timing and profile as those arrive, or without once they cannot any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _side(df: DataFrame, at: str, columns: list[str], prefix: str, late: str) -> DataFrame:
    """One row a run of a side stream, with names of its own."""
    one = df.select(F.col("run_id").alias(f"{prefix}run_id"), F.col(at).cast("timestamp").alias(f"{prefix}at"), *columns)
    return one.withWatermark(f"{prefix}at", late).dropDuplicatesWithinWatermark([f"{prefix}run_id"])


def _joined(runs: DataFrame, side: DataFrame, prefix: str, within: str) -> DataFrame:
    """Left join on the run, for side rows at most ``within`` before or after the run's end."""
    near = F.col(f"{prefix}at").between(F.col("end_time") - F.expr(f"INTERVAL {within}"), F.col("end_time") + F.expr(f"INTERVAL {within}"))
    return runs.join(side, (F.col("run_id") == F.col(f"{prefix}run_id")) & near, "leftOuter").drop(f"{prefix}run_id", f"{prefix}at")


def run_features_stream(runs: DataFrame, profiles: DataFrame, timings: DataFrame, late: str = "2 hours", within: str = "1 day") -> DataFrame:
    """The stream of ``ingest.run_features``: runs (run_id, end_time, ...), profiles (run_id, profiled_at, ...), timings (run_id,
    time, setup_s, execution_s).

    A run waits for its timing and profile until the watermark is ``within`` beyond its end and then goes without, so a
    row is sent once. A timing or profile that is later than that, or further away, is not met. A run without an end, which no
    watermark could release, is left out.
    """
    own = [c for c in profiles.columns if c not in runs.columns and c != "profiled_at"]
    r = runs.drop("setup_s", "execution_s").filter("end_time is not null").withWatermark("end_time", late)
    df = _joined(r, _side(timings, "time", ["setup_s", "execution_s"], "_t_", late), "_t_", within)
    df = _joined(df, _side(profiles, "profiled_at", own, "_p_", late), "_p_", within)
    return df.withColumn("input_rows", F.col("left_rows")) if "left_rows" in df.columns else df
