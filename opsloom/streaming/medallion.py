"""The medallion streams as Structured Streaming jobs, and the regression fold as a stateful stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators import ingest

OBSERVATION_SCHEMA = "id string, type string, subject string, time timestamp, data string"


def observations(spark: SparkSession, path: str, schema: str = OBSERVATION_SCHEMA) -> DataFrame:
    """A stream over a folder of Parquet drops."""
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to a Parquet table, then stop; files seen before are not read again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drain_each(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """The same with a function for each micro-batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def streams(source: DataFrame) -> dict[str, DataFrame]:
    """The three typed streams of an observation stream."""
    return {"runs": ingest.runs(source), "run_timings": ingest.run_timings(source), "changes": ingest.changes(source)}


def deduplicated(stream: DataFrame, key: str = "id", time: str = "time", late: str = "1 hour") -> DataFrame:
    """Insert-once on a key within a watermark; the state forgets keys that are later than it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def pipeline_metrics(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Windowed throughput, distinct ids and mean lag of an observation stream with time and arrived."""
    lag = F.col("arrived").cast("timestamp").cast("double") - F.col("time").cast("timestamp").cast("double")
    return stream.withWatermark("time", late).groupBy(F.window("time", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("id").alias("ids"), F.avg(lag).alias("lag_s"))


def regressions(runs: DataFrame, floor: float = 30.0, longest: str | None = None) -> DataFrame:
    """Verdicts of a stream of runs by the sequential rule.

    The state of a job is (end, value) of its eligible runs by metric and band. With ``longest`` (an interval that no run
    exceeds, such as "2 days") the state forgets what no later run can see; without it the whole history is kept.
    Runs of a job have to arrive in the order of their ends from one micro-batch to the next.
    """
    import pickle

    import pandas as pd

    from opsloom.operators.baselines import FOLD_SCHEMA, fold_job, forget, plain_rows

    names = [c.split()[0] for c in FOLD_SCHEMA.split(", ")]
    span = pd.Timedelta(longest) if longest else None

    def step(key, batches, state):
        history = pickle.loads(state.get[0]) if state.exists else {}
        rows = plain_rows(pd.concat(list(batches)).sort_values(["end_time", "run_id"]))
        out = fold_job(rows, floor=floor, history=history)
        ends = [r["end_time"] for r in rows if r["end_time"] is not None]
        if span is not None and ends:
            forget(history, ends[-1] - span)
        state.update((pickle.dumps(history),))
        yield pd.DataFrame(out, columns=names)

    from opsloom.functions.columns import volume_band

    df = runs.withColumn("band", volume_band(F.col("input_rows"))).select("run_id", "job_id", "start_time", "end_time", "execution_s", "duration_s", "result_state", "band")
    return df.groupBy("job_id").applyInPandasWithState(step, FOLD_SCHEMA, "known binary", "append", "NoTimeout")
