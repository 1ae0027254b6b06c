"""Profiles of data and runs: key distributions, plan operators, timings, producers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import normalized_job

#: Physical operators looked for in a plan's text.
PLAN_OPERATORS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "HashAggregate", "SortAggregate", "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange", "Generate", "Sort")


def key_distribution(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, largest and approximate median key size, skew ratio, hot key and its share.

    Rows are added up a key before anything moves; ties of the hot key go to the smallest key.
    """
    per = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one = per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), F.max("n").alias("max_key_rows"),
        F.greatest(F.percentile_approx("n", 0.5), F.lit(1)).cast("long").alias("median_key_rows"), F.min(F.struct((-F.col("n")).alias("m"), "k")).alias("hot"),
    )
    return one.select("rows", "distinct_keys", "max_key_rows", "median_key_rows", (F.col("max_key_rows") / F.col("median_key_rows")).alias("skew_ratio"), (F.col("max_key_rows") / F.col("rows")).alias("top_key_share"), F.col("hot.k").alias("hot_key"))


def plan_operators(text: Column) -> Column:
    """Sorted distinct operators named in a plan's text."""
    initials = "".join(sorted({name[0] for name in PLAN_OPERATORS}))  # most places of a text begin no name and are passed at once
    pattern = f"(?=[{initials}])(" + "|".join(PLAN_OPERATORS) + ")"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def new_operators(current: Column, healthy: Column) -> Column:
    """Operators that the healthy run did not have; empty when either is missing."""
    return F.coalesce(F.array_sort(F.array_except(current, healthy)), F.array().cast("array<string>"))


def run_timing(tasks: DataFrame) -> DataFrame:
    """run_id, setup_s, execution_s: sums over tasks, null unless every task has its execution time."""
    whole = F.count("execution_ms") == F.count(F.lit(1))
    return tasks.groupBy("run_id").agg(F.when(whole, F.sum("setup_ms") / 1000).alias("setup_s"), F.when(whole, F.sum("execution_ms") / 1000).alias("execution_s"))


def resolve_producer(contracts: DataFrame, jobs: DataFrame) -> DataFrame:
    """contract_id, producer, job_id, reason: exact match on the normalised name; none or several give null and why."""
    by_name = jobs.groupBy(normalized_job(F.col("job_name")).alias("name")).agg(F.array_sort(F.collect_set("job_id")).alias("ids"))
    met = contracts.select("contract_id", "producer", normalized_job(F.col("producer")).alias("name")).join(by_name, "name", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return met.select("contract_id", "producer", F.when(n == 1, F.element_at("ids", 1)).alias("job_id"), F.when(n == 0, F.lit("not_found")).when(n > 1, F.lit("ambiguous")).otherwise(F.lit("resolved")).alias("reason"))


def producer_states(producers: DataFrame, runs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """job_id, succeeded: whether the last run that ended in the window succeeded; no run counts as not."""
    recent = runs.filter((F.col("end_time") > now - F.expr(f"INTERVAL '{hours}' HOUR")) & (F.col("end_time") <= now))
    last = recent.groupBy("job_id").agg(F.max(F.struct("end_time", "run_id", "result_state")).alias("r"))
    return producers.select("job_id").distinct().join(last, "job_id", "left").select("job_id", F.coalesce(F.col("r.result_state") == "SUCCESS", F.lit(False)).alias("succeeded"))


def config_hash(spec: Column) -> Column:
    """Stable hash of a settings struct."""
    return F.sha2(F.to_json(spec).cast("binary"), 256)


def canonical_run(raw: DataFrame) -> DataFrame:
    """Terminal runs with timestamps, seconds and parameters as a map (value, else default)."""
    entry = F.transform("job_parameters", lambda p: F.struct(p["name"].alias("key"), F.coalesce(p["value"], p["default"]).alias("value")))
    done = raw.filter("end_time is not null and end_time > 0 and state.life_cycle_state in ('TERMINATED', 'INTERNAL_ERROR', 'SKIPPED')")
    return done.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("job_id").cast("string").alias("job_id"), F.timestamp_millis("start_time").alias("start_time"), F.timestamp_millis("end_time").alias("end_time"),
        ((F.col("end_time") - F.col("start_time")) / 1000).alias("duration_s"), F.coalesce("state.result_state", F.lit("UNKNOWN")).alias("result_state"), F.map_from_entries(entry).alias("job_parameters"),
    )


def relevant_patch(patch: Column, most: int = 20_000) -> Column:
    """Changed lines that touch joins, windows, partitioning or skew."""
    lines = F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^[+-]") & x.rlike(r"(?i)join|Window|partitionBy|skew"))
    return F.substring(F.array_join(lines, "\n"), 1, most)


def relevant_patch_of_files(files: DataFrame, most: int = 20_000) -> DataFrame:
    """(sha, patch): the relevant lines of a commit's files, each file under its ``--- name`` head, in the order of names.

    ``files`` has sha, file, patch. Tokens are met as they are written; a file without a relevant line is left out.
    """
    lines = F.filter(F.split("patch", "\n"), lambda x: x.rlike(r"^[+-]") & x.rlike(r"join|Window|partitionBy|skew"))
    per = files.select("sha", "file", lines.alias("lines")).filter(F.size("lines") > 0)
    body = F.struct("file", F.concat(F.lit("--- "), F.col("file"), F.lit("\n"), F.array_join("lines", "\n")).alias("text"))
    out = per.groupBy("sha").agg(F.array_sort(F.collect_list(body)).alias("parts"))
    return out.select("sha", F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), 1, most).alias("patch"))
