"""Envelopes, medallion streams, cursors, dead letters, outboxes and snapshots.

Functions take batch or streaming DataFrames where only projections and filters are involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import error_class, uuid5

#: Known observation types.
KNOWN_TYPES = (
    "execution.completed", "execution.timing", "change.committed", "usage.recorded", "lineage.observed", "query.finished",
    "incident.opened", "incident.closed", "profile.taken", "contract.declared", "metric.observed",
)
RUN_SCHEMA = "run_id string, job_id string, job_name string, start_time string, end_time string, duration_s double, result_state string, git_sha string, env_hash string, job_parameters map<string,string>"
TIMING_SCHEMA = "run_id string, job_id string, setup_s double, execution_s double"
CHANGE_SCHEMA = "sha string, repo string, author string, message string, files array<string>, patch string"
#: What a row must satisfy to stay in its stream.
RUN_RULES = {"identity": "run_id is not null and job_id is not null", "duration": "duration_s >= 0"}
TIMING_RULES = {"identity": "run_id is not null", "execution": "execution_s >= 0"}
CHANGE_RULES = {"sha": "sha rlike '^[0-9a-f]{40}$'"}
MAX_ATTEMPTS, RETRY_S, RETRY_CAP_S, ERROR_CHARS = 5, 300, 6 * 3600, 500
OUTBOX_MINUTES = (1, 2, 4, 8, 16)


def envelope(df: DataFrame, source: Column, kind: Column, subject: Column, time: Column, payload: Column, known=KNOWN_TYPES) -> DataFrame:
    """Adds id, content_hash and reject (null when accepted). The id ignores the payload on purpose."""
    name = F.concat_ws("|", source, kind, subject, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    reject = F.when(blank(source), "empty source").when(blank(kind), "empty type").when(blank(subject), "empty subject").when(~kind.isin(*known), "unknown type")
    return df.withColumns({"id": uuid5(name), "content_hash": F.sha2(payload.cast("binary"), 256), "reject": reject})


def parse_observations(df: DataFrame, kind: str, schema: str) -> DataFrame:
    """Payload columns of the observations of one type, with id, subject and time."""
    parsed = df.filter(F.col("type") == kind).select("id", "subject", "time", F.from_json("data", schema).alias("p"))
    return parsed.select("id", F.col("subject").alias("envelope_subject"), "time", "p.*")


def expect_or_drop(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that satisfy every rule; a null answer drops the row."""
    for rule in rules.values():
        df = df.filter(F.coalesce(F.expr(rule), F.lit(False)))
    return df


def rejects(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that some rule drops, with the names of those rules."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("failed_rules", failed).filter(F.size("failed_rules") > 0)


def runs(observations: DataFrame) -> DataFrame:
    df = parse_observations(observations, "execution.completed", RUN_SCHEMA)
    df = df.withColumns({c: F.to_timestamp(c) for c in ("start_time", "end_time")})
    return expect_or_drop(df, RUN_RULES)


def run_timings(observations: DataFrame) -> DataFrame:
    return expect_or_drop(parse_observations(observations, "execution.timing", TIMING_SCHEMA), TIMING_RULES)


def changes(observations: DataFrame) -> DataFrame:
    return expect_or_drop(parse_observations(observations, "change.committed", CHANGE_SCHEMA), CHANGE_RULES)


def run_features(runs: DataFrame, profiles: DataFrame, timings: DataFrame) -> DataFrame:
    """Runs with profile and timing columns; timings are one a run, colliding columns come from the runs."""
    p = profiles.dropDuplicates(["run_id"])
    t = timings.dropDuplicates(["run_id"]).select("run_id", "setup_s", "execution_s")
    p = p.select("run_id", *[c for c in p.columns if c not in runs.columns])
    df = runs.drop("setup_s", "execution_s").join(p, "run_id", "left").join(t, "run_id", "left")
    return df.withColumn("input_rows", F.col("left_rows")) if "left_rows" in df.columns else df


def insert_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of source whose key the target lacks, one a key (the smallest by all columns)."""
    one = source.groupBy(key).agg(F.min(F.struct(*[c for c in source.columns if c != key])).alias("r")).select(key, "r.*").select(*source.columns)
    return one.join(target.select(key), key, "left_anti").select(*source.columns)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with source rows replacing or joining it; columns that the source lacks become null for its rows."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed null columns for those that are missing; running it twice changes nothing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), value))


def since_cursor(df: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows at or after the connector's cursor (ms); a connector without one starts at the beginning."""
    return df.join(cursors.select("connector", "cursor"), "connector", "left").filter(F.col("cursor").isNull() | (F.col("end_ms") >= F.col("cursor"))).drop("cursor")


def next_cursor(df: DataFrame, cursors: DataFrame) -> DataFrame:
    """connector, cursor: one past the newest row read; a connector that read nothing keeps its cursor."""
    new = df.groupBy("connector").agg((F.max("end_ms") + 1).alias("_new"))
    return cursors.select("connector", "cursor").join(new, "connector", "full").select("connector", F.greatest("cursor", "_new").alias("cursor"))


def pending_keys(referenced: DataFrame, observed: DataFrame) -> DataFrame:
    """Distinct shas that runs refer to and no observation's subject (after its slash) names."""
    known = observed.select(F.substring_index("subject", "/", -1).alias("sha"))
    return referenced.select("sha").filter("sha is not null").distinct().join(known, "sha", "left_anti")


def dlq_transition(dlq: DataFrame, failures: DataFrame, successes: DataFrame, now: Column) -> DataFrame:
    """The dead-letter table after a cycle: one row a message, backoff 5 min doubling to 6 h, quarantine, resolution."""
    f = failures.select("dlq_id", F.substring("error", 1, ERROR_CHARS).alias("f_error"), error_class(F.col("http_status")).alias("f_class"))
    s = successes.select("dlq_id", F.lit(True).alias("ok"))
    df = dlq.join(f, "dlq_id", "full").join(s, "dlq_id", "left")
    failed = F.col("f_class").isNotNull()
    attempts = F.coalesce("attempts", F.lit(0)) + F.when(failed, 1).otherwise(0)
    kind = F.coalesce("f_class", "error_class")
    status = F.when(F.col("ok"), F.lit("resolved")).when(~failed, F.col("status")).when((kind == "permanent") | (attempts >= MAX_ATTEMPTS), F.lit("quarantined")).otherwise(F.lit("pending"))
    wait = F.least(F.lit(float(RETRY_S)) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(RETRY_CAP_S)))
    due = F.when(failed & (status == "pending"), F.timestamp_seconds(now.cast("timestamp").cast("long") + wait.cast("long"))).when(~failed & ~F.coalesce("ok", F.lit(False)), F.col("next_attempt_at"))
    return df.select("dlq_id", F.coalesce("f_error", "error").alias("error"), kind.alias("error_class"), attempts.alias("attempts"), F.coalesce("first_at", now.cast("timestamp")).alias("first_at"), due.alias("next_attempt_at"), status.alias("status"))


def dlq_consolidate(rows: DataFrame) -> DataFrame:
    """One row a message of a table with one row an attempt: latest error, first time, attempts, status code in the text."""
    out = rows.groupBy("dlq_id").agg(F.max(F.struct("at", "error")).alias("l"), F.min("at").alias("first_at"), F.count(F.lit(1)).alias("attempts"))
    code = F.regexp_extract("l.error", r"\b([1-5]\d\d)\b", 1).try_cast("int")
    return out.select("dlq_id", F.col("l.error").alias("error"), "first_at", F.col("l.at").alias("last_at"), "attempts", code.alias("http_status"), error_class(code).alias("error_class"))


def due(df: DataFrame, now: Column) -> DataFrame:
    """Pending rows whose next attempt has come."""
    return df.filter((F.col("status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))


def connector_health(checkpoints: DataFrame, dlq: DataFrame, now: Column) -> DataFrame:
    """connector, health: sem_dados, falhando, degradado or saudavel, in that order."""
    open_rows = dlq.filter("status in ('pending', 'quarantined')").groupBy("connector").agg(F.count(F.lit(1)).alias("open_dlq"))
    df = checkpoints.join(open_rows, "connector", "left").withColumn("open_dlq", F.coalesce("open_dlq", F.lit(0)))
    stale = F.col("last_success_at").isNull() | (F.col("last_success_at") < now - F.expr("INTERVAL '24' HOUR"))
    health = F.when(F.col("last_success_at").isNull() & F.col("last_error").isNull(), F.lit("sem_dados")).when(F.col("last_error").isNotNull() & stale, F.lit("falhando")).when(F.col("open_dlq") > 0, F.lit("degradado")).otherwise(F.lit("saudavel"))
    return df.select("connector", "open_dlq", health.alias("health"))


def outbox_transition(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """sent, retry or failed after a delivery round; the first retry waits two minutes."""
    df = outbox.join(results.select("outbox_id", "delivered"), "outbox_id", "left")
    tried = F.col("delivered").isNotNull()
    attempts = F.col("attempts") + F.when(tried, 1).otherwise(0)
    status = F.when(~tried, F.col("status")).when(F.col("delivered"), F.lit("sent")).when(attempts >= MAX_ATTEMPTS, F.lit("failed")).otherwise(F.lit("retry"))
    minutes = F.element_at(F.array(*[F.lit(m) for m in OUTBOX_MINUTES]), F.least(attempts + 1, F.lit(len(OUTBOX_MINUTES))).cast("int"))
    again = F.when(tried & (status == "retry"), F.timestamp_seconds(now.cast("timestamp").cast("long") + minutes * 60))
    return df.select("outbox_id", "incident_id", attempts.cast("int").alias("attempts"), status.alias("status"), again.alias("next_attempt_at"))


def failed_to_dlq(outbox: DataFrame) -> DataFrame:
    """Dead-letter rows of deliveries that were given up."""
    return outbox.filter("status = 'failed'").select(F.concat(F.lit("outbox-"), "outbox_id").alias("dlq_id"), F.lit("quarantined").alias("status"), "attempts")


def link_refs(incidents: DataFrame, sent: DataFrame) -> DataFrame:
    """Adds new references to an incident's list, distinct; the version rises only when something was added."""
    new = sent.groupBy("incident_id").agg(F.array_sort(F.collect_set("ref")).alias("_new"))
    df = incidents.join(new, "incident_id", "left")
    both = F.array_sort(F.array_distinct(F.array_union(F.coalesce("refs", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>")))))
    grown = F.size(both) > F.size(F.coalesce("refs", F.array().cast("array<string>")))
    return df.withColumn("version", F.col("version") + F.when(grown, 1).otherwise(0)).withColumn("refs", both).drop("_new")


def purge(df: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    """Rows inside the retention; a row without a time stays."""
    return df.filter(F.col(column).isNull() | (F.col(column) >= now - F.expr(f"INTERVAL '{days}' DAY")))


def hash_slice(df: DataFrame, key: str, share: float) -> DataFrame:
    """The same share of keys on every run and in every engine, by the first digits of a digest."""
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.filter(place % 10_000 < int(share * 10_000))
