"""Queries of ingestion state."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.columns import error_class, stable_id
from opsloom.operators import ingest as I
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query



def now():
    """The fixed instant of these queries."""
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'empty source' WHEN event_id % 10 = 1 THEN 'unknown type' END AS reject, sha256(props) AS content_hash, 36 AS id_length FROM events")
def envelopes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = I.envelope(e, F.expr("case when event_id % 10 = 0 then ' ' else 'src' end"), F.expr("case when event_id % 10 = 1 then 'odd' else 'usage.recorded' end"), F.col("user_id").cast("string"), F.col("ts"), F.col("props"))
    return out.select("event_id", "reject", "content_hash", F.length("id").alias("id_length"))


@query(with_("observations") + "SELECT id, subject, CAST(regexp_extract(data, '[0-9]+') AS bigint) AS k FROM observations WHERE type = 'view' AND CAST(regexp_extract(data, '[0-9]+') AS bigint) >= 5")
def parsed_observations(spark, sf_dir):
    df = I.parse_observations(fixture(spark, sf_dir, "observations"), "view", "k bigint")
    return I.expect_or_drop(df, {"k": "k >= 5"}).select("id", F.col("envelope_subject").alias("subject"), "k")


@query(with_("dirty_orders") + "SELECT order_id, CASE WHEN customer_id IS NULL AND NOT coalesce(amount > 0, false) THEN 'identity,amount' WHEN customer_id IS NULL THEN 'identity' ELSE 'amount' END AS failed FROM dirty_orders WHERE customer_id IS NULL OR NOT coalesce(amount > 0, false)")
def rejected_rows(spark, sf_dir):
    out = I.rejects(fixture(spark, sf_dir, "dirty_orders"), {"identity": "customer_id is not null", "amount": "amount > 0"})
    return out.select("order_id", F.array_join("failed_rules", ",").alias("failed"))


def _observed_runs(spark, sf_dir):
    r = fixture(spark, sf_dir, "runs").withColumn("n", F.col("run_id").cast("bigint"))
    p = r.select(F.col("run_id").alias("id"), F.lit("execution.completed").alias("type"), F.col("job_id").alias("subject"), F.col("end_time").alias("time"), F.to_json(F.struct(F.when(F.col("n") % 31 != 0, F.col("run_id")).alias("run_id"), "job_id", "job_name", F.col("start_time").cast("string").alias("start_time"), F.col("end_time").cast("string").alias("end_time"), F.when(F.col("n") % 37 == 0, -1.0).otherwise(F.col("duration_s")).alias("duration_s"), "result_state", "git_sha")).alias("data"))
    t = r.filter("n % 4 <> 0").select(F.col("run_id").alias("id"), F.lit("execution.timing").alias("type"), F.col("job_id").alias("subject"), F.col("end_time").alias("time"), F.to_json(F.struct("run_id", "job_id", "setup_s", "execution_s")).alias("data"))
    c = r.filter("n % 5 = 0").select(F.col("run_id").alias("id"), F.lit("change.committed").alias("type"), F.col("job_id").alias("subject"), F.col("end_time").alias("time"), F.to_json(F.struct(F.when(F.col("n") % 2 == 0, F.sha1(F.col("run_id").cast("binary"))).otherwise(F.lit("bad")).alias("sha"), F.lit("r").alias("repo"), F.array(F.lit("a.py")).alias("files"))).alias("data"))
    return p.unionByName(t).unionByName(c)


@query(with_("runs") + "SELECT run_id, job_id, CAST(start_time AS string) AS start_time, duration_s, result_state FROM runs WHERE CAST(run_id AS bigint) % 31 <> 0 AND CAST(run_id AS bigint) % 37 <> 0")
def medallion_runs(spark, sf_dir):
    return I.runs(_observed_runs(spark, sf_dir)).select("run_id", "job_id", F.col("start_time").cast("string").alias("start_time"), "duration_s", "result_state")


@query(with_("runs") + "SELECT run_id, setup_s, execution_s FROM runs WHERE CAST(run_id AS bigint) % 4 <> 0")
def medallion_run_timings(spark, sf_dir):
    return I.run_timings(_observed_runs(spark, sf_dir)).select("run_id", "setup_s", "execution_s")


@query(with_("runs") + "SELECT sha1(run_id) AS sha, 'r' AS repo, 1 AS files FROM runs WHERE CAST(run_id AS bigint) % 10 = 0")
def medallion_changes(spark, sf_dir):
    return I.changes(_observed_runs(spark, sf_dir)).select("sha", "repo", F.size("files").alias("files"))


@query(with_("runs") + "SELECT r.run_id, r.job_id, CASE WHEN n % 3 = 0 THEN n * 10 END AS input_rows, CASE WHEN n % 4 <> 0 THEN setup_s END AS setup_s, CASE WHEN n % 4 <> 0 THEN execution_s END AS execution_s FROM (SELECT *, CAST(run_id AS bigint) AS n FROM runs) AS r WHERE n % 31 <> 0 AND n % 37 <> 0")
def run_features(spark, sf_dir):
    o = _observed_runs(spark, sf_dir)
    profiles = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").selectExpr("cast(o_orderkey as string) run_id", "o_orderkey * 10 left_rows", "'x' git_sha")
    timings = I.run_timings(o)
    return I.run_features(I.runs(o), profiles, timings.unionByName(timings)).select("run_id", "job_id", "input_rows", "setup_s", "execution_s")


@query("SELECT o_orderkey AS k, min(o_custkey) AS v FROM (SELECT o_orderkey % 500 + 1 AS o_orderkey, o_custkey FROM orders) AS s WHERE o_orderkey > 250 GROUP BY 1")
def insert_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 500 + 1 k", "o_custkey v")
    return I.insert_missing(o.filter("k <= 250").select("k").distinct(), o, "k")


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new', NULL FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 'new', NULL FROM customer WHERE c_custkey % 3 = 0")
def upserted(spark, sf_dir):
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey k", "c_name name", "c_acctbal bal")
    s = t.filter("k % 3 = 0").selectExpr("k", "'new' name")
    return I.upsert(t, s.unionByName(s.selectExpr("k + 1000000 k", "name")), ["k"])


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 's' ELSE c_name END AS subject, CAST(NULL AS int) AS version FROM customer")
def migrated(spark, sf_dir):
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey k", "case when c_custkey % 2 = 0 then 's' end subject", "c_name")
    return I.backfill(I.add_columns(I.add_columns(t, {"version": "int"}), {"version": "int"}), "subject", F.col("c_name")).select("k", "subject", "version")


_CUR = "WITH r AS (SELECT 'c' || CAST(o_custkey % 7 AS string) AS connector, o_orderkey AS end_ms FROM orders WHERE o_custkey % 7 <> 6), c AS (SELECT 'c' || CAST(k AS string) AS connector, CAST(k * 2000 AS bigint) AS cur FROM (SELECT DISTINCT c_custkey % 7 AS k FROM customer) AS x WHERE k % 3 <> 1)"


def _cursors(spark, sf_dir):
    r = table(spark, sf_dir, "orders").filter("o_custkey % 7 <> 6").selectExpr("'c' || (o_custkey % 7) connector", "o_orderkey end_ms")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey % 7 k").distinct().filter("k % 3 <> 1").selectExpr("'c' || k connector", "k * 2000 cursor")
    return r, c


@query(_CUR + " SELECT r.connector, r.end_ms FROM r LEFT JOIN c ON c.connector = r.connector WHERE cur IS NULL OR end_ms >= cur")
def rows_since_cursor(spark, sf_dir):
    return I.since_cursor(*_cursors(spark, sf_dir))


@query(_CUR + " SELECT coalesce(n.connector, c.connector) AS connector, greatest(cur, m) AS pos FROM c FULL JOIN (SELECT connector, max(end_ms) + 1 AS m FROM r GROUP BY 1) AS n ON n.connector = c.connector")
def next_cursors(spark, sf_dir):
    return I.next_cursor(*_cursors(spark, sf_dir)).withColumnRenamed("cursor", "pos")


@query("SELECT DISTINCT CAST(o_custkey AS string) AS sha FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def pending_keys(spark, sf_dir):
    return I.pending_keys(table(spark, sf_dir, "orders").selectExpr("cast(o_custkey as string) sha"), table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("'repo/x/' || c_custkey subject"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 5 = 1 OR p_partkey % 5 = 2 THEN 'transient' ELSE 'permanent' END AS error_class FROM part")
def error_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", error_class(F.expr("case p_partkey % 5 when 0 then null when 1 then 503 when 2 then 429 when 3 then 404 else 400 end")).alias("error_class"))


_DLQ = "WITH d AS (SELECT CAST(o_orderkey AS string) AS dlq_id, CAST(o_orderkey % 6 AS int) AS attempts, o_orderkey AS n FROM orders WHERE o_orderkey % 3 = 0)"


@query(_DLQ + """, x AS (SELECT coalesce(d.dlq_id, CAST(o.o_orderkey AS string)) AS dlq_id, coalesce(d.attempts, 0) AS a0, d.dlq_id IS NOT NULL AS old, o.o_orderkey % 4 = 0 AS failed, o.o_orderkey % 8 = 0 AS perm, o.o_orderkey % 5 = 0 AS ok FROM orders o LEFT JOIN d ON d.n = o.o_orderkey WHERE d.dlq_id IS NOT NULL OR o.o_orderkey % 4 = 0),
    y AS (SELECT *, a0 + CASE WHEN failed THEN 1 ELSE 0 END AS a FROM x), z AS (SELECT *, CASE WHEN ok THEN 'resolved' WHEN NOT failed THEN 'pending' WHEN perm OR a >= 5 THEN 'quarantined' ELSE 'pending' END AS st FROM y)
    SELECT dlq_id, CAST(a AS int) AS attempts, CASE WHEN failed THEN CASE WHEN perm THEN 'permanent' ELSE 'transient' END ELSE 'transient' END AS error_class, st AS status, CASE WHEN failed AND st = 'pending' THEN CAST(least(300 * pow(2, a - 1), 21600) AS bigint) END AS wait_s FROM z""")
def dead_letters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.filter("o_orderkey % 3 = 0").selectExpr("cast(o_orderkey as string) dlq_id", "'e' error", "'transient' error_class", "cast(o_orderkey % 6 as int) attempts", "timestamp '2024-01-01 00:00:00' first_at", "cast(null as timestamp) next_attempt_at", "'pending' status")
    f = o.filter("o_orderkey % 4 = 0").selectExpr("cast(o_orderkey as string) dlq_id", "repeat('x', 600) error", "case when o_orderkey % 8 = 0 then 404 else 503 end http_status")
    s = o.filter("o_orderkey % 5 = 0").selectExpr("cast(o_orderkey as string) dlq_id")
    out = I.dlq_transition(d, f, s, now())
    return out.select("dlq_id", "attempts", "error_class", "status", (F.col("next_attempt_at").cast("long") - now().cast("long")).alias("wait_s"))


@query("""WITH r AS (SELECT 'd' || CAST(user_id AS string) AS dlq_id, ts, event_id, 'HTTP ' || CAST(400 + event_id % 200 AS string) || ' x' AS error FROM events)
    SELECT dlq_id, arg_max(error, (ts, error)) AS error, count(*) AS attempts, CAST(regexp_extract(arg_max(error, (ts, error)), '[1-5][0-9][0-9]') AS int) AS http_status, CASE WHEN CAST(regexp_extract(arg_max(error, (ts, error)), '[1-5][0-9][0-9]') AS int) >= 500 OR CAST(regexp_extract(arg_max(error, (ts, error)), '[1-5][0-9][0-9]') AS int) IN (408, 429) THEN 'transient' ELSE 'permanent' END AS error_class FROM r GROUP BY dlq_id""")
def dead_letters_consolidated(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr("'d' || user_id dlq_id", "ts at", "'HTTP ' || (400 + event_id % 200) || ' x' error")
    return I.dlq_consolidate(r).drop("first_at", "last_at")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND (event_id % 4 = 0 OR ts <= TIMESTAMP '2024-01-15 00:00:00')")
def due_rows(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 3 = 0 then 'pending' else 'quarantined' end status", "case when event_id % 4 <> 0 then ts end next_attempt_at")
    return I.due(t, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("event_id")


@query("SELECT 'c' || CAST(c_custkey AS string) AS connector, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 ELSE 0 END AS open_dlq, CASE WHEN c_custkey % 6 = 0 THEN 'sem_dados' WHEN c_custkey % 6 = 1 THEN 'falhando' WHEN c_custkey % 4 = 0 AND c_custkey % 3 > 0 THEN 'degradado' ELSE 'saudavel' END AS health FROM customer")
def connector_health(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cp = c.selectExpr("'c' || c_custkey connector", "case when c_custkey % 6 = 0 then null when c_custkey % 6 = 1 then timestamp '2024-01-29 00:00:00' else timestamp '2024-01-30 12:00:00' end last_success_at", "case when c_custkey % 6 in (1, 2) then 'boom' end last_error")
    dlq = c.filter("c_custkey % 4 = 0 and c_custkey % 3 > 0").selectExpr("'c' || c_custkey connector", "explode(sequence(1, cast(c_custkey % 3 as int))) k").selectExpr("connector", "case when k = 1 then 'pending' else 'quarantined' end status")
    return I.connector_health(cp, dlq, now())


@query("""WITH o AS (SELECT CAST(event_id AS string) AS outbox_id, CAST(event_id % 5 AS int) AS a, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS d FROM events)
    SELECT outbox_id, CAST(CASE WHEN d IS NULL THEN a ELSE a + 1 END AS int) AS attempts, CASE WHEN d IS NULL THEN 'pending' WHEN d THEN 'sent' WHEN a + 1 >= 5 THEN 'failed' ELSE 'retry' END AS status, CAST(CASE WHEN NOT d AND a + 1 < 5 THEN 60 * pow(2, a + 1) END AS bigint) AS wait_s FROM o""")
def outbox_after_delivery(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = I.outbox_transition(e.selectExpr("cast(event_id as string) outbox_id", "'i' incident_id", "cast(event_id % 5 as int) attempts", "'pending' status"), e.filter("event_id % 3 < 2").selectExpr("cast(event_id as string) outbox_id", "event_id % 3 = 0 delivered"), now())
    return out.select("outbox_id", "attempts", "status", (F.col("next_attempt_at").cast("long") - now().cast("long")).alias("wait_s"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new,old' ELSE 'old' END AS refs, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS int) AS version FROM customer")
def linked_refs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    out = I.link_refs(c.selectExpr("c_custkey incident_id", "array('old') refs", "1 version"), c.filter("c_custkey % 3 = 0").selectExpr("c_custkey incident_id", "explode(array('new', 'old', 'new')) ref"))
    return out.select(F.col("incident_id").alias("k"), F.array_join("refs", ",").alias("refs"), "version")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '10' DAY")
def purged(spark, sf_dir):
    return I.purge(table(spark, sf_dir, "events"), "ts", 10, now()).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS string)), 1, 8) AS bigint) % 10000 < 1000")
def hash_slices(spark, sf_dir):
    return I.hash_slice(table(spark, sf_dir, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query("SELECT o_orderkey, 'inc-' || substr(sha256(CAST(o_orderkey AS string) || '|' || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, '')), 1, 12) AS id FROM orders")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", stable_id("inc-", F.col("o_orderkey"), F.expr("case when o_orderkey % 2 = 0 then o_orderpriority end")).alias("id"))
