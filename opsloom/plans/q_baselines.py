"""Queries of run-time and cost baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import baselines as B
from opsloom.plans.fixtures import fixture, with_
from opsloom.registry import query

_PAST = (
    with_("runs")
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY end_time, run_id) AS nth FROM runs),
    past AS (SELECT r.run_id, e.execution_s AS v, row_number() OVER (PARTITION BY r.run_id ORDER BY e.nth DESC) AS back
             FROM placed r JOIN placed e ON e.job_id = r.job_id AND e.nth < r.nth AND e.result_state = 'SUCCESS' AND e.end_time <= r.start_time),
    kept AS (SELECT * FROM past WHERE back <= 20),
    mid AS (SELECT run_id, median(v) AS median, count(*) AS n FROM kept GROUP BY run_id),
    dev AS (SELECT k.run_id, median(abs(k.v - m.median)) AS mad FROM kept k JOIN mid m ON m.run_id = k.run_id GROUP BY k.run_id),
    base AS (SELECT r.run_id, r.job_id, r.execution_s, coalesce(m.n, 0) AS n, m.median, d.mad, greatest(2 * m.median, m.median + 5 * d.mad, m.median + 30) AS threshold
             FROM runs r LEFT JOIN mid m ON m.run_id = r.run_id LEFT JOIN dev d ON d.run_id = r.run_id)"""
)


@query(_PAST + """ SELECT run_id, job_id, round(execution_s, 6) AS execution_s, CAST(n AS int) AS n, round(median, 6) AS median, round(mad, 6) AS mad, round(threshold, 6) AS threshold,
    CASE WHEN threshold = 2 * median THEN 'ratio' WHEN threshold = median + 5 * mad THEN 'mad' ELSE 'floor' END AS deciding_term
    FROM base WHERE n >= 5 AND execution_s > threshold""")
def runtime_regressions_one_pass(spark, sf_dir):
    df = B.runtime_baseline(fixture(spark, sf_dir, "runs")).filter("verdict = 'regression'")
    return df.select("run_id", "job_id", F.round("execution_s", 6).alias("execution_s"), "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "threshold")], "deciding_term")


@query(_PAST + """ SELECT CASE WHEN n < 5 THEN 'insufficient_baseline' WHEN execution_s > threshold THEN 'regression' ELSE 'healthy' END AS verdict, count(*) AS runs FROM base GROUP BY 1""")
def runtime_verdicts(spark, sf_dir):
    return B.runtime_baseline(fixture(spark, sf_dir, "runs")).groupBy("verdict").agg(F.count(F.lit(1)).alias("runs"))


@query(with_("runs") + """, m AS (SELECT job_id, median(execution_s) AS median FROM runs WHERE result_state = 'SUCCESS' GROUP BY job_id),
    d AS (SELECT r.job_id, median(abs(r.execution_s - m.median)) AS mad FROM runs r JOIN m ON m.job_id = r.job_id WHERE result_state = 'SUCCESS' GROUP BY r.job_id)
    SELECT m.job_id, round(m.median, 6) AS median, round(d.mad, 6) AS mad, round(greatest(2 * m.median, m.median + 5 * d.mad, m.median + 30), 6) AS threshold,
    CASE WHEN 2 * median >= median + 5 * mad AND 2 * median >= median + 30 THEN 'ratio' WHEN 5 * mad >= 30 THEN 'mad' ELSE 'floor' END AS deciding_term FROM m JOIN d ON d.job_id = m.job_id""")
def robust_thresholds(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs").filter("result_state = 'SUCCESS'")
    return B.robust_thresholds(runs, "job_id", "execution_s").select("job_id", *[F.round(c, 6).alias(c) for c in ("median", "mad", "threshold")], "deciding_term")


#: The sequential rule as a recursion: one run of each job a step, with the job's eligible runs so far as a list.
_FOLD = """, past AS (
    SELECT job_id, CAST(0 AS bigint) AS nth, CAST('' AS varchar) AS run_id, CAST(NULL AS double) AS v, CAST(NULL AS double) AS mid, CAST(NULL AS double) AS mad, CAST(0 AS int) AS n, false AS fallback,
           CAST([] AS STRUCT(t timestamp, v double, b int)[]) AS hist
    FROM placed GROUP BY job_id
    UNION ALL
    SELECT job_id, nth, run_id, v, mid, mad, n, fallback,
           CASE WHEN ok AND NOT (n >= 5 AND v > greatest(2 * mid, mid + 5 * mad, mid + {floor})) THEN list_append(hist, {{'t': end_time, 'v': v, 'b': band}}) ELSE hist END
    FROM (SELECT *, list_median([abs(y - mid) for y in sample]) AS mad FROM (
          SELECT *, list_median(sample) AS mid, CAST(len(sample) AS int) AS n, band IS NOT NULL AND NOT banded AS fallback FROM (
          SELECT *, CASE WHEN banded THEN same[-20:] ELSE every[-20:] END AS sample FROM (
          SELECT *, band IS NOT NULL AND len(same) >= 5 AS banded FROM (
          SELECT r.job_id, r.nth, r.run_id, r.v, r.ok, r.end_time, r.band, p.hist,
                 [x.v for x in p.hist if x.t <= r.start_time AND x.b = r.band] AS same, [x.v for x in p.hist if x.t <= r.start_time] AS every
          FROM past p JOIN placed r ON r.job_id = p.job_id AND r.nth = p.nth + 1) AS a) AS b) AS c) AS d) AS e),
    judged AS (SELECT *, CASE WHEN n < 5 THEN 'insufficient_baseline' WHEN v > greatest(2 * mid, mid + 5 * mad, mid + {floor}) THEN 'regression' ELSE 'healthy' END AS verdict FROM past WHERE nth > 0)"""
_RUNS_PLACED = """, placed AS (SELECT job_id, run_id, start_time, end_time, execution_s AS v, result_state = 'SUCCESS' AS ok, CAST(floor(log2(input_rows)) AS int) AS band,
    row_number() OVER (PARTITION BY job_id ORDER BY end_time, run_id) AS nth FROM runs)"""
_FOLDED = with_("runs").replace("WITH ", "WITH RECURSIVE ", 1) + _RUNS_PLACED + _FOLD.format(floor=30)


@query(_FOLDED + """ SELECT run_id, job_id, round(v, 6) AS value, n, fallback AS band_fallback, verdict, verdict = 'regression' AS opens, CASE WHEN n >= 5 THEN round(mid, 6) END AS median,
    CASE WHEN n >= 5 THEN round(mad, 6) END AS mad FROM judged""")
def detect_runtime_regressions(spark, sf_dir):
    df = B.detect_runtime_regressions(fixture(spark, sf_dir, "runs"))
    return df.select("run_id", "job_id", F.round("value", 6).alias("value"), "n", "band_fallback", "verdict", "opens", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


#: Two runs in nine are taken out of the samples, and odd jobs start anew in 1996.
_BANDED = (
    with_("runs")
    + """, r AS (SELECT *, CASE WHEN CAST(run_id AS bigint) % 5 = 0 THEN 'total' ELSE 'execution' END AS metric, CASE WHEN CAST(run_id AS bigint) % 5 = 0 THEN duration_s ELSE execution_s END AS v,
    CAST(floor(log2(input_rows)) AS int) AS band FROM runs),
    fit AS (SELECT * FROM r WHERE result_state = 'SUCCESS' AND CAST(run_id AS bigint) % 9 > 1 AND (CAST(substr(job_id, 5) AS bigint) % 2 = 0 OR start_time >= TIMESTAMP '1996-01-01 00:00:00')),
    seen AS (SELECT r.run_id, e.v, e.band IS NOT DISTINCT FROM r.band AS same, row_number() OVER (PARTITION BY r.run_id ORDER BY e.end_time DESC, e.run_id DESC) AS back,
             row_number() OVER (PARTITION BY r.run_id, e.band IS NOT DISTINCT FROM r.band ORDER BY e.end_time DESC, e.run_id DESC) AS back_same
             FROM r JOIN fit e ON e.job_id = r.job_id AND e.metric = r.metric AND e.end_time <= r.start_time),
    many AS (SELECT run_id, sum(CASE WHEN same THEN 1 ELSE 0 END) AS same_n FROM seen GROUP BY run_id),
    kept AS (SELECT s.run_id, s.v FROM seen s JOIN many m ON m.run_id = s.run_id WHERE CASE WHEN m.same_n >= 5 THEN s.same AND s.back_same <= 20 ELSE s.back <= 20 END),
    mid AS (SELECT run_id, median(v) AS median, count(*) AS n FROM kept GROUP BY run_id)"""
)


@query(_BANDED + """ SELECT r.run_id, r.metric, coalesce(CAST(m.n AS int), 0) AS n, coalesce(y.same_n, 0) < 5 AS band_fallback, CASE WHEN m.n >= 5 THEN round(m.median, 6) END AS median
    FROM r LEFT JOIN mid m ON m.run_id = r.run_id LEFT JOIN many y ON y.run_id = r.run_id""")
def banded_baselines(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs").withColumn("execution_s", F.when(F.col("run_id").cast("bigint") % 5 != 0, F.col("execution_s")))
    jobs = runs.select("job_id").distinct().filter("cast(substr(job_id, 5) as bigint) % 2 = 1").select("job_id", F.expr("timestamp '1996-01-01 00:00:00'").alias("regime_start"))
    df = B.banded_baseline(runs, excluded=runs.filter("cast(run_id as bigint) % 9 <= 1"), regimes=jobs)
    return df.select("run_id", "metric", "n", "band_fallback", F.round("median", 6).alias("median"))


_MARKS = ", marks AS (SELECT 'job-' || CAST(c_custkey % 20 AS string) AS job_id, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1996-01-01 00:00:00' END AS mark_at, CASE WHEN c_custkey % 2 = 1 THEN 'SHA' || CAST(c_custkey % 7 AS string) || '000' END AS mark_sha FROM customer)"


@query(with_("runs") + _MARKS + """ SELECT job_id, CAST(max(moment) AS string) AS regime_start FROM (
    SELECT job_id, mark_at AS moment FROM marks WHERE mark_at IS NOT NULL
    UNION ALL SELECT m.job_id, min(r.start_time) FROM marks m JOIN runs r ON r.job_id = m.job_id AND starts_with(lower(r.git_sha), lower(m.mark_sha)) WHERE length(m.mark_sha) >= 7 GROUP BY m.job_id, m.mark_sha) AS x GROUP BY job_id""")
def regime_starts(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    marks = customer.selectExpr("'job-' || cast(c_custkey % 20 as string) job_id", "case when c_custkey % 2 = 0 then timestamp '1996-01-01 00:00:00' end mark_at", "case when c_custkey % 2 = 1 then 'SHA' || cast(c_custkey % 7 as string) || '000' end mark_sha")
    return B.regime_start(marks, fixture(spark, sf_dir, "runs")).select("job_id", F.col("regime_start").cast("string").alias("regime_start"))


@query(with_("runs") + """ SELECT run_id, job_id, healthy_run_id FROM (SELECT r.run_id, r.job_id, h.run_id AS healthy_run_id, row_number() OVER (PARTITION BY r.run_id ORDER BY h.end_time DESC, h.run_id DESC) AS n
    FROM runs r LEFT JOIN runs h ON h.job_id = r.job_id AND h.result_state = 'SUCCESS' AND h.end_time <= r.start_time) AS x WHERE n = 1""")
def last_healthy_runs(spark, sf_dir):
    return B.last_healthy_run(fixture(spark, sf_dir, "runs"))


@query(with_("runs") + """, p AS (SELECT run_id, job_id, healthy_run_id FROM (SELECT r.run_id, r.job_id, h.run_id AS healthy_run_id, row_number() OVER (PARTITION BY r.run_id ORDER BY h.end_time DESC, h.run_id DESC) AS n
    FROM runs r LEFT JOIN runs h ON h.job_id = r.job_id AND h.result_state = 'SUCCESS' AND h.end_time <= r.start_time) AS x WHERE n = 1)
    SELECT dimension, CASE WHEN hv IS NULL OR cv IS NULL THEN 'not_available' WHEN hv = cv THEN 'equal' ELSE 'changed' END AS status, count(*) AS n FROM (
        SELECT unnest(['git_sha', 'input_rows', 'duration_s', 'execution_s', 'setup_s', 'skew_ratio', 'job_parameters', 'env_hash', 'max_key_rows', 'median_key_rows', 'top_key_share', 'plan_operators', 'spill_bytes', 'gc_ms']) AS dimension,
               unnest([h.git_sha, CAST(h.input_rows AS string), CAST(round(h.duration_s, 1) AS string), CAST(round(h.execution_s, 1) AS string), CAST(round(h.setup_s, 1) AS string), CAST(round(h.skew_ratio, 2) AS string), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS hv,
               unnest([c.git_sha, CAST(c.input_rows AS string), CAST(round(c.duration_s, 1) AS string), CAST(round(c.execution_s, 1) AS string), CAST(round(c.setup_s, 1) AS string), CAST(round(c.skew_ratio, 2) AS string), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS cv
        FROM p JOIN runs c ON c.run_id = p.run_id LEFT JOIN runs h ON h.run_id = p.healthy_run_id) AS x GROUP BY 1, 2""")
def run_differences(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs")
    return B.diff_runs(B.last_healthy_run(runs), runs).groupBy("dimension", "status").agg(F.count(F.lit(1)).alias("n"))


_COSTS = with_("runs") + ", costs AS (SELECT run_id, job_id, start_time, end_time, result_state, CASE WHEN CAST(run_id AS bigint) % 13 = 0 THEN NULL ELSE floor(execution_s) / 4.0e0 + CASE WHEN CAST(run_id AS bigint) % 43 = 0 THEN 500 ELSE 0 END END AS cost FROM runs)"


def costs(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs")
    return runs.selectExpr("run_id", "job_id", "start_time", "end_time", "result_state", "case when cast(run_id as bigint) % 13 = 0 then null else floor(execution_s) / 4.0d + case when cast(run_id as bigint) % 43 = 0 then 500 else 0 end end cost")


@query(_COSTS + """, g AS (SELECT *, coalesce(sum(CASE WHEN result_state = 'SUCCESS' AND cost IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY end_time, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM costs),
    b AS (SELECT c.run_id, median(p.cost) AS baseline FROM g c JOIN g p ON p.job_id = c.job_id AND p.result_state = 'SUCCESS' AND p.cost IS NOT NULL AND p.k < c.k AND p.k >= c.k - 5 GROUP BY c.run_id)
    SELECT c.run_id, round(b.baseline, 6) AS baseline_cost, CASE WHEN c.cost IS NULL AND c.end_time > TIMESTAMP '1998-08-01 00:00:00' - INTERVAL '24' HOUR THEN 'pending' WHEN c.cost IS NULL OR b.baseline IS NULL THEN 'not_available' ELSE 'available' END AS status,
    CASE WHEN c.cost IS NOT NULL THEN round(c.cost - b.baseline, 4) END AS incremental_cost FROM costs c LEFT JOIN b ON b.run_id = c.run_id""")
def incremental_costs(spark, sf_dir):
    out = B.incremental_cost(costs(spark, sf_dir), F.to_timestamp(F.lit("1998-08-01 00:00:00")))
    return out.select("run_id", F.round("baseline_cost", 6).alias("baseline_cost"), "status", "incremental_cost")


_COSTS_PLACED = """, placed AS (SELECT job_id, run_id, start_time, end_time, cost AS v, result_state = 'SUCCESS' AS ok, CAST(NULL AS int) AS band,
    row_number() OVER (PARTITION BY job_id ORDER BY end_time, run_id) AS nth FROM costs WHERE cost IS NOT NULL)"""


@query("SELECT c.run_id, c.job_id, round(c.v, 6) AS value, c.n FROM (" + _COSTS.replace("WITH ", "WITH RECURSIVE ", 1) + _COSTS_PLACED + _FOLD.format(floor=0.05) + " SELECT * FROM judged WHERE verdict = 'regression') AS c"
       " LEFT JOIN (" + _FOLDED + " SELECT run_id FROM judged WHERE verdict = 'regression') AS t ON t.run_id = c.run_id WHERE t.run_id IS NULL")
def cost_regressions(spark, sf_dir):
    df = B.cost_regressions(costs(spark, sf_dir), B.detect_runtime_regressions(fixture(spark, sf_dir, "runs")))
    return df.select("run_id", "job_id", F.round("value", 6).alias("value"), "n")


@query(with_("runs") + """ SELECT job_id, count(*) AS runs, median(duration_s) AS median, round(quantile_cont(duration_s, 0.95), 6) AS p95, max(duration_s) AS slowest, list_sort(list(duration_s))[-2] AS second, round(max(duration_s) / quantile_cont(duration_s, 0.95), 4) AS factor FROM runs GROUP BY job_id""")
def run_facts(spark, sf_dir):
    return B.run_facts(fixture(spark, sf_dir, "runs")).withColumn("p95", F.round("p95", 6))
