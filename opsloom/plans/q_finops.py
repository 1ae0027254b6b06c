"""Queries of costs, allocation and savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.columns import share
from opsloom.operators import finops as P
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query

_NOW = "TIMESTAMP '1997-06-01 00:00:00'"


def now():
    """The fixed instant of these queries."""
    return F.to_timestamp(F.lit("1997-06-01 00:00:00"))
_PRICED = with_("usage", "prices") + ", priced AS (SELECT u.*, p.price_cents, p.currency, u.usage_quantity * p.price_cents AS cost FROM usage u LEFT JOIN prices p ON p.sku_name = u.sku_name AND u.usage_start >= p.price_start AND (p.price_end IS NULL OR u.usage_start < p.price_end))"


def priced(spark, sf_dir, current=False):
    """Usage priced in whole cents, so that sums are exact in either engine."""
    prices = fixture(spark, sf_dir, "prices").withColumnRenamed("price_cents", "price")
    return P.priced_usage(fixture(spark, sf_dir, "usage"), prices, current)


def _cents(c: str = "cost"):
    return F.col(c).cast("bigint").alias(c)


@query(_PRICED + " SELECT usage_id, currency, CAST(cost AS bigint) AS cost FROM priced")
def priced_usage(spark, sf_dir):
    return priced(spark, sf_dir).select("usage_id", "currency", _cents())


@query(with_("usage", "prices") + " SELECT usage_id, CAST(usage_quantity * price_cents AS bigint) AS cost FROM usage u LEFT JOIN prices p ON p.sku_name = u.sku_name AND p.price_end IS NULL")
def current_priced_usage(spark, sf_dir):
    return priced(spark, sf_dir, True).select("usage_id", _cents())


@query(_PRICED + " SELECT CAST(sum(cost) AS bigint) AS cost, CAST(sum(CASE WHEN cost IS NULL THEN usage_quantity ELSE 0 END) AS bigint) AS unpriced_quantity, array_to_string(list_sort(list(DISTINCT currency) FILTER (currency IS NOT NULL)), ',') AS currencies, CAST(max(usage_end) AS string) AS watermark FROM priced")
def period_totals(spark, sf_dir):
    return P.period_total(priced(spark, sf_dir)).select(_cents(), F.col("unpriced_quantity").cast("bigint").alias("unpriced_quantity"), F.array_join("currencies", ",").alias("currencies"), F.col("watermark").cast("string").alias("watermark"))


@query(_PRICED + " SELECT run_id, CAST(sum(usage_quantity) AS bigint) AS quantity, CAST(sum(cost) AS bigint) AS cost FROM priced WHERE run_id IS NOT NULL AND cost IS NOT NULL GROUP BY 1")
def billing_facts(spark, sf_dir):
    return P.billing_facts(priced(spark, sf_dir)).select("run_id", "quantity", _cents())


@query(_PRICED + " SELECT job_id, CAST(CAST(usage_start AS date) AS string) AS day, CAST(sum(cost) AS bigint) AS cost, count(DISTINCT run_id) AS runs FROM priced WHERE job_id IS NOT NULL GROUP BY 1, 2")
def job_daily_costs(spark, sf_dir):
    return P.job_daily_costs(priced(spark, sf_dir)).select("job_id", F.col("day").cast("string").alias("day"), _cents(), "runs")


@query(_PRICED + " SELECT warehouse_id, CAST(date_trunc('hour', usage_start) AS string) AS hour, CAST(sum(cost) AS bigint) AS cost FROM priced WHERE warehouse_id IS NOT NULL GROUP BY 1, 2")
def warehouse_hours(spark, sf_dir):
    return P.warehouse_hours(priced(spark, sf_dir)).select("warehouse_id", F.col("hour").cast("string").alias("hour"), _cents())


_BUSY = with_("queries_log") + ", busy AS (SELECT DISTINCT warehouse_id, unnest(generate_series(date_trunc('hour', start_time), date_trunc('hour', greatest(coalesce(end_time, TIMESTAMP '2024-01-31 00:00:00'), start_time)), INTERVAL '1' HOUR)) AS hour FROM queries_log WHERE event_id % 50 <> 0 OR start_time > TIMESTAMP '2024-01-29 00:00:00')"


def _busy(spark, sf_dir):
    q = fixture(spark, sf_dir, "queries_log").filter("event_id % 50 <> 0 or start_time > timestamp '2024-01-29 00:00:00'")
    return P.busy_hours(q, F.to_timestamp(F.lit("2024-01-31 00:00:00")))


@query(_BUSY + " SELECT warehouse_id, CAST(hour AS string) AS hour FROM busy")
def busy_hours(spark, sf_dir):
    return _busy(spark, sf_dir).withColumn("hour", F.col("hour").cast("string"))


_LINES = _PRICED + """, l AS (SELECT *, CASE WHEN job_id IS NOT NULL THEN 'job' WHEN pipeline_id IS NOT NULL THEN 'pipeline' WHEN warehouse_id IS NOT NULL THEN 'warehouse' WHEN app_id IS NOT NULL THEN 'app' ELSE 'none' END AS kind, coalesce(job_id, pipeline_id, warehouse_id, app_id) AS rid FROM priced),
    a AS (SELECT *, CASE WHEN rid = 'job-19' THEN NULL ELSE rid END AS name, CAST(regexp_extract(coalesce(rid, ''), '[0-9]+$') AS string) AS n FROM l),
    c AS (SELECT *, CASE WHEN kind = 'job' AND n IN ('1', '2') THEN 'nao_alocado' WHEN kind = 'job' AND n IN ('0', '3', '4') THEN 'dominio' WHEN kind = 'job' AND n IN ('5', '6') THEN 'contrato' WHEN rid IN ('job-7', 'wh-0', 'app-1') THEN 'plataforma' ELSE 'nao_alocado' END AS category FROM a),
    d AS (SELECT *, CASE category WHEN 'dominio' THEN 'd' || CASE WHEN n = '0' THEN '0' ELSE '1' END WHEN 'contrato' THEN 'own' WHEN 'plataforma' THEN 'platform' END AS destination,
      CASE WHEN category <> 'nao_alocado' THEN NULL WHEN kind = 'job' AND n IN ('1', '2') THEN 'conflito' WHEN kind = 'none' THEN 'recurso não identificado' WHEN kind = 'job' AND name IS NULL THEN 'sem regra: job ' || rid || ' sem nome' WHEN kind = 'job' THEN 'sem regra: ' || name ELSE kind || ' ' || rid END AS reason FROM c)"""


def _allocated(spark, sf_dir):
    lines = P.resource_lines(priced(spark, sf_dir)).withColumn("resource_name", F.expr("case when resource_id <> 'job-19' then resource_id end"))
    files = spark.createDataFrame([("f0", "d0", ["job-0", "[dev a] Job-1", "job-2-prod"]), ("f1", "d1", ["job-1", "job-2", "job-3", "job-4"])], "file string, target string, jobs array<string>")
    owners = spark.createDataFrame([("job-5", "c1", "own"), ("job-5", "c2", "other"), ("job-6", "c3", "own"), ("job-3", "c4", "x")], "name string, contract_id string, owner string")
    pool = spark.createDataFrame([("job", "job-7"), ("warehouse", "wh-0"), ("app", "app-1")], "kind string, id string")
    return P.allocate(lines, P.allocation_rules(files), owners, pool)


@query(_LINES + " SELECT usage_id, kind AS resource_kind, rid AS resource_id FROM l")
def resource_lines(spark, sf_dir):
    return P.resource_lines(priced(spark, sf_dir)).select("usage_id", "resource_kind", "resource_id")


@query(_LINES + " SELECT usage_id, category, destination, reason FROM d")
def allocated_usage(spark, sf_dir):
    return _allocated(spark, sf_dir).select("usage_id", "category", "destination", "reason")


@query(_LINES + " SELECT category, destination, kind AS resource_kind, rid AS resource_id, CAST(sum(cost) AS bigint) AS cost FROM d GROUP BY 1, 2, 3, 4")
def allocation_rows(spark, sf_dir):
    return P.allocation_rows(_allocated(spark, sf_dir)).withColumn("cost", F.col("cost").cast("bigint"))


@query(_LINES + " SELECT CAST(sum(CASE WHEN category IN ('dominio', 'contrato') THEN cost END) AS bigint) AS allocated, CAST(sum(CASE WHEN category = 'plataforma' THEN cost END) AS bigint) AS platform, CAST(sum(CASE WHEN category = 'nao_alocado' THEN cost END) AS bigint) AS unallocated, round(sum(CASE WHEN category IN ('dominio', 'contrato') THEN cost END) / sum(CASE WHEN category <> 'plataforma' THEN cost END), 8) AS share FROM d")
def allocation_totals(spark, sf_dir):
    t = P.totals(_allocated(spark, sf_dir))
    return t.select(*[_cents(c) for c in ("allocated", "platform", "unallocated")], F.round("share", 8).alias("share"))


@query(_PRICED + " SELECT CAST(sum(cost) AS bigint) AS cost, CAST(0 AS double) AS gap, count(DISTINCT currency) <= 1 AS reconciled FROM priced")
def reconciled(spark, sf_dir):
    p = priced(spark, sf_dir)
    return P.reconcile(_allocated(spark, sf_dir), P.period_total(p)).select(_cents(), "gap", "reconciled")


@query("SELECT CAST(c_custkey AS int) AS k, CAST(date_trunc('month', d) - INTERVAL '1' MONTH AS string) AS previous, CAST(date_trunc('month', d) AS string) AS this, CAST(date_trunc('month', d) + INTERVAL '1' MONTH AS string) AS following FROM (SELECT c_custkey, TIMESTAMP '1996-12-15 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 60 AS int) AS d FROM customer) AS x")
def billing_periods(spark, sf_dir):
    d = F.expr("timestamp '1996-12-15 00:00:00' + interval '1' day * cast(c_custkey % 60 as int)")
    (a, b), (_, c) = P.periods(d)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("k"), a.cast("string").alias("previous"), b.cast("string").alias("this"), c.cast("string").alias("following"))


_COSTS = with_("runs") + ", c AS (SELECT *, CAST(run_id AS bigint) AS n, CASE WHEN CAST(run_id AS bigint) % 13 <> 0 THEN CAST(1 + CAST(run_id AS bigint) % 97 AS double) END AS cost FROM runs)"


def _costed(spark, sf_dir):
    return fixture(spark, sf_dir, "runs").withColumn("n", F.col("run_id").cast("bigint")).withColumn("cost", F.expr("case when n % 13 <> 0 then cast(1 + n % 97 as double) end"))


@query(_COSTS + " SELECT job_id, count(*) AS n, median(cost) AS median_run, round(avg(cost), 8) AS mean_run, round(median(cost / (input_rows / 1e6)), 8) AS median_million, round(sum(cost) / sum(input_rows / 1e6), 8) AS mean_million, false AS sucesso_nao_verificado, count(*) < 5 AS amostra_pequena FROM c WHERE cost IS NOT NULL AND result_state = 'SUCCESS' GROUP BY 1")
def unit_costs(spark, sf_dir):
    return P.unit_costs(_costed(spark, sf_dir)).withColumns({c: F.round(c, 8) for c in ("mean_run", "median_million", "mean_million")})


@query(_PRICED + ", u AS (SELECT warehouse_id AS r, sku_name AS s, sum(usage_quantity) AS q, sum(cost) AS c FROM priced WHERE warehouse_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT r, sum(q) AS q, sum(c) AS c FROM u GROUP BY 1) SELECT u.r AS resource_id, u.s AS consumer, round(u.q / t.q, 8) AS share, round(t.c * (u.q / t.q), 2) AS cost FROM u JOIN t ON t.r = u.r")
def shared_costs(spark, sf_dir):
    p = priced(spark, sf_dir).filter("warehouse_id is not null").withColumn("resource_id", F.col("warehouse_id")).withColumn("consumer", F.col("sku_name"))
    return P.share_allocation(p, p, "usage_quantity").withColumns({"share": F.round("share", 8), "cost": F.round("cost", 2)})


@query(_COSTS + ", i AS (SELECT job_id, CAST(n % 9 AS double) - 2 AS x, n FROM c WHERE n % 29 = 0), r AS (SELECT job_id, count(*) AS r30 FROM c GROUP BY 1) SELECT i.job_id, count(*) AS n, round(median(x) * max(r30), 4) AS saving, CASE WHEN count(*) < 5 THEN round(min(x) * max(r30), 4) END AS low, CASE WHEN count(*) < 5 THEN round(max(x) * max(r30), 4) END AS high FROM i JOIN r ON r.job_id = i.job_id WHERE x > 0 GROUP BY 1")
def regression_savings(spark, sf_dir):
    c = _costed(spark, sf_dir)
    return P.regression_savings(c.filter("n % 29 = 0").selectExpr("job_id", "cast(n % 9 as double) - 2 incremental_cost"), c.groupBy("job_id").agg(F.count(F.lit(1)).alias("runs_30d")))


@query(_COSTS + " SELECT job_id, count(*) AS failed, sum(cost) AS saving FROM c WHERE result_state <> 'SUCCESS' AND cost IS NOT NULL GROUP BY 1")
def failed_run_savings(spark, sf_dir):
    return P.failed_run_savings(_costed(spark, sf_dir))


@query("SELECT 'j' || CAST(c_custkey AS string) AS job_id, CASE c_custkey % 3 WHEN 0 THEN '[dev a] load' ELSE 'load-staging' END AS job_name, c_acctbal AS cost FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 5 <> 0 AND c_acctbal > 0")
def nonprod_schedules(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    jobs = c.selectExpr("'j' || c_custkey job_id", "case c_custkey % 3 when 0 then '[dev a] load' when 1 then 'load-staging' else 'load' end job_name", "c_custkey % 5 = 0 paused")
    return P.nonprod_schedule(jobs, c.selectExpr("'j' || c_custkey job_id", "c_acctbal cost"))


@query(_BUSY + ", h AS (SELECT DISTINCT 'wh-' || CAST(user_id % 5 AS string) AS warehouse_id, date_trunc('hour', ts) AS hour FROM events), i AS (SELECT h.* FROM h LEFT JOIN busy b ON b.warehouse_id = h.warehouse_id AND b.hour = h.hour WHERE b.hour IS NULL) SELECT warehouse_id, count(*) AS idle_hours, CAST(count(*) * 3 AS bigint) AS saving FROM i GROUP BY 1")
def idle_warehouses(spark, sf_dir):
    billed = table(spark, sf_dir, "events").select(F.expr("'wh-' || (user_id % 5)").alias("warehouse_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).distinct().withColumn("cost", F.lit(3))
    return P.idle_warehouse(billed, _busy(spark, sf_dir))


_OPP = "WITH o AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'schedule' WHEN 1 THEN 'failed_runs' ELSE 'regression' END AS source, 'job-' || CAST(c_custkey % 90 AS string) AS subject, 'm' || CAST(c_custkey % 6 AS string) AS month, CAST(floor(c_acctbal) AS double) AS saving, c_custkey FROM customer)"


def _opps(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("case c_custkey % 4 when 0 then 'schedule' when 1 then 'failed_runs' else 'regression' end source", "'job-' || (c_custkey % 90) subject", "'m' || (c_custkey % 6) month", "cast(floor(c_acctbal) as double) saving", "c_custkey")


@query(_OPP + " SELECT source, count(CASE WHEN saving >= 3000 THEN 1 END) AS shown, count(CASE WHEN saving < 3000 THEN 1 END) AS below, coalesce(sum(CASE WHEN saving < 3000 THEN saving END), 0) AS below_sum FROM o GROUP BY 1")
def savings_threshold(spark, sf_dir):
    return P.split_by_threshold(_opps(spark, sf_dir), 3000.0)


@query(_OPP + " SELECT c_custkey, source = 'schedule' OR max(CASE WHEN source = 'schedule' THEN 1 ELSE 0 END) OVER (PARTITION BY subject, month) = 0 AS counted FROM o")
def exclusion_groups(spark, sf_dir):
    return P.exclusion_groups(_opps(spark, sf_dir)).select("c_custkey", "counted")


@query(_OPP + ", i AS (SELECT source, subject, CASE WHEN c_custkey % 90 % 5 = 0 THEN 'discarded' WHEN c_custkey % 90 % 5 = 1 THEN 'approved' ELSE 'identified' END AS status FROM o) SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.source = o.source AND i.subject = o.subject AND i.status = 'approved') THEN 'em_iniciativa' ELSE 'aberta' END AS state FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.source = o.source AND i.subject = o.subject AND i.status = 'discarded')")
def linked_initiatives(spark, sf_dir):
    o = _opps(spark, sf_dir)
    i = o.selectExpr("source", "subject", "case when c_custkey % 90 % 5 = 0 then 'discarded' when c_custkey % 90 % 5 = 1 then 'approved' else 'identified' end status")
    return P.link_initiatives(o, i).select("c_custkey", "state")


@query("SELECT 's' || CAST(c_custkey AS string) AS subject, CASE WHEN c_custkey % 4 = 0 THEN 'alto' WHEN c_custkey % 4 = 1 OR c_custkey % 4 = 2 THEN 'medio' ELSE 'baixo' END AS risk FROM customer")
def savings_risks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("'s' || c_custkey subject", "'s' || c_custkey origin", "c_custkey % 4 k")
    kind = F.when(F.col("k") == 3, F.lit("job")).otherwise(F.lit("dashboard"))
    return P.savings_risk(c.select("subject"), c.filter("k = 0").select("origin", kind.alias("entity_type")), c.filter("k <> 1").select("origin", kind.alias("entity_type")))


@query(_COSTS + f""", i AS (SELECT 'i' || CAST(c_custkey AS string) AS initiative_id, 'job-' || CAST(c_custkey % 20 AS string) AS job_id, {_NOW} - INTERVAL '1' DAY * CAST(c_custkey % 90 AS int) AS at_, CAST(c_custkey % 50 AS double) AS icost FROM customer),
    m AS (SELECT i.initiative_id, i.at_, i.icost, list(c.cost) FILTER (c.end_time >= at_ - INTERVAL '14' DAY AND c.end_time < at_ AND c.cost IS NOT NULL) AS b, list(c.cost) FILTER (c.end_time >= at_ AND c.end_time < at_ + INTERVAL '14' DAY AND c.cost IS NOT NULL) AS a, list(c.cost) FILTER (c.end_time >= at_ AND c.end_time < least({_NOW}, at_ + INTERVAL '60' DAY) AND c.cost IS NOT NULL) AS f, count(*) FILTER (c.end_time > {_NOW} - INTERVAL '30' DAY AND c.end_time <= {_NOW}) AS v FROM i JOIN c ON c.job_id = i.job_id GROUP BY 1, 2, 3),
    n AS (SELECT *, coalesce(len(b), 0) AS nb, CASE WHEN coalesce(len(a), 0) >= 5 THEN a ELSE f END AS z FROM m), g AS (SELECT *, coalesce(len(z), 0) AS na, round((list_median(b) - list_median(z)) * v, 4) AS gross FROM n)
    SELECT initiative_id, CAST(nb AS int) AS n_before, CAST(na AS int) AS n_after, CASE WHEN nb >= 5 AND na >= 5 THEN gross END AS gross, CASE WHEN nb >= 5 AND na >= 5 THEN round(gross - icost, 4) END AS net, CASE WHEN {_NOW} < at_ + INTERVAL '14' DAY THEN 'em_medicao' WHEN nb < 5 OR na < 5 THEN CASE WHEN {_NOW} >= at_ + INTERVAL '60' DAY THEN 'expirada' ELSE 'amostra_insuficiente' END WHEN gross - icost <= 0 THEN 'nao_realizada' ELSE 'realizada' END AS status FROM g""".replace("list_median(", "list_aggregate(").replace("list_aggregate(b)", "list_aggregate(b, 'median')").replace("list_aggregate(z)", "list_aggregate(z, 'median')"))
def savings_realization(spark, sf_dir):
    i = table(spark, sf_dir, "customer").selectExpr("'i' || c_custkey initiative_id", "'job-' || (c_custkey % 20) job_id", "timestamp '1997-06-01 00:00:00' - interval '1' day * cast(c_custkey % 90 as int) implemented_at", "cast(c_custkey % 50 as double) cost")
    return P.measure_realization(i, _costed(spark, sf_dir), now())


@query("SELECT c_custkey AS initiative_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 IN (0, 1) THEN CASE c_custkey % 3 WHEN 0 THEN 'approved' ELSE 'discarded' END WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 2 THEN 'implemented' WHEN c_custkey % 2 = 0 THEN 'identified' ELSE 'approved' END AS status, c_custkey % 2 = 0 AND c_custkey % 3 = 0 AND c_custkey % 5 = 0 AS self_approved FROM customer")
def decided_initiatives(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    i = c.selectExpr("c_custkey initiative_id", "case when c_custkey % 2 = 0 then 'identified' else 'approved' end status", "'o' owner")
    d = c.selectExpr("c_custkey initiative_id", "case c_custkey % 3 when 0 then 'approved' when 1 then 'discarded' else 'implemented' end decision", "case when c_custkey % 5 = 0 then 'o' else 'x' end actor")
    return P.decide(i, d)[0].select("initiative_id", "status", "self_approved")


@query(_COSTS + " SELECT job_id, round(count(CASE WHEN result_state = 'SUCCESS' THEN 1 END) / count(*), 8) AS success FROM c GROUP BY 1")
def success_shares(spark, sf_dir):
    g = _costed(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.col("result_state") == "SUCCESS").alias("a"), F.count(F.lit(1)).alias("b"))
    return g.select("job_id", F.round(share(F.col("a"), F.col("b")), 8).alias("success"))


# --- unit costs by unit, windows, allocation, detectors


@query(_COSTS + """, k AS (SELECT *, CASE WHEN job_id IN ('job-1', 'job-2') THEN NULL ELSE result_state END AS st FROM c WHERE cost IS NOT NULL), g AS (SELECT *, max(CASE WHEN st IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY job_id) AS known FROM k),
    h AS (SELECT * FROM g WHERE known = 0 OR st = 'SUCCESS')
    SELECT 'por_run' AS unit, job_id AS subject, median(cost) AS median, round(avg(cost), 8) AS mean, count(*) AS n, CASE WHEN max(known) = 0 THEN 'sucesso_nao_verificado' WHEN count(*) < 5 THEN 'amostra_pequena' ELSE 'medido' END AS status FROM h GROUP BY job_id
    UNION ALL SELECT 'por_milhao_linhas', job_id, round(median(cost / input_rows * 1e6), 8), round(sum(cost) / sum(input_rows) * 1e6, 8), count(*), CASE WHEN max(known) = 0 THEN 'sucesso_nao_verificado' WHEN count(*) < 5 THEN 'amostra_pequena' ELSE 'medido' END FROM h GROUP BY job_id
    UNION ALL SELECT 'por_ciclo', job_id, median(cost), round(avg(cost), 8), count(*), CASE WHEN max(known) = 0 THEN 'sucesso_nao_verificado' WHEN count(*) < 5 THEN 'amostra_pequena' ELSE 'medido' END FROM h WHERE job_id = 'job-7' GROUP BY job_id""")
def unit_cost_rows(spark, sf_dir):
    runs = _costed(spark, sf_dir).withColumns({"job_name": F.col("job_id"), "result_state": F.expr("case when job_id in ('job-1', 'job-2') then null else result_state end")})
    return P.unit_cost_rows(runs, ["job-7"]).withColumns({"median": F.round("median", 8), "mean": F.round("mean", 8)})


@query(with_("incidents") + """ SELECT median(c) AS median, round(avg(c), 8) AS mean, count(c) AS n, 'medido' AS status FROM (SELECT incident_id, sum(CAST(event_id % 100 AS double) + CAST(event_id % 7 AS double)) AS c FROM incidents
    WHERE detected_at >= TIMESTAMP '2024-01-05 00:00:00' AND detected_at < TIMESTAMP '2024-01-20 00:00:00' AND event_id % 3 <> 0 GROUP BY 1) AS x""")
def incident_unit_costs(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    costs = i.selectExpr("incident_id", "case when event_id % 3 = 0 then 'pending' else 'available' end status", "explode(array(cast(event_id % 100 as double), cast(event_id % 7 as double))) incremental_cost")
    return P.incident_unit_cost(i, costs, F.expr("timestamp '2024-01-05 00:00:00'"), F.expr("timestamp '2024-01-20 00:00:00'")).withColumn("mean", F.round("mean", 8))


@query(_COSTS + f""", d AS (SELECT job_id, CAST(least(greatest(floor((epoch({_NOW}) - floor(epoch(min(start_time)))) / 86400), 1), 30) AS int) AS days, count(CASE WHEN start_time >= {_NOW} - INTERVAL '30' DAY THEN 1 END) AS runs FROM c WHERE start_time <= {_NOW} GROUP BY job_id)
    SELECT job_id, days, runs FROM d WHERE runs > 0""")
def window_figures(spark, sf_dir):
    runs = _costed(spark, sf_dir).filter("start_time <= timestamp '1997-06-01 00:00:00'")
    return P.days_observed(runs, now()).join(P.runs_in_window(runs, now()), "job_id")


@query(_PRICED + """ SELECT job_id, CAST(coalesce(sum(CASE WHEN CAST(usage_start AS date) >= DATE '1997-05-02' THEN cost END), 0) AS bigint) AS cost, CAST(least(greatest(date_diff('day', min(CAST(usage_start AS date)), DATE '1997-06-01') + 1, 1), 30) AS int) AS days
    FROM priced WHERE job_id IS NOT NULL AND usage_start < TIMESTAMP '1997-06-01 00:00:00' GROUP BY job_id""")
def job_window_costs(spark, sf_dir):
    daily = P.job_daily_costs(priced(spark, sf_dir).filter("usage_start < timestamp '1997-06-01 00:00:00'"))
    return P.job_costs_window(daily, now()).select("job_id", _cents(), "days")


@query(_BUSY + """, b AS (SELECT DISTINCT 'wh-' || CAST(user_id % 5 AS string) AS warehouse_id, date_trunc('hour', ts) AS hour FROM events)
    SELECT b.warehouse_id, CAST(CAST(b.hour AS date) AS string) AS day, CAST(3 * count(*) AS bigint) AS cost FROM b WHERE NOT EXISTS (SELECT 1 FROM busy x WHERE x.warehouse_id = b.warehouse_id AND x.hour = b.hour) GROUP BY 1, 2""")
def idle_days(spark, sf_dir):
    billed = table(spark, sf_dir, "events").select(F.expr("'wh-' || (user_id % 5)").alias("warehouse_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).distinct().withColumn("cost", F.lit(3))
    return P.idle_daily(billed, _busy(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(_OPP + """, s AS (SELECT source, count(CASE WHEN saving >= 3000 THEN 1 END) AS shown, count(CASE WHEN saving < 3000 THEN 1 END) AS below, coalesce(sum(CASE WHEN saving < 3000 THEN saving END), 0) AS below_sum FROM o WHERE source <> 'schedule' GROUP BY 1)
    SELECT source, 'avaliado' AS status, shown, below, below_sum FROM s UNION ALL SELECT 'schedule', 'nao_avaliado', NULL, NULL, NULL UNION ALL SELECT 'idle', 'avaliado', 0, 0, 0""")
def detector_states(spark, sf_dir):
    outcomes = P.split_by_threshold(_opps(spark, sf_dir), 3000.0)
    kinds = spark.createDataFrame([("regression", True), ("failed_runs", True), ("schedule", False), ("idle", True)], "source string, available boolean")
    return P.detector_status(outcomes, kinds)


@query("""WITH j AS (SELECT DISTINCT c_custkey % 9 AS f, 'job-' || CAST(c_custkey % 60 AS string) AS name FROM customer), g AS (SELECT name, count(CASE WHEN f % 3 <> 0 THEN 1 END) AS n, min(CASE WHEN f % 3 <> 0 THEN f END) AS f FROM j GROUP BY name)
    SELECT name, CASE WHEN n = 1 THEN 'd' || CAST(f AS string) END AS target, CASE WHEN n = 0 THEN 'arquivo_recusado' WHEN n > 1 THEN 'conflito' ELSE 'ativa' END AS status FROM g""")
def allocation_rule_states(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("'f' || (c_custkey % 9) file", "'d' || (c_custkey % 9) target", "'job-' || (c_custkey % 60) job", "c_custkey % 9 k")
    files = c.groupBy("file", "target").agg(F.collect_set("job").alias("jobs"))
    return P.allocation_rules(files, c.filter("k % 3 = 0").select("file").distinct())


@query(_PRICED + """, t AS (SELECT warehouse_id AS r, CAST(sum(cost) AS double) AS c FROM priced WHERE warehouse_id IS NOT NULL GROUP BY 1)
    SELECT r AS resource_id, consumer, share, round(c * share, 4) AS cost FROM t, (SELECT 'a' AS consumer, CAST(0.5 AS double) AS share UNION ALL SELECT 'b', 0.3 UNION ALL SELECT NULL, 0.2) AS s""")
def fixed_shares(spark, sf_dir):
    p = priced(spark, sf_dir).filter("warehouse_id is not null").withColumn("resource_id", F.col("warehouse_id"))
    shares = p.select("resource_id").distinct().select("resource_id", F.explode(F.array(*[F.struct(F.lit(c).alias("consumer"), F.lit(x).alias("percent")) for c, x in (("a", 50.0), ("b", 30.0))])).alias("s")).select("resource_id", "s.*")
    return P.fixed_allocation(p, shares).withColumns({"share": F.round("share", 8), "cost": F.round("cost", 4)})


@query(_PRICED + """, t AS (SELECT warehouse_id AS r, CAST(sum(cost) AS double) AS c, count(*) AS n FROM priced WHERE warehouse_id IS NOT NULL GROUP BY 1), u AS (SELECT warehouse_id AS r, sku_name AS s, count(*) AS n FROM priced WHERE warehouse_id IS NOT NULL GROUP BY 1, 2)
    SELECT u.r AS resource_id, u.s AS consumer, round(u.n / t.n, 8) AS share, round(t.c * u.n / t.n, 2) AS cost FROM u JOIN t ON t.r = u.r""")
def activity_shares(spark, sf_dir):
    p = priced(spark, sf_dir).filter("warehouse_id is not null").withColumn("resource_id", F.col("warehouse_id")).withColumn("consumer", F.col("sku_name"))
    return P.activity_allocation(p, p).withColumns({"share": F.round("share", 8), "cost": F.round("cost", 2)})
