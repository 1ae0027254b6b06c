"""Priced usage, allocation, reconciliation, unit costs, savings and their measurement.

Money is DECIMAL(38,10) inside; ``money`` rounds half to even at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.columns import normalized_job
from opsloom.functions.quantiles import INCLUSIVE, exact_quantiles

DEC = "decimal(38,10)"


def money(c: Column, places: int = 4) -> Column:
    return F.bround(c.cast(DEC), places)


def priced_usage(usage: DataFrame, prices: DataFrame, current: bool = False) -> DataFrame:
    """Usage with the price in force at its start ([start, end)), or with the current one; unpriced rows stay.

    Prices are joined by sku, cloud and usage unit (those of the three that both tables have, so that a sku on two clouds is
    not priced twice); a key has few price periods, so the range condition only picks among those.
    """
    keys = [k for k in ("sku_name", "cloud", "usage_unit") if k in usage.columns and k in prices.columns]
    p = prices.select(*[F.col(k).alias(f"_{k}") for k in keys], "price", "currency", "price_start", "price_end")
    span = F.col("price_end").isNull() if current else (F.col("usage_start") >= F.col("price_start")) & (F.col("price_end").isNull() | (F.col("usage_start") < F.col("price_end")))
    for k in keys:
        span = (F.col(k) == F.col(f"_{k}")) & span
    df = usage.join(p, span, "left").drop(*[f"_{k}" for k in keys], "price_start", "price_end")
    return df.withColumn("cost", (F.col("usage_quantity").cast(DEC) * F.col("price").cast(DEC)).cast(DEC))


def period_total(priced: DataFrame) -> DataFrame:
    """One row: cost, unpriced quantity, currencies, watermark."""
    return priced.agg(F.sum("cost").alias("cost"), F.sum(F.when(F.col("cost").isNull(), F.col("usage_quantity")).otherwise(0)).alias("unpriced_quantity"), F.array_sort(F.collect_set("currency")).alias("currencies"), F.max("usage_end").alias("watermark"))


def billing_facts(priced: DataFrame) -> DataFrame:
    return priced.filter("run_id is not null and cost is not null").groupBy("run_id").agg(F.sum("usage_quantity").alias("quantity"), F.sum("cost").alias("cost"))


def job_daily_costs(priced: DataFrame) -> DataFrame:
    return priced.filter("job_id is not null").groupBy("job_id", F.to_date("usage_start").alias("day")).agg(F.sum("cost").alias("cost"), F.countDistinct("run_id").alias("runs"))


def warehouse_hours(priced: DataFrame) -> DataFrame:
    return priced.filter("warehouse_id is not null").groupBy("warehouse_id", F.date_trunc("hour", "usage_start").alias("hour")).agg(F.sum("cost").alias("cost"))


def busy_hours(queries: DataFrame, now: Column) -> DataFrame:
    """Distinct (warehouse, hour) overlapped by a query; one that still runs is busy until now."""
    end = F.coalesce(F.col("end_time").cast("timestamp"), now.cast("timestamp"))
    hours = F.sequence(F.date_trunc("hour", F.col("start_time").cast("timestamp")), F.date_trunc("hour", F.greatest(end, F.col("start_time").cast("timestamp"))), F.expr("INTERVAL '1' HOUR"))
    return queries.select("warehouse_id", F.explode(hours).alias("hour")).distinct()


def resource_lines(priced: DataFrame) -> DataFrame:
    """Adds resource_kind (job, pipeline, warehouse, app, none, in that order) and resource_id."""
    kind = F.when(F.col("job_id").isNotNull(), F.lit("job")).when(F.col("pipeline_id").isNotNull(), F.lit("pipeline")).when(F.col("warehouse_id").isNotNull(), F.lit("warehouse")).when(F.col("app_id").isNotNull(), F.lit("app")).otherwise(F.lit("none"))
    return priced.withColumns({"resource_kind": kind, "resource_id": F.coalesce("job_id", "pipeline_id", "warehouse_id", "app_id")})


def allocation_rules(files: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """name, target, status: jobs of allocation files; a job in two files is a conflict for that job only.

    Jobs named only in files that were refused (``refused``: file) have no target and the status arquivo_recusado.
    """
    if refused is not None:
        out = allocation_rules(files.join(refused.select("file"), "file", "left_anti"))
        lost = files.join(refused.select("file"), "file", "left_semi").select(F.explode("jobs").alias("job")).select(normalized_job(F.col("job")).alias("name")).distinct()
        return out.unionByName(lost.join(out, "name", "left_anti").select("name", F.lit(None).cast("string").alias("target"), F.lit("arquivo_recusado").alias("status")))
    per = files.select("file", "target", F.explode("jobs").alias("job")).groupBy(normalized_job(F.col("job")).alias("name")).agg(F.countDistinct("file").alias("n"), F.min("target").alias("target"))
    return per.select("name", F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") > 1, F.lit("conflito")).otherwise(F.lit("ativa")).alias("status"))


def allocate(lines: DataFrame, rules: DataFrame, owners: DataFrame, platform: DataFrame) -> DataFrame:
    """Adds category, destination and reason to resource lines with a name; every line gets exactly one.

    Order for jobs: conflict, domain rule, contract owner (lowest contract id), platform pool, unallocated. ``platform``
    lists (kind, id) of the pool; the small declaration tables are joined by name.
    """
    name = normalized_job(F.col("resource_name"))
    o = owners.groupBy("name").agg(F.min(F.struct("contract_id", "owner")).alias("o")).select("name", "o.owner")
    p = platform.select(F.col("kind").alias("resource_kind"), F.col("id").alias("_pid")).distinct().withColumn("_pool", F.lit(True))
    df = lines.withColumn("name", name).join(rules.select("name", F.col("target"), F.col("status").alias("_st")), "name", "left").join(o, "name", "left")
    df = df.withColumn("_pid", F.when(F.col("resource_kind").isin("job", "app"), F.col("name")).otherwise(F.col("resource_id"))).join(p, ["resource_kind", "_pid"], "left")
    job = F.col("resource_kind") == "job"
    category = (
        F.when(job & (F.col("_st") == "conflito"), F.lit("nao_alocado")).when(job & F.col("target").isNotNull(), F.lit("dominio")).when(job & F.col("owner").isNotNull(), F.lit("contrato"))
        .when(F.col("_pool"), F.lit("plataforma")).otherwise(F.lit("nao_alocado"))
    )
    reason = (
        F.when(F.col("category") != "nao_alocado", None).when(job & (F.col("_st") == "conflito"), F.lit("conflito")).when(F.col("resource_kind") == "none", F.lit("recurso não identificado"))
        .when(job & F.col("name").isNull(), F.concat(F.lit("sem regra: job "), F.col("resource_id"), F.lit(" sem nome"))).when(job, F.concat(F.lit("sem regra: "), F.col("name"))).otherwise(F.concat_ws(" ", F.col("resource_kind"), "resource_id"))
    )
    df = df.withColumn("category", category).withColumn("reason", reason)
    df = df.withColumn("destination", F.when(F.col("category") == "dominio", F.col("target")).when(F.col("category") == "contrato", F.col("owner")).when(F.col("category") == "plataforma", F.lit("platform")))
    return df.drop("_st", "_pid", "_pool", "target", "owner")


def allocation_rows(allocated: DataFrame) -> DataFrame:
    return allocated.groupBy("category", "destination", "resource_kind", "resource_id").agg(F.sum("cost").alias("cost"))


def totals(allocated: DataFrame) -> DataFrame:
    """Sums a category and the allocated share; the platform pool is outside of the denominator."""
    part = lambda *k: F.coalesce(F.sum(F.when(F.col("category").isin(*k), F.col("cost"))), F.lit(0).cast(DEC))
    df = allocated.agg(part("dominio", "contrato").alias("allocated"), part("plataforma").alias("platform"), part("nao_alocado").alias("unallocated"))
    base = F.col("allocated") + F.col("unallocated")
    return df.withColumn("share", F.when(base != 0, F.col("allocated").cast("double") / base.cast("double")))


def reconcile(allocated: DataFrame, total: DataFrame, share: float = 0.005, floor: float = 1.0) -> DataFrame:
    """Whether the allocation adds up to the independent total; more than one currency never does."""
    a = allocated.agg(F.sum("cost").alias("allocated"))
    df = total.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")
    gap = F.abs(F.col("cost") - F.col("allocated")).cast("double")
    ok = (F.size("currencies") <= 1) & (gap <= F.greatest(F.abs(F.col("cost")).cast("double") * share, F.lit(floor)))
    return df.withColumn("gap", gap).withColumn("reconciled", ok)


def periods(now: Column):
    """(start, end) columns of the month before and of this month, UTC."""
    this = F.date_trunc("month", now)
    return (F.add_months(this, -1).cast("timestamp"), this), (this, F.add_months(this, 1).cast("timestamp"))


def unit_costs(runs: DataFrame) -> DataFrame:
    """Per job: cost a run and a million rows (median and mean), over successes if there are any."""
    any_ok = F.max(F.col("result_state") == "SUCCESS").over(W.partitionBy("job_id"))
    df = runs.filter("cost is not null").withColumn("_any", any_ok).filter("not _any or result_state = 'SUCCESS'")
    million = F.col("input_rows") / 1e6
    out = df.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.median("cost").alias("median_run"), F.avg("cost").alias("mean_run"), F.median(F.when(F.col("input_rows") > 0, F.col("cost") / million)).alias("median_million"), (F.sum(F.when(F.col("input_rows") > 0, F.col("cost"))) / F.sum(F.when(F.col("input_rows") > 0, million))).alias("mean_million"), F.max(~F.col("_any")).alias("sucesso_nao_verificado"))
    return out.withColumn("amostra_pequena", F.col("n") < 5)


def measured_status(n: Column, verified: Column | None = None) -> Column:
    """sem_base, sucesso_nao_verificado (no run's state is known), amostra_pequena (under five) or medido."""
    unknown = F.lit(False) if verified is None else ~verified
    return F.when(n == 0, F.lit("sem_base")).when(unknown, F.lit("sucesso_nao_verificado")).when(n < 5, F.lit("amostra_pequena")).otherwise(F.lit("medido"))


def unit_cost_rows(runs: DataFrame, cycle_jobs: list[str] = ()) -> DataFrame:
    """(unit, subject, median, mean, n, status) a job: per run, per million rows and, for the named jobs, per cycle.

    ``runs`` has job_id, job_name, result_state (null: unknown), input_rows, cost. Successful runs count, or all of a job
    none of whose states is known. The mean a million rows is the sum of costs over the sum of rows.
    """
    priced = runs.filter("cost is not null").withColumn("cost", F.col("cost").cast("double"))
    known = priced.groupBy("job_id").agg((F.count("result_state") > 0).alias("_known"), F.min("job_name").alias("_name"))
    df = priced.join(known, "job_id")
    good = ~F.col("_known") | F.coalesce(F.col("result_state") == "SUCCESS", F.lit(False))
    sized = good & (F.col("input_rows") > 0)
    g = df.groupBy("job_id", "_name", "_known").agg(
        F.count_if(good).alias("n"), F.median(F.when(good, F.col("cost"))).alias("median"), F.avg(F.when(good, F.col("cost"))).alias("mean"),
        F.count_if(sized).alias("n_m"), F.median(F.when(sized, F.col("cost") / F.col("input_rows") * 1e6)).alias("median_m"),
        (F.sum(F.when(sized, F.col("cost"))) / F.sum(F.when(sized, F.col("input_rows"))) * 1e6).alias("mean_m"),
    )
    subject = F.coalesce("_name", "job_id").alias("subject")
    run = g.select(F.lit("por_run").alias("unit"), subject, "median", "mean", "n", measured_status(F.col("n"), F.col("_known")).alias("status"))
    status = F.when(F.col("n_m") == 0, F.lit("nao_medido")).otherwise(measured_status(F.col("n_m"), F.col("_known")))
    million = g.select(F.lit("por_milhao_linhas").alias("unit"), subject, F.col("median_m").alias("median"), F.col("mean_m").alias("mean"), F.col("n_m").alias("n"), status.alias("status"))
    out = run.unionByName(million)
    if cycle_jobs:
        out = out.unionByName(run.filter(normalized_job(F.col("subject")).isin(list(cycle_jobs))).withColumn("unit", F.lit("por_ciclo")))
    return out


def incident_unit_cost(incidents: DataFrame, run_costs: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row (median, mean, n, status): incremental cost an incident detected in [start, end); available costs only."""
    period = incidents.filter((F.col("detected_at") >= start) & (F.col("detected_at") < end)).select("incident_id").distinct()
    cost = run_costs.filter("status = 'available' and incremental_cost is not null").join(period, "incident_id", "left_semi")
    per = cost.groupBy("incident_id").agg(F.sum("incremental_cost").cast("double").alias("c"))
    return per.agg(F.median("c").alias("median"), F.avg("c").alias("mean"), F.count("c").alias("n")).withColumn("status", measured_status(F.col("n")))


# --- what a window of days has seen


def days_observed(runs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(job_id, days): whole days since the first run of a job, from 1 to the window."""
    seconds = now.cast("timestamp").cast("long") - F.min("start_time").cast("timestamp").cast("long")
    return runs.groupBy("job_id").agg(F.least(F.greatest(F.floor(seconds / 86400), F.lit(1)), F.lit(days)).cast("int").alias("days"))


def runs_in_window(runs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(job_id, runs) that started in the window."""
    return runs.filter(F.col("start_time") >= now - F.expr(f"INTERVAL '{days}' DAY")).groupBy("job_id").agg(F.count(F.lit(1)).alias("runs"))


def job_costs_window(daily: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(job_id, cost, runs, days) of daily job costs (job_id, day, cost, runs); days since the first one, 1 to the window."""
    inside = F.col("day") >= F.to_date(now - F.expr(f"INTERVAL '{days}' DAY"))
    seen = F.date_diff(F.to_date(now), F.min("day")) + 1
    return daily.groupBy("job_id").agg(F.coalesce(F.sum(F.when(inside, F.col("cost"))), F.lit(0)).alias("cost"), F.coalesce(F.sum(F.when(inside, F.col("runs"))), F.lit(0)).alias("runs"), F.least(F.greatest(seen, F.lit(1)), F.lit(days)).alias("days"))


def idle_daily(billed: DataFrame, busy: DataFrame) -> DataFrame:
    """(warehouse_id, day, cost) of billed hours without a query."""
    return billed.join(busy, ["warehouse_id", "hour"], "left_anti").groupBy("warehouse_id", F.to_date("hour").alias("day")).agg(F.sum("cost").alias("cost"))


def share_allocation(costs: DataFrame, usage: DataFrame, by: str) -> DataFrame:
    """Shared cost split by each consumer's part of a usage measure."""
    u = usage.groupBy("resource_id", "consumer").agg(F.sum(by).alias("u"))
    u = u.withColumn("share", F.col("u") / F.sum("u").over(W.partitionBy("resource_id")))
    return costs.groupBy("resource_id").agg(F.sum("cost").cast("double").alias("cost")).join(u, "resource_id").select("resource_id", "consumer", "share", (F.col("cost") * F.col("share")).alias("cost"))


def fixed_allocation(costs: DataFrame, shares: DataFrame) -> DataFrame:
    """Shared cost split by fixed percentages (resource_id, consumer, percent); what they leave over has no consumer."""
    total = costs.groupBy("resource_id").agg(F.sum("cost").cast("double").alias("cost"))
    given = shares.groupBy("resource_id", "consumer").agg((F.sum("percent") / 100.0).alias("share"))
    left = total.join(given.groupBy("resource_id").agg(F.sum("share").alias("_s")), "resource_id", "left").select("resource_id", F.lit(None).cast("string").alias("consumer"), F.round(1 - F.coalesce("_s", F.lit(0.0)), 10).alias("share")).filter("share > 0")
    return given.unionByName(left).join(total, "resource_id").select("resource_id", "consumer", "share", (F.col("cost") * F.col("share")).alias("cost"))


def activity_allocation(costs: DataFrame, events: DataFrame) -> DataFrame:
    """Shared cost split by how many events each consumer caused."""
    return share_allocation(costs, events.withColumn("_one", F.lit(1.0)), "_one")


# --- savings


def regression_savings(incremental: DataFrame, runs30: DataFrame) -> DataFrame:
    """Median incremental cost x runs of 30 days per job; a small sample gives a range."""
    per = incremental.filter("incremental_cost > 0").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.median("incremental_cost").alias("m"), F.min("incremental_cost").alias("lo"), F.max("incremental_cost").alias("hi"))
    df = per.join(runs30, "job_id")
    small = F.col("n") < 5
    return df.select("job_id", "n", F.round(F.col("m") * F.col("runs_30d"), 4).alias("saving"), F.when(small, F.round(F.col("lo") * F.col("runs_30d"), 4)).alias("low"), F.when(small, F.round(F.col("hi") * F.col("runs_30d"), 4)).alias("high"))


def failed_run_savings(runs: DataFrame) -> DataFrame:
    return runs.filter("result_state <> 'SUCCESS' and cost is not null").groupBy("job_id").agg(F.count(F.lit(1)).alias("failed"), F.sum("cost").alias("saving"))


def nonprod_schedule(jobs: DataFrame, costs: DataFrame) -> DataFrame:
    """Scheduled non-production jobs that cost something."""
    odd = F.lower("job_name").startswith("[dev ") | F.col("job_name").rlike(r"-(dev|staging)$")
    return jobs.filter(odd & ~F.col("paused")).join(costs, "job_id").filter("cost > 0").select("job_id", "job_name", "cost")


def idle_warehouse(billed: DataFrame, busy: DataFrame) -> DataFrame:
    """Cost of billed warehouse hours without a query."""
    return billed.join(busy, ["warehouse_id", "hour"], "left_anti").groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("idle_hours"), F.sum("cost").alias("saving"))


def split_by_threshold(opportunities: DataFrame, least: float) -> DataFrame:
    """Per source: shown and below-threshold counts and sums; small ones are counted, not dropped."""
    big = F.col("saving") >= least
    return opportunities.groupBy("source").agg(F.count_if(big).alias("shown"), F.count_if(~big).alias("below"), F.coalesce(F.sum(F.when(~big, F.col("saving"))), F.lit(0.0)).alias("below_sum"))


def exclusion_groups(opportunities: DataFrame) -> DataFrame:
    """Adds counted: within a (subject, month) the schedule saving contains the others."""
    has = F.max((F.col("source") == "schedule").cast("int")).over(W.partitionBy("subject", "month"))
    return opportunities.withColumn("counted", (F.col("source") == "schedule") | (has == 0))


def link_initiatives(opportunities: DataFrame, initiatives: DataFrame) -> DataFrame:
    """Discarded opportunities go; those of an active initiative are marked."""
    key = ["source", "subject"]
    gone = initiatives.filter("status = 'discarded'").select(*key).distinct()
    active = initiatives.filter("status in ('approved', 'implemented')").select(*key).distinct().withColumn("_a", F.lit(True))
    df = opportunities.join(gone, key, "left_anti").join(active, key, "left")
    return df.withColumn("state", F.when(F.col("_a"), F.lit("em_iniciativa")).otherwise(F.lit("aberta"))).drop("_a")


def savings_risk(subjects: DataFrame, confirmed: DataFrame, every: DataFrame) -> DataFrame:
    """alto when confirmed edges reach a dashboard, medio when only uncertain ones do or nothing is known, else baixo."""
    def hits(r, name):
        return r.groupBy(F.col("origin").alias("subject")).agg(F.max((F.col("entity_type") == "dashboard").cast("int")).alias(name))
    df = subjects.join(hits(confirmed, "c"), "subject", "left").join(hits(every, "e"), "subject", "left")
    return df.select("subject", F.when(F.col("c") == 1, F.lit("alto")).when(F.col("e").isNull() | (F.col("e") == 1), F.lit("medio")).otherwise(F.lit("baixo")).alias("risk"))


def measure_realization(initiatives: DataFrame, runs: DataFrame, now: Column, window: int = 14, most: int = 60) -> DataFrame:
    """initiative_id, n_before, n_after, gross, net, status of run-based initiatives.

    ``initiatives`` has initiative_id, job_id, implemented_at, cost; ``runs`` job_id, end_time, cost. Runs are met
    once for each job and instant and bounded to the windows before they are summed up.
    """
    anchor, day = F.col("implemented_at"), lambda n: F.expr(f"INTERVAL '{n}' DAY")
    anchors = initiatives.select("job_id", "implemented_at").distinct()
    met = anchors.join(runs.select("job_id", F.col("end_time").alias("_t"), F.col("cost").alias("_c")), "job_id", "left")
    limit = F.least(now, anchor + day(most))
    recent = (F.col("_t") > now - day(30)) & (F.col("_t") <= now)
    spans = {"b": (F.col("_t") >= anchor - day(window)) & (F.col("_t") < anchor), "a": (F.col("_t") >= anchor) & (F.col("_t") < anchor + day(window)), "f": (F.col("_t") >= anchor) & (F.col("_t") < limit)}
    key = ["job_id", "implemented_at"]
    counts = met.groupBy(*key).agg(F.count_if(recent).alias("volume"))
    told = met.filter("_c is not null").select(*key, F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in spans.items()]), lambda k: k.isNotNull())).alias("span"), "_c")
    middle = exact_quantiles(told, [*key, "span"], "_c", {"mid": (0.5, INCLUSIVE)})
    of = lambda k, c: F.max(F.when(F.col("span") == k, F.col(c)))
    wide = middle.groupBy(*key).agg(*[of(k, c).alias(f"{c}_{k}") for k in spans for c in ("n", "mid")])
    g = initiatives.join(counts, key).join(wide, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    near = zero("n_a") >= 5
    g = g.withColumns({"n_before": zero("n_b"), "n_after": F.when(near, zero("n_a")).otherwise(zero("n_f")), "_after": F.when(near, F.col("mid_a")).otherwise(F.col("mid_f"))})
    g = g.withColumn("gross", F.round((F.col("mid_b") - F.col("_after")) * F.col("volume"), 4))
    short = (F.col("n_before") < 5) | (F.col("n_after") < 5)
    net = F.round(F.col("gross") - F.coalesce("cost", F.lit(0.0)), 4)
    status = F.when(now < anchor + day(window), F.lit("em_medicao")).when(short & (now >= anchor + day(most)), F.lit("expirada")).when(short, F.lit("amostra_insuficiente")).when(net <= 0, F.lit("nao_realizada")).otherwise(F.lit("realizada"))
    return g.select("initiative_id", "n_before", "n_after", F.when(~short, F.col("gross")).alias("gross"), F.when(~short, net).alias("net"), status.alias("status"))


def decide(initiatives: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(initiatives after legal transitions, rejected decisions): identified -> approved or discarded, approved -> implemented."""
    legal = (F.col("status") == "identified") & F.col("decision").isin("approved", "discarded") | (F.col("status") == "approved") & (F.col("decision") == "implemented")
    df = initiatives.join(decisions.select("initiative_id", "decision", "actor"), "initiative_id", "left")
    after = df.withColumns({"self_approved": F.coalesce(legal & (F.col("decision") == "approved") & (F.col("actor") == F.col("owner")), F.lit(False)), "status": F.when(legal, F.col("decision")).otherwise(F.col("status"))})
    return after.drop("decision", "actor"), df.filter(F.col("decision").isNotNull() & ~F.coalesce(legal, F.lit(False))).select("initiative_id", "decision", "status")


def detector_status(outcomes: DataFrame, detectors: DataFrame) -> DataFrame:
    """(source, status, shown, below, below_sum) of every detector (source, available).

    A detector without its source is nao_avaliado, with null counts; one that found nothing is avaliado with 0.
    """
    df = detectors.join(outcomes, "source", "left")
    seen = lambda c: F.when(F.col("available"), F.coalesce(F.col(c), F.lit(0))).alias(c)
    return df.select("source", F.when(F.col("available"), F.lit("avaliado")).otherwise(F.lit("nao_avaliado")).alias("status"), seen("shown"), seen("below"), seen("below_sum"))
