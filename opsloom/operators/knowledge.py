"""Problems, similar incidents, runbooks, recommendations, semantic metrics and SLA prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.columns import stable_id
from opsloom.functions.formulas import formula_hash, metrics_of
from opsloom.functions.ordered import last_values, running_number
from opsloom.functions.quantiles import INCLUSIVE, exact_quantiles

# --- problems and knowledge


def problem_candidates(incidents: DataFrame, promoted: DataFrame, now: Column, days: int = 30, least: int = 3) -> DataFrame:
    """Signatures (type, subject, cause) with three incidents in the window, or promoted before."""
    recent = incidents.filter(F.col("detected_at") > now - F.expr(f"INTERVAL '{days}' DAY"))
    end = F.coalesce("ended_at", now)
    hours = (end.cast("timestamp").cast("long") - F.col("detected_at").cast("timestamp").cast("long")) / 3600.0
    out = recent.groupBy("type", "subject", "cause").agg(F.count(F.lit(1)).alias("n"), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"), F.round(F.sum("impact_score"), 4).alias("impact"), F.round(F.sum(hours), 2).alias("open_hours"))
    p = promoted.select("type", "subject", "cause").distinct().withColumn("promoted", F.lit(True))
    return out.join(p, ["type", "subject", "cause"], "left").withColumn("promoted", F.coalesce("promoted", F.lit(False))).filter((F.col("n") >= least) | F.col("promoted"))


def fix_efficacy(problems: DataFrame, incidents: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """problem_id, status: aberto, ineficaz, resolvido or em_observacao after a fix."""
    after = problems.join(incidents.select("type", "subject", "cause", "detected_at"), ["type", "subject", "cause"]).filter("detected_at > fixed_at").groupBy("problem_id").agg(F.min("detected_at").alias("again"))
    df = problems.join(after, "problem_id", "left")
    age = F.col("fixed_at") <= now - F.expr(f"INTERVAL '{days}' DAY")
    return df.select("problem_id", F.when(F.col("fixed_at").isNull(), F.lit("aberto")).when(F.col("again").isNotNull(), F.lit("ineficaz")).when(age, F.lit("resolvido")).otherwise(F.lit("em_observacao")).alias("status"))


def last_before(items: DataFrame, targets: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(incident_id, d, t_subject, t_cause, item): the k latest items before each target with equal keys.

    Items and targets are merged into one ordered stream a key, where the running number of items turns "the last k
    before" into a lookup, so a hot key takes linear work, in slices of time.
    """
    item = F.struct("detected_at", F.col("incident_id").alias("other"), "subject", "cause", "state")
    one = items.select(*keys, F.col("detected_at").alias("_at"), F.lit(1).alias("_s"), F.col("incident_id").alias("_id"), item.alias("_i"))
    two = targets.select(*keys, F.col("detected_at").alias("_at"), F.lit(0).alias("_s"), F.col("incident_id").alias("_id"), item.alias("_i"))
    ranked = running_number(one.unionByName(two), keys, ["_at", "_s", F.desc("_id")], F.col("_s") == 1, "_g")
    lists = last_values(ranked.filter("_s = 1"), keys, "_g", "_i", k, "_last")
    met = ranked.filter("_s = 0").join(lists.select(*keys, "_g", "_last"), [*keys, "_g"])
    return met.select(F.col("_id").alias("incident_id"), F.col("_at").alias("d"), F.col("_i.subject").alias("t_subject"), F.col("_i.cause").alias("t_cause"), F.explode("_last").alias("item"))


def similar_incidents(incidents: DataFrame, targets: DataFrame, days: int = 90, top: int = 5) -> DataFrame:
    """incident_id, other, level, nth: earlier incidents of the type within 90 days.

    Level 1 shares asset and cause, 2 the cause, 3 the asset; an unknown cause equals none. Within a level recovered ones
    come first, then the latest. Only the latest ``top`` recovered and other incidents of each key can be among the
    first ``top``, so no pairs beyond those are formed.
    """
    near, won = None, F.coalesce(F.col("state") == "recovered", F.lit(False))
    items = incidents.withColumn("_won", won)
    asked = targets.withColumn("_won", F.explode(F.array(F.lit(True), F.lit(False))))
    for keys in (["type", "subject", "cause"], ["type", "cause"], ["type", "subject"]):
        known = F.col("cause").isNotNull() if "cause" in keys else F.lit(True)
        found = last_before(items.filter(known), asked.filter(known), [*keys, "_won"], top)
        near = found if near is None else near.unionByName(found)
    near = near.select("incident_id", "d", "t_subject", "t_cause", "item.*").filter((F.col("other") != F.col("incident_id")) & (F.col("detected_at") >= F.col("d") - F.expr(f"INTERVAL '{days}' DAY")))
    same_c, same_s = F.coalesce(F.col("t_cause") == F.col("cause"), F.lit(False)), F.col("t_subject") == F.col("subject")
    near = near.withColumn("level", F.when(same_c & same_s, 1).when(same_c, 2).otherwise(3)).dropDuplicates(["incident_id", "other"])
    w = W.partitionBy("incident_id").orderBy("level", F.desc(F.col("state") == "recovered"), F.desc("detected_at"), "other")
    return near.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top).select("incident_id", "other", "level", "nth")


def runbook_efficacy(uses: DataFrame, incidents: DataFrame, now: Column) -> DataFrame:
    """Per runbook: decided uses, successes (recovered within 24 h of the first use), pending, ratio, median hours."""
    first = uses.groupBy("runbook_id", "incident_id").agg(F.min("used_at").alias("used_at"))
    df = first.join(incidents.select("incident_id", "state", "updated_at"), "incident_id")
    hours = (F.col("updated_at").cast("timestamp").cast("long") - F.col("used_at").cast("timestamp").cast("long")) / 3600.0
    good = (F.col("state") == "recovered") & (hours >= 0) & (hours <= 24)
    fresh = ~good & (F.col("used_at") > now - F.expr("INTERVAL '24' HOUR"))
    df = df.withColumns({"good": good, "fresh": fresh, "hours": F.when(good, hours)})
    middle = exact_quantiles(df, ["runbook_id"], "hours", {"median_hours": (0.5, INCLUSIVE)}).drop("n")
    out = df.groupBy("runbook_id").agg(F.count_if(~F.col("fresh")).alias("decided"), F.count_if("good").alias("successes"), F.count_if("fresh").alias("pending"))
    return out.join(middle, "runbook_id", "left").withColumn("ratio", F.when(F.col("decided") > 0, F.col("successes") / F.col("decided"))).withColumn("small_sample", F.col("decided") < 5)


def applicable_runbooks(incidents: DataFrame, runbooks: DataFrame) -> DataFrame:
    """incident_id, runbook_id, level, nth: of the incident's type; restricted ones need a cause or dimension in common."""
    df = incidents.select("incident_id", "type", "cause", "dimensions").join(runbooks, "type")
    restricted = (F.size("causes") > 0) | (F.size("only_dimensions") > 0)
    hit = F.array_contains("causes", F.col("cause")) | F.coalesce(F.arrays_overlap("only_dimensions", "dimensions"), F.lit(False))
    df = df.withColumn("level", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(2)).filter(~restricted | (F.col("level") == 1))
    w = W.partitionBy("incident_id").orderBy("level", F.desc(F.col("status") == "approved"), "runbook_id")
    return df.select("incident_id", "runbook_id", "level", F.row_number().over(w).alias("nth"))


def knowledge_items(problems: DataFrame, fixes: DataFrame) -> DataFrame:
    """Suggestions out of resolved problems and their fix texts."""
    return problems.filter("status = 'resolvido'").join(fixes, "problem_id").select(stable_id("kn-", F.col("problem_id"), F.col("fix_text")).alias("item_id"), "problem_id", F.format_string("For %s: %s", F.col("cause"), F.col("fix_text")).alias("suggestion"))


def recommendations(ranked: DataFrame, playbook: DataFrame, act_at: float = 0.7, incidents: DataFrame | None = None, by_type: DataFrame | None = None) -> DataFrame:
    """incident_id, code, mode, nth, step: verify and act on a likely or confirmed cause, else collect what is missing.

    Causes without a playbook are passed over. An incident without a viable hypothesis (of ``incidents``: incident_id,
    type) falls back to the steps for its type (``by_type``: type, steps), with a null code and mode ``type``.
    """
    viable = ranked.filter("status <> 'rejected'").join(playbook.select("code").distinct(), "code", "left_semi")
    best = viable.groupBy("incident_id").agg(F.min(F.struct((F.col("status") != "confirmed").alias("o"), "rank", "code", "confidence")).alias("b"))
    sure = ~F.col("b.o") | (F.col("b.confidence") >= act_at)
    df = best.select("incident_id", F.col("b.code").alias("code"), F.when(sure, F.lit("act")).otherwise(F.lit("collect")).alias("mode"))
    out = df.join(playbook, ["code", "mode"]).select("incident_id", "code", "mode", F.posexplode("steps").alias("nth", "step"))
    if incidents is None or by_type is None:
        return out
    rest = incidents.select("incident_id", "type").join(best, "incident_id", "left_anti").join(by_type, "type")
    return out.unionByName(rest.select("incident_id", F.lit(None).cast("string").alias("code"), F.lit("type").alias("mode"), F.posexplode("steps").alias("nth", "step")))


def acceptance_rate(decisions: DataFrame) -> DataFrame:
    d = decisions.filter("decision in ('accepted', 'rejected')")
    return d.agg(F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count(F.lit(1)).alias("decided")).withColumn("rate", F.when(F.col("decided") > 0, F.col("accepted") / F.col("decided")))


def violation_dimensions(evidence: DataFrame) -> DataFrame:
    return evidence.select("incident_id", F.get_json_object("value_json", "$.dimension").alias("d")).filter("d is not null").groupBy("incident_id").agg(F.array_sort(F.collect_set("d")).alias("dimensions"))


def advisor_candidates(incidents: DataFrame, connectors: DataFrame, runbooks: DataFrame) -> DataFrame:
    """(kind, subject, detail): questions worth an advisor's opinion.

    Active incidents of the grey zone (warning, high), connectors that are degraded, and incidents for which two or
    more runbooks apply equally well (``runbooks``: incident_id, runbook_id, level).
    """
    grey = incidents.filter("severity in ('warning', 'high') and state in ('detected', 'triaged')").select(F.lit("severity").alias("kind"), F.col("incident_id").alias("subject"), F.col("severity").alias("detail"))
    poor = connectors.filter("status = 'degraded'").select(F.lit("connector").alias("kind"), F.col("connector").alias("subject"), F.col("status").alias("detail"))
    per = runbooks.groupBy("incident_id", "level").agg(F.array_sort(F.collect_set("runbook_id")).alias("r")).groupBy("incident_id").agg(F.min(F.struct("level", "r")).alias("best"))
    tied = per.filter(F.size("best.r") >= 2).select(F.lit("runbook").alias("kind"), F.col("incident_id").alias("subject"), F.array_join("best.r", ",").alias("detail"))
    return grey.unionByName(poor).unionByName(tied)


def advisor_recommendations(candidates: DataFrame, answers: DataFrame, least: float = 0.7) -> DataFrame:
    """Answers of enough confidence to questions that were asked: (kind, subject, confidence, answer)."""
    return candidates.select("kind", "subject").join(answers.filter(F.col("confidence") >= least), ["kind", "subject"])


# --- semantic metrics


def metric_divergences(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(kind, asset, metric_id): the six ways in which declarations and code disagree.

    ``declared`` has asset, metric_id, formula_hash, grain, status; ``observed`` asset, metric_id, formula_hash, grain,
    extraction_status. Named, extracted observations and canonical declarations compare.
    """
    d = declared.filter("status = 'canonical'")
    o = observed.filter("extraction_status in ('extraida', 'parcial') and metric_id is not null")
    per = o.groupBy("asset", "metric_id").agg(F.countDistinct("formula_hash").alias("f"), F.countDistinct("grain").alias("g"))
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "asset", "metric_id")
    same = o.groupBy("asset", "formula_hash").agg(F.countDistinct("metric_id").alias("m"), F.min("metric_id").alias("metric_id")).filter("m > 1")
    keys = ["asset", "metric_id"]
    both = d.join(o.select(*keys, F.col("formula_hash").alias("h")).distinct(), keys)
    wrong = both.groupBy(*keys).agg(F.max((F.col("h") == F.col("formula_hash")).cast("int")).alias("ok")).filter("ok = 0")
    parts = [tag(per.filter("f > 1"), "formula_conflict"), tag(per.filter("f = 1 and g > 1"), "grain_conflict"), tag(same, "synonym"), tag(d.join(per, keys, "left_anti").distinct(), "declared_not_computed"), tag(per.join(d, keys, "left_anti"), "computed_not_declared"), tag(wrong, "declared_mismatch")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def semantic_conflicts(divergences: DataFrame, blocking=("formula_conflict", "grain_conflict", "declared_mismatch")) -> DataFrame:
    """Blocking divergences grouped per asset, with an event id that hashes their set."""
    bad = divergences.filter(F.col("kind").isin(*blocking)).groupBy("asset").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "metric_id"))).alias("conflicts"))
    return bad.withColumn("event_id", stable_id("sem-", F.col("asset"), F.array_join("conflicts", ",")))


def evaluated_assets(registry: DataFrame, read: DataFrame) -> DataFrame:
    """Assets all of whose registry files were read."""
    missing = registry.join(read.select("file").distinct(), "file", "left_anti").select("asset").distinct()
    return registry.select("asset").distinct().join(missing, "asset", "left_anti")


def observed_metrics(files: DataFrame) -> DataFrame:
    """Named aggregations in a corpus of source files (path, value): path, metric_id, formula, grain (keys in order), line,
    extraction_status, detail and formula_hash (null where nothing can be compared). See ``functions.formulas``.

    Equal texts are read once, in tasks that are dealt by text and not by the size of the input's files.
    """
    spark = files.sparkSession
    files = files.select("path", F.coalesce("value", F.lit("")).alias("value")).withColumn("_text", F.sha2(F.col("value").cast("binary"), 256))
    texts = files.select("_text", "value").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_text")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(t, m.metric_id, m.formula, m.grain, m.line, m.status, m.detail, formula_hash(m.canonical)) for t, v in zip(b["_text"], b["value"], strict=True) for m in metrics_of(v)]
            yield pd.DataFrame(rows, columns=["_text", "metric_id", "formula", "grain", "line", "extraction_status", "detail", "formula_hash"])

    metrics = texts.mapInPandas(run, "_text string, metric_id string, formula string, grain string, line int, extraction_status string, detail string, formula_hash string")
    return files.select("path", "_text").join(metrics, "_text").drop("_text")


# --- SLA


def _seconds(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp").cast("long")


def window_deadline(last_write: Column, freshness: Column) -> Column:
    """The instant at which data last written then is older than a freshness such as ``90s``, ``30m``, ``24h`` or ``7d``."""
    unit = F.regexp_extract(freshness, r"^\s*[0-9]+\s*([smhd])\s*$", 1)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    seconds = F.regexp_extract(freshness, r"^\s*([0-9]+)", 1).try_cast("long") * size
    return (last_write.cast("timestamp") + F.make_interval(secs=seconds)).cast("timestamp")


def daily_deadline(assets: DataFrame, writes: DataFrame, now: Column) -> DataFrame:
    """asset, deadline, delivered, breached: the next local deadline, and whether today's was missed.

    ``assets`` has asset, clock (HH:mm), zone. A write counts as today's delivery from local midnight up to the deadline;
    after a delivery the next deadline is tomorrow's. The calendar is reckoned in local time, so changes of clock are
    right. Only writes of the last 26 hours can matter, so the log is cut before it is joined.
    """
    at = now.cast("timestamp")
    local = F.from_utc_timestamp(at, F.col("zone"))
    df = assets.withColumn("midnight", F.to_utc_timestamp(F.date_trunc("day", local), F.col("zone")))
    df = df.withColumn("deadline", F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd "), "clock"), "yyyy-MM-dd HH:mm"), F.col("zone")))
    t = F.col("timestamp").cast("timestamp")
    w = writes.filter((t <= at) & (t >= at - F.expr("INTERVAL '26' HOUR"))).select(F.col("asset").alias("_a"), F.col("timestamp").alias("_t")).distinct()
    hit = df.join(w, F.col("asset") == F.col("_a")).filter((_seconds("_t") >= _seconds("midnight")) & (_seconds("_t") <= _seconds("deadline"))).select("asset").distinct().withColumn("delivered", F.lit(True))
    df = df.join(hit, "asset", "left").withColumn("delivered", F.coalesce("delivered", F.lit(False)))
    upcoming = F.when(F.col("delivered"), F.col("deadline") + F.expr("INTERVAL '24' HOUR")).otherwise(F.col("deadline"))
    return df.select("asset", upcoming.alias("deadline"), "delivered", (~F.col("delivered") & (at > F.col("deadline"))).alias("breached"))


def expected_duration(runs: DataFrame, last: int = 20, least: int = 5, regimes: DataFrame | None = None) -> DataFrame:
    """job_id, expected_s: median set-up plus median execution of the last 20 measured successes; under five, none.

    With ``regimes`` (job_id, regime_start) only runs from that start on count.
    """
    if regimes is not None:
        runs = runs.join(regimes.select("job_id", "regime_start"), "job_id", "left").filter("regime_start is null or start_time >= regime_start").drop("regime_start")
    w = W.partitionBy("job_id").orderBy(F.desc("end_time"), F.desc("run_id"))
    kept = runs.filter("result_state = 'SUCCESS' and setup_s is not null and execution_s is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    return kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), (F.median("setup_s") + F.median("execution_s")).alias("expected_s")).filter(F.col("n") >= least)


def classify_slack(deadline: Column, now: Column, expected_s: Column, elapsed_s: Column, margin: int = 600) -> Column:
    """no_prazo, em_risco, inevitavel, violado or sem_base."""
    left = deadline.cast("timestamp").cast("long") - now.cast("timestamp").cast("long")
    slack = left - F.greatest(expected_s - elapsed_s, F.lit(0.0)) - margin
    return F.when(left < 0, F.lit("violado")).when(expected_s.isNull(), F.lit("sem_base")).when(slack > 300, F.lit("no_prazo")).when(slack > 0, F.lit("em_risco")).otherwise(F.lit("inevitavel"))


#: Classes of SLA risk, worst first.
SLA_CLASSES = ("violado", "inevitavel", "em_risco", "no_prazo", "sem_base")


def slack_s(deadline: Column, now: Column, expected_s: Column, elapsed_s: Column, margin: int = 600) -> Column:
    """Seconds to spare after what is left of the expected duration and a margin; null without a base."""
    return deadline.cast("timestamp").cast("long") - now.cast("timestamp").cast("long") - F.greatest(expected_s - elapsed_s, F.lit(0.0)) - margin + F.when(expected_s.isNotNull(), 0.0)


def most_urgent(predictions: DataFrame) -> DataFrame:
    """One prediction an asset: the worst class, then the least slack (none counts as 0), then the nearest deadline."""
    rank = F.array_position(F.array(*[F.lit(c) for c in SLA_CLASSES]), F.col("class"))
    w = W.partitionBy("asset").orderBy(rank, F.coalesce("slack_s", F.lit(0.0)), "deadline", "prediction_id")
    return predictions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def settle(predictions: DataFrame, writes: DataFrame, now: Column) -> DataFrame:
    """prediction_id, outcome of predictions whose deadline is past: a write in (predicted, deadline] is in time.

    Both sides meet by asset and day, so a prediction sees the writes of its own days only.
    """
    past = predictions.filter(F.col("deadline") < now)
    days = F.explode(F.sequence(F.to_date("predicted_at"), F.greatest(F.to_date("deadline"), F.to_date("predicted_at"))))
    w = writes.select(F.col("asset").alias("_a"), F.to_date("timestamp").alias("_d"), F.col("timestamp").alias("_t"))
    open_days = past.select("prediction_id", "asset", "predicted_at", "deadline", days.alias("_day"))
    hit = open_days.join(w, (F.col("asset") == F.col("_a")) & (F.col("_day") == F.col("_d")) & (F.col("_t") > F.col("predicted_at")) & (F.col("_t") <= F.col("deadline")), "left_semi").select("prediction_id").distinct().withColumn("_hit", F.lit(True))
    return past.join(hit, "prediction_id", "left").select("prediction_id", F.when(F.col("_hit"), F.lit("entregue_a_tempo")).otherwise(F.lit("estourou")).alias("outcome"))


def supersede(incidents: DataFrame, violated: DataFrame) -> DataFrame:
    """Risk incidents of an asset that is violated are closed; run before resolution."""
    v = violated.select("subject").distinct().withColumn("_v", F.lit(True))
    df = incidents.join(v, "subject", "left")
    done = (F.col("type") == "sla_risk") & F.coalesce("_v", F.lit(False)) & F.col("state").isin("detected", "triaged")
    return df.withColumn("state", F.when(done, F.lit("closed")).otherwise(F.col("state"))).drop("_v")


def sla_incidents(predictions: DataFrame) -> DataFrame:
    """asset, severity: inevitavel is high, em_risco a warning; one an asset, the worse one."""
    risky = most_urgent(predictions).filter(F.col("class").isin("inevitavel", "em_risco"))
    return risky.select("asset", F.when(F.col("class") == "inevitavel", F.lit("high")).otherwise(F.lit("warning")).alias("severity"))
