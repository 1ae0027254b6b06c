"""Change risk, supply chain, secrets in changes, gates, notifications, audit chain, executive figures and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.columns import severity_rank, stable_id, version_key
from opsloom.functions.quantiles import EXCLUSIVE, INCLUSIVE, exact_quantiles

# --- change risk

def assets_for_change(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """sha, asset of every changed (sha, file) that stands for a source (path, asset).

    A file stands for a path if it ends with it or has the same last part. A path with a folder can only be the end of a
    file with the same last part, so such paths meet by that part; a path without one meets the ends of last parts. Both
    sides are made keys and met by an equi-join; nothing is compared with everything.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    name = last(F.col("file"))
    files = changes.filter("file is not null").select("sha", name.alias("name")).distinct()
    ends = F.transform(F.sequence(F.lit(1), F.length("name") + 1), lambda i: F.struct(F.lit(True).alias("end"), F.substring(F.col("name"), i, F.length("name")).alias("k")))
    names = files.select("name").distinct().select("name", F.explode(F.array_append(ends, F.struct(F.lit(False).alias("end"), F.col("name").alias("k")))).alias("e")).select("name", "e.*")
    whole = ~F.col("path").contains("/")
    keys = sources.filter("path is not null").select(whole.alias("end"), F.when(whole, F.col("path")).otherwise(last(F.col("path"))).alias("k"), "asset").distinct()
    met = names.join(keys, ["end", "k"]).select("name", "asset").distinct()
    return files.join(met, "name").select("sha", "asset").distinct()


def blast_score(change_assets: DataFrame, reached: DataFrame) -> DataFrame:
    """sha, blast: 1 if a dashboard is in reach, else the largest impact over three, at most 1."""
    per = reached.groupBy(F.col("origin").alias("asset")).agg(F.max((F.col("entity_type") == "dashboard").cast("int")).alias("dash"), F.sum("score").alias("s"))
    df = change_assets.join(per, "asset", "left").groupBy("sha").agg(F.max("dash").alias("dash"), F.max("s").alias("s"))
    return df.select("sha", F.when(F.col("dash") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("s") / 3, F.lit(0.0)))).alias("blast"))


def incidents_after_changes(touched: DataFrame, incidents: DataFrame, days: int = 14) -> DataFrame:
    """(asset, incident_id) of incidents detected at most ``days`` after some change (asset, committed_at) of their asset.

    Time is cut into spans of that length. A change that an incident follows lies in the incident's span, where the first
    one of the asset decides, or in the one before, where the last one does: an asset has two instants a span, however
    many changes.
    """
    length = days * 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = lambda t: F.floor(t / F.lit(length)).cast("long")
    at = touched.filter("committed_at is not null").select("asset", micros("committed_at").alias("t"))
    per = at.groupBy("asset", span(F.col("t")).alias("span")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    none = F.lit(None).cast("long")
    sides = F.array(F.struct(F.col("span").alias("span"), F.col("first").alias("first"), none.alias("last")), F.struct((F.col("span") + 1).alias("span"), none.alias("first"), F.col("last").alias("last")))
    known = per.select("asset", F.explode(sides).alias("s")).groupBy("asset", F.col("s.span").alias("span")).agg(F.min("s.first").alias("first"), F.max("s.last").alias("last"))
    late = incidents.filter("detected_at is not null").select("asset", "incident_id", micros("detected_at").alias("d")).withColumn("span", span(F.col("d")))
    follows = (F.col("first") <= F.col("d")) | (F.col("last") >= F.col("d") - F.lit(length))
    return late.join(known, ["asset", "span"]).filter(follows).select("asset", "incident_id").distinct()


def history_score(change_assets: DataFrame, changes: DataFrame, incidents: DataFrame, days: int = 14, enough: int = 3) -> DataFrame:
    """sha, history: incidents on the change's assets at most 14 days after any change to the asset, over three, at most 1.

    More than ``enough`` incidents change nothing, so an asset sends the smallest ids of so many on to its changes.
    """
    touched = change_assets.join(changes.select("sha", "committed_at"), "sha").select("asset", "committed_at")
    after = incidents_after_changes(touched, incidents, days)
    some = after.withColumn("_n", F.row_number().over(W.partitionBy("asset").orderBy("incident_id"))).filter(F.col("_n") <= enough).drop("_n")
    df = change_assets.join(some, "asset").groupBy("sha").agg(F.countDistinct("incident_id").alias("n"))
    return changes.select("sha").distinct().join(df, "sha", "left").select("sha", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / enough).alias("history"))


def size_score(n_files: Column, patch: Column) -> Column:
    lines = F.size(F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^[+-]")))
    return F.least(F.lit(1.0), 0.5 * n_files / 10 + 0.5 * lines / 400)


def provenance_score(author: Column, message: Column) -> Column:
    bot = author.contains("[bot]") | F.lower(message).rlike(r"co-authored-by:[^\n]*bot")
    return F.when(F.coalesce(bot, F.lit(False)), 1.0).otherwise(0.0)


def change_risk(scores: DataFrame) -> DataFrame:
    """Adds score and band of (blast, history, size, provenance, high_finding); a high finding forces alto."""
    df = scores.withColumn("score", F.round(0.4 * F.col("blast") + 0.3 * F.col("history") + 0.2 * F.col("size") + 0.1 * F.col("provenance"), 4))
    return df.withColumn("band", F.when(F.col("high_finding") | (F.col("score") >= 0.66), F.lit("alto")).when(F.col("score") >= 0.34, F.lit("medio")).otherwise(F.lit("baixo")))


def dependencies(manifests: DataFrame) -> DataFrame:
    """file, package, version (lower bound) of requirement lines; plain files and quoted project lists alike."""
    line = F.explode(F.split("text", "\n"))
    rx = r"""^\s*["']?([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:==|>=|~=)\s*([0-9][0-9A-Za-z.]*)"""
    df = manifests.select("file", line.alias("line"))
    return df.select("file", F.lower(F.regexp_replace(F.regexp_extract("line", rx, 1), "_", "-")).alias("package"), F.regexp_extract("line", rx, 2).alias("version")).filter("package <> ''")


def dependency_findings(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies below the version that an advisory names as fixed."""
    a = advisories.select(F.lower("package").alias("package"), "fixed_in", "severity", "cve")
    return deps.join(a, "package").filter(version_key(F.col("version")) < version_key(F.col("fixed_in")))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (n - F.size(F.array_remove(chars, c))) / n * F.log2((n - F.size(F.array_remove(chars, c))) / n))


#: Name, regular expression and severity of the secret patterns.
SECRET_PATTERNS = (
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", "alta"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "alta"),
    ("databricks_token", r"dapi[0-9a-f]{32}", "alta"),
    ("generic_secret", r"(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*['\"][^'\"]{8,}['\"]", "média"),
)


def secret_findings(texts: DataFrame, key: str = "sha", patterns=SECRET_PATTERNS, least_chars: int = 20, least_bits: float = 4.0, shown: int = 4) -> DataFrame:
    """key, pattern, severity, masked: matches of a table of patterns (name, expression, severity), and long tokens of high
    entropy; only the first ``shown`` characters are shown. All patterns look at a text in one pass."""
    masked = lambda t: F.concat(F.substring(t, 1, shown), F.lit("***"))
    tokens = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"[A-Za-z0-9+/=_-]{{{least_chars},}}"), F.lit(0))), lambda t: entropy(t) >= least_bits)
    found = [(name, severity, F.regexp_extract_all("text", F.lit(rx), F.lit(0))) for name, rx, severity in patterns] + [("entropy", "média", tokens)]

    def marked(name, severity, hits):
        return F.transform(hits, lambda t: F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), masked(t).alias("masked")))

    each = [marked(*f) for f in found]
    return texts.filter("text is not null").select(key, F.explode(F.flatten(F.array(*each))).alias("f")).select(key, "f.*")


def gate_decisions(risks: DataFrame, secrets: DataFrame, deps: DataFrame) -> DataFrame:
    """sha, decision, reason: a high secret, then a high dependency, then a high band block; else it may pass."""
    high = lambda df, n: df.filter("severity = 'alta'").select("sha").distinct().withColumn(n, F.lit(True))
    df = risks.join(high(secrets, "_s"), "sha", "left").join(high(deps, "_d"), "sha", "left")
    reason = F.when(F.col("_s"), F.lit("secret")).when(F.col("_d"), F.lit("dependency")).when(F.col("band") == "alto", F.lit("risk"))
    return df.select("sha", F.when(reason.isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("decision"), reason.alias("reason"))


def effective_gate(decisions: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    ok = overrides.filter((F.col("status") == "approved") & (F.col("expires_at") > now)).select("sha").distinct().withColumn("_o", F.lit(True))
    return decisions.join(ok, "sha", "left").select("sha", F.when(F.col("_o"), F.lit("allow")).otherwise(F.col("decision")).alias("decision"))


# --- notifications and audit


def material_events(incidents: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """incident_id, event, dedup_key: opened, escalated or recovered within the look-back."""
    since = now - F.expr(f"INTERVAL '{hours}' HOUR")
    fresh = F.col("updated_at") > since
    events = F.array(F.when(F.col("detected_at") > since, F.lit("aberto")), F.when(fresh & F.col("escalated_from").isNotNull(), F.lit("escalou")), F.when(fresh & (F.col("state") == "recovered"), F.lit("recuperado")))
    df = incidents.select("incident_id", "severity", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("event"))
    return df.withColumn("dedup_key", stable_id("nt-", F.col("incident_id"), F.col("event")))


def send_after(at: Column, severity: Column, zone: str, start: int = 22, end: int = 7) -> Column:
    """The moment itself, or the end of quiet hours (22 to 7 local, over midnight); critical and blocking do not wait."""
    local = F.from_utc_timestamp(at.cast("timestamp"), zone)
    h = F.hour(local)
    day = F.date_trunc("day", local)
    wake = F.when(h >= start, F.timestamp_seconds(day.cast("long") + 86400 + end * 3600)).when(h < end, F.timestamp_seconds(day.cast("long") + end * 3600))
    return F.when(severity.isin("critical", "blocking") | wake.isNull(), at.cast("timestamp")).otherwise(F.to_utc_timestamp(wake, zone))


def notification_outbox(events: DataFrame, evidence: DataFrame, least: str = "high", most: int = 2) -> DataFrame:
    """incident_id, event, evidence: events at or above a severity with their two newest pieces of evidence."""
    newest = W.partitionBy("incident_id").orderBy(F.desc("at"), F.desc("evidence_id"))
    few = evidence.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most)
    new = few.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("_n", "evidence_id"))).alias("e"))
    df = events.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(least))).join(new, "incident_id", "left")
    return df.select("incident_id", "event", F.array_join(F.transform("e", lambda x: x["evidence_id"]), ",").alias("evidence"))


def ticket_outbox(incidents: DataFrame) -> DataFrame:
    """One ticket an incident with a JSON body."""
    return incidents.select(stable_id("tk-", F.col("incident_id")).alias("outbox_id"), "incident_id", F.to_json(F.struct("incident_id", "type", "severity", "subject")).alias("body"))


def verify_audit_chain(rows: DataFrame) -> DataFrame:
    """One row: rows, broken hashes, missing parents, forks, first bad seq. A parent must exist earlier in the chain."""
    body = F.to_json(F.struct("seq", "actor", "action", "target"))
    df = rows.withColumn("bad_hash", F.col("hash") != F.sha2(F.concat(body, F.coalesce("prev_hash", F.lit(""))).cast("binary"), 256))
    parents = rows.groupBy("hash").agg(F.min("seq").alias("_p")).withColumnRenamed("hash", "_h")
    df = df.join(parents, F.col("prev_hash") == F.col("_h"), "left").withColumn("orphan", (F.col("prev_hash") != "") & (F.col("_p").isNull() | (F.col("_p") >= F.col("seq"))))
    kids = rows.groupBy(F.col("prev_hash").alias("_k")).agg(F.count(F.lit(1)).alias("kids"), F.min("seq").alias("first_kid"))
    df = df.join(kids, F.col("prev_hash") == F.col("_k"), "left").withColumn("fork", (F.col("kids") > 1) & (F.col("seq") > F.col("first_kid")))
    bad = F.col("bad_hash") | F.col("orphan") | F.col("fork")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad_hash").alias("bad_hashes"), F.count_if("orphan").alias("orphans"), F.count_if("fork").alias("forks"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"))


# --- executive figures


#: Of each incident figure its unit, its window, its source and how it is reckoned.
INCIDENT_NOTES = {
    "active": ("incidents", "now", "incidents", "incidents detected or triaged"),
    "critical": ("incidents", "now", "incidents", "active ones of severity critical or blocking"),
    "mttr_median_h": ("hours", "7 d", "incidents (recovered)", "median of recovery less detection"),
    "mttr_p90_h": ("hours", "7 d", "incidents (recovered)", "90 % quantile of recovery less detection, exclusive method"),
    "administrative_closures": ("incidents", "7 d", "incidents (closed)", "incidents closed by decision; no part of the time to recovery"),
    "mtta_median_h": ("hours", "7 d", "incidents (acknowledged)", "median of acknowledgement less detection"),
    "ack_pending": ("incidents", "now", "incidents", "active ones without acknowledgement"),
    "sla_risk_incidents": ("incidents", "now", "incidents (sla_risk)", "active ones of type sla_risk"),
    "impacted_assets": ("assets", "now", "incidents, lineage", "different assets in reach of active incidents"),
}


def executive_summary(incidents: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(metric, value, n, confidence, unit, window, source, formula) of the incident figures. Nothing measured is null, not 0.

    Counts are always trusted; medians and quantiles by the number of incidents behind them.
    """
    seconds = lambda c: F.col(c).cast("timestamp").cast("long")
    since = now - F.expr(f"INTERVAL '{days}' DAY")
    active, closed = F.col("state").isin("detected", "triaged"), (F.col("state") == "closed") & (F.col("updated_at") >= since)
    recovered = (F.col("state") == "recovered") & (F.col("updated_at") >= since)
    noticed = F.col("acknowledged_at").isNotNull() & (F.col("detected_at") >= since)
    counts = {
        "active": (active, F.lit(True)), "critical": (active & F.col("severity").isin("critical", "blocking"), active), "administrative_closures": (closed, closed),
        "ack_pending": (active & F.col("acknowledged_at").isNull(), active), "sla_risk_incidents": (active & (F.col("type") == "sla_risk"), active),
    }
    one = incidents.agg(*[F.count_if(c).alias(k) for k, (c, _) in counts.items()], *[F.count_if(c).alias(f"n_{k}") for k, (_, c) in counts.items()], F.count_if(recovered).alias("_r"), F.count_if(noticed).alias("_a"), F.count_if(active & F.col("asset").isNotNull()).alias("_m"))
    assets = incidents.filter(active & F.col("asset").isNotNull()).groupBy("asset").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("assets"))
    item = lambda k, v, n, sure: F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), n.alias("n"), F.lit(sure).alias("sure"))
    rows = one.select(F.explode(F.array(*[item(k, F.col(k), F.col(f"n_{k}"), True) for k in counts])).alias("r")).select("r.*")
    rows = rows.unionByName(one.withColumn("_k", F.lit(1)).join(assets.withColumn("_k", F.lit(1)), "_k").select(F.inline(F.array(item("impacted_assets", F.when(F.col("_m") > 0, F.col("assets")), F.col("_m"), False)))))
    taken = incidents.select(F.when(recovered, F.lit("r")).when(noticed, F.lit("a")).alias("kind"), F.when(recovered, seconds("updated_at") - seconds("detected_at")).alias("r"), F.when(noticed, seconds("acknowledged_at") - seconds("detected_at")).alias("a"))
    times = taken.select(F.inline(F.array(F.struct(F.lit("r").alias("kind"), (F.col("r") / 3600.0).alias("h")), F.struct(F.lit("a").alias("kind"), (F.col("a") / 3600.0).alias("h"))))).filter("h is not null")
    found = exact_quantiles(times, ["kind"], "h", {"median": (0.5, INCLUSIVE), "p90": (0.9, EXCLUSIVE)}).select(F.col("kind").alias("_kind"), "median", "p90")
    wide = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(t).alias("kind"), F.lit(c).alias("column"), F.col(f"_{t}").alias("n")) for k, t, c in (("mttr_median_h", "r", "median"), ("mttr_p90_h", "r", "p90"), ("mtta_median_h", "a", "median"))])))
    measured = wide.join(found, F.col("kind") == F.col("_kind"), "left").select("metric", F.when(F.col("column") == "median", F.col("median")).otherwise(F.col("p90")).alias("value"), "n", F.lit(False).alias("sure"))
    out = rows.unionByName(measured)
    confidence = F.when(F.col("sure"), F.lit("alta")).when(F.col("n") == 0, F.lit("sem_dados")).when(F.col("n") < 5, F.lit("baixa")).otherwise(F.lit("alta"))
    note = F.create_map(*[x for k, v in INCIDENT_NOTES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(c) for y, c in zip(v, ("unit", "window", "source", "formula"), strict=True)]))])
    return out.withColumn("confidence", confidence).withColumn("_m", F.element_at(note, F.col("metric"))).select("metric", "value", "n", "confidence", "_m.unit", "_m.window", "_m.source", "_m.formula")


def health_score(measures: DataFrame, weights: dict[str, float], cap: float = 60.0) -> DataFrame:
    """Weighted 0-100 score of columns in [0, 1]; an unmitigated critical incident caps it."""
    raw = reduce(lambda a, b: a + b, [w * F.col(c) for c, w in weights.items()])
    return measures.withColumn("score", F.round(F.when(F.col("critical") > 0, F.least(raw, F.lit(cap))).otherwise(raw), 4))


def burn_rate(events: DataFrame, width: str, slo: float) -> DataFrame:
    """Per window and service: error share over the allowed share."""
    g = events.groupBy("service", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    return g.select("service", F.col("w.start").alias("start"), "n", "bad", (F.col("bad") / F.col("n") / (1 - slo)).alias("burn"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Per model: tokens a request and a success, retry waste, cost of failures, output share; an invocation counts once."""
    one = calls.dropDuplicates(["invocation_id"])
    t = F.col("input_tokens") + F.col("output_tokens")
    return one.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.avg(t).alias("tokens_per_request"), (F.sum(t) / F.count_if(F.col("ok"))).alias("tokens_per_success"), F.sum(F.when(F.col("retry") > 0, t).otherwise(0)).alias("retry_tokens"), F.sum(F.when(~F.col("ok"), F.col("cost")).otherwise(0.0)).alias("failed_cost"), (F.sum("input_tokens") / F.sum("output_tokens")).alias("input_output_ratio"))


def action_metrics(actions: DataFrame) -> DataFrame:
    """Per cohort: actions, approval rate, p95 age and median lag of decision, shares reopened within 24 h and 7 days.

    The age of an undecided action grows; the lag is that of decided ones (``decided_after_s``).
    """
    again = lambda s: F.count_if(F.col("reopened_after_s") <= s) / F.count(F.lit(1))
    counts = actions.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("approved")) / F.count("approved")).alias("approval_rate"), again(86_400).alias("reopened_24h"), again(7 * 86_400).alias("reopened_7d"))
    ages = exact_quantiles(actions, ["cohort"], "age_s", {"age_p95_s": (0.95, INCLUSIVE)}).drop("n")
    lags = exact_quantiles(actions, ["cohort"], "decided_after_s", {"lag_median_s": (0.5, INCLUSIVE)}).drop("n")
    return counts.join(ages, "cohort", "left").join(lags, "cohort", "left")


# --- views


def last_incidents(incidents: DataFrame, n: int = 50) -> DataFrame:
    """The n newest incidents: a top-k, not a sort of everything."""
    return incidents.orderBy(F.desc("detected_at"), "incident_id").limit(n)


def latest_by(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row a key."""
    rest = [c for c in df.columns if c not in (key, at, tie)]
    return df.groupBy(key).agg(F.max(F.struct(at, tie, *rest)).alias("r")).select(key, "r.*")


def top_per(df: DataFrame, key: str, at: str, tie: str, n: int) -> DataFrame:
    """The n newest rows a key."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), tie))).filter(F.col("nth") <= n)


def risk_contributors(scores: DataFrame) -> DataFrame:
    """Adds contributors: the parts of a change's risk that are above 0, largest share of the score first."""
    parts = (("blast", 0.4), ("history", 0.3), ("size", 0.2), ("provenance", 0.1))
    items = F.array(*[F.struct((-F.round(w * F.col(c), 4)).alias("o"), F.lit(c).alias("name"), F.round(w * F.col(c), 4).alias("points")) for c, w in parts])
    named = F.transform(F.array_sort(F.filter(items, lambda x: x["o"] < 0)), lambda x: F.struct(x["name"].alias("name"), x["points"].alias("points")))
    finding = F.when(F.col("high_finding"), F.array(F.struct(F.lit("high_finding").alias("name"), F.lit(1.0).alias("points"))))
    return scores.withColumn("contributors", F.concat(F.coalesce(finding, F.array().cast("array<struct<name:string,points:double>>")), named))


def burn_rates_sliding(events: DataFrame, widths: dict[str, str], slo: float) -> DataFrame:
    """(service, width, start, n, bad, burn) over several window widths at once, each with its slide ("1 hour": "5 minutes")."""
    out = None
    for width, slide in widths.items():
        g = events.groupBy("service", F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
        g = g.select("service", F.lit(width).alias("width"), F.col("w.start").alias("start"), "n", "bad", (F.col("bad") / F.col("n") / (1 - slo)).alias("burn"))
        out = g if out is None else out.unionByName(g)
    return out


#: Of each executive figure its window, its source and how it is reckoned.
EXECUTIVE_NOTES = {
    "sla_at_risk": ("now", "sla_predictions", "assets whose latest class is em_risco, inevitavel or violado"),
    "incremental_cost": ("7 d", "run_costs", "sum of available incremental costs"),
    "incremental_cost_pending": ("7 d", "run_costs", "runs whose cost is pending"),
    "connectors_healthy": ("now", "connectors", "share of connectors that are healthy"),
    "recommendations_accepted": ("all", "decisions", "accepted over decided"),
    "savings_identified": ("all", "opportunities", "sum of counted savings"),
    "savings_approved": ("all", "initiatives", "sum of approved and implemented savings"),
    "savings_realized": ("all", "realizations", "sum of realized net savings"),
    "savings_rate": ("all", "realizations", "realized initiatives over those measured to an end"),
}


def executive_operations(predictions: DataFrame, costs: DataFrame, connectors: DataFrame, decisions: DataFrame, opportunities: DataFrame, initiatives: DataFrame, realizations: DataFrame) -> DataFrame:
    """(metric, value, n, confidence, window, source, formula) of the figures beside the incidents, one aggregation a table.

    Tables: predictions (asset, class), costs (incremental_cost, status), connectors (status), decisions (decision),
    opportunities (saving, counted), initiatives (saving, status), realizations (net, status). Nothing measured is null.
    """
    risky = F.col("class").isin("em_risco", "inevitavel", "violado")
    live = initiatives.filter("status in ('approved', 'implemented')")

    def rows(one: DataFrame, *items) -> DataFrame:
        return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), n.alias("n")) for m, v, n in items])).alias("r")).select("r.*")

    some = lambda v, n: F.when(n > 0, v)
    n = F.col("n")
    parts = [
        rows(predictions.agg(F.countDistinct(F.when(risky, F.col("asset"))).alias("v"), F.countDistinct("asset").alias("n")), ("sla_at_risk", some(F.col("v"), n), n)),
        rows(costs.agg(F.sum(F.when(F.col("status") == "available", F.col("incremental_cost"))).alias("v"), F.count_if(F.col("status") == "available").alias("k"), F.count_if(F.col("status") == "pending").alias("p"), F.count(F.lit(1)).alias("n")), ("incremental_cost", F.col("v"), F.col("k")), ("incremental_cost_pending", some(F.col("p"), n), n)),
        rows(connectors.agg(F.count_if(F.col("status") == "healthy").alias("v"), F.count(F.lit(1)).alias("n")), ("connectors_healthy", some(F.col("v") / n, n), n)),
        rows(decisions.agg(F.count_if(F.col("decision") == "accepted").alias("v"), F.count_if(F.col("decision").isin("accepted", "rejected")).alias("n")), ("recommendations_accepted", some(F.col("v") / n, n), n)),
        rows(opportunities.filter("counted").agg(F.sum("saving").alias("v"), F.count("saving").alias("n")), ("savings_identified", F.col("v"), n)),
        rows(live.agg(F.sum("saving").alias("v"), F.count("saving").alias("n")), ("savings_approved", F.col("v"), n)),
    ]
    real, ended = F.col("status") == "realizada", F.col("status").isin("realizada", "nao_realizada", "expirada", "realizada_com_efeito_colateral")
    done = realizations.agg(F.sum(F.when(real, F.col("net"))).alias("v"), F.count_if(real).alias("n"), F.count_if(ended).alias("k"))
    parts.append(rows(done, ("savings_realized", F.col("v"), n), ("savings_rate", F.when(F.col("k") > 0, n / F.col("k")), F.col("k"))))
    out = reduce(DataFrame.unionByName, parts)
    note = F.create_map(*[x for k, v in EXECUTIVE_NOTES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(c) for y, c in zip(v, ("window", "source", "formula"), strict=True)]))])
    out = out.withColumn("confidence", F.when(n == 0, F.lit("sem_dados")).when(n < 5, F.lit("baixa")).otherwise(F.lit("alta")))
    return out.withColumn("_m", F.element_at(note, F.col("metric"))).select("metric", "value", "n", "confidence", "_m.window", "_m.source", "_m.formula")


# --- views of one incident or subject


def incident_timeline(timeline: DataFrame, incident_id: str) -> DataFrame:
    return timeline.filter(F.col("incident_id") == incident_id).orderBy("at", "kind", "entry_id")


def hypotheses_by_rank(hypotheses: DataFrame, incident_id: str) -> DataFrame:
    return hypotheses.filter(F.col("incident_id") == incident_id).orderBy("rank", "hypothesis_id")


def last_narratives(narratives: DataFrame) -> DataFrame:
    """The newest narrative an incident."""
    return latest_by(narratives, "incident_id", "narrated_at", "narrative_id")


def recommendations_with_decision(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Recommendations with their latest decision (pending where there is none)."""
    last = latest_by(decisions, "recommendation_id", "decided_at", "decision_id").select("recommendation_id", "decision")
    return recommendations.join(last, "recommendation_id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def opportunities_with_measure(opportunities: DataFrame, initiatives: DataFrame, realizations: DataFrame) -> DataFrame:
    """Opportunities with the state of their initiative and what it realized."""
    df = opportunities.join(initiatives.select("source", "subject", "initiative_id", F.col("status").alias("initiative")), ["source", "subject"], "left")
    return df.join(realizations.select("initiative_id", "net", F.col("status").alias("measure")), "initiative_id", "left")


def run_comparison(runs: DataFrame, healthy: DataFrame) -> DataFrame:
    """Each run beside its last healthy one: times and how many times as long it took."""
    h = runs.select(F.col("run_id").alias("healthy_run_id"), F.col("execution_s").alias("healthy_s"))
    df = runs.select("run_id", "job_id", "execution_s").join(healthy.select("run_id", "healthy_run_id"), "run_id").join(h, "healthy_run_id", "left")
    return df.withColumn("times", F.when(F.col("healthy_s") > 0, F.round(F.col("execution_s") / F.col("healthy_s"), 4)))
