"""Hypotheses, evidence, incident lifecycle, impact and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.columns import severity_name, severity_rank, stable_id
from opsloom.functions.ordered import running_number
from opsloom.sources.scratch import cut

ACTIVE = ("detected", "triaged", "investigating", "mitigating")
ENDED = ("closed", "recovered", "cancelled")
CAP, TEMPORAL_CAP = 0.9, 0.5
#: Commits of a job that stand in one row, and the most pairs of a job and a sha that are broadcast.
BLOCK, FEW = 1000, 50_000


def _sum(*terms: tuple[Column, float]) -> Column:
    return F.round(reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in terms]), 4)


def runtime_hypotheses(df: DataFrame) -> DataFrame:
    """(incident_id, code, confidence) from one joined row a regression.

    Needs skew_ratio, new_operators, patch, input_rows, healthy_rows, env_changed, has_change.
    """
    growth = F.col("input_rows") / F.col("healthy_rows")
    moved = F.exists("new_operators", lambda o: o.contains("Window") | o.contains("Exchange hashpartitioning"))
    touched = F.coalesce(F.col("patch").rlike(r"(?i)\bjoin\b|Window|partitionBy"), F.lit(False))
    options = [
        ("skew_join_change", _sum((F.coalesce(F.col("skew_ratio") >= 10, F.lit(False)), 0.35), (F.coalesce(moved, F.lit(False)), 0.25), (touched, 0.25), (F.coalesce(growth < 1.5, F.lit(False)), 0.05))),
        ("volume_growth", F.when(growth.isNull(), 0.0).when(growth >= 1.5, 0.40).otherwise(0.05)),
        ("compute_change", F.when(F.col("env_changed").isNull(), 0.0).when(F.col("env_changed"), 0.50).otherwise(0.05)),
        ("change_temporal_only", F.when(F.col("has_change"), 0.30).otherwise(0.0)),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), v.cast("double").alias("confidence")) for c, v in options]))
    return df.select("incident_id", rows.alias("h")).select("incident_id", "h.code", "h.confidence").filter("confidence > 0")


def quality_hypotheses(df: DataFrame) -> DataFrame:
    """(incident_id, code, confidence) of violated contracts.

    Needs dimension, producer_ok, has_change, touches_column, upstream_changed, upstream_violated, upstream_volume.
    """
    structural = F.col("dimension").isin("schema", "validity")
    failure = F.when(F.col("producer_ok"), 0.0).when(structural, 0.05).otherwise(_sum((F.lit(True), 0.50), (F.col("dimension") == "freshness", 0.25)))
    options = [
        ("pipeline_failure", failure),
        ("code_change", F.when(F.col("has_change"), _sum((F.lit(True), 0.30), (F.col("touches_column"), 0.30))).otherwise(0.0)),
        ("upstream_change", F.when(F.col("upstream_changed"), _sum((F.lit(True), 0.35), (F.col("upstream_violated"), 0.25))).otherwise(0.0)),
        ("data_source_quality", F.when(F.col("upstream_violated"), _sum((F.lit(True), 0.45), (F.col("upstream_volume"), 0.15))).otherwise(0.0)),
        ("change_temporal_only", F.when(F.col("has_change"), 0.30).otherwise(0.0)),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), v.cast("double").alias("confidence")) for c, v in options]))
    return df.select("incident_id", rows.alias("h")).select("incident_id", "h.code", "h.confidence").filter("confidence > 0")


def rank_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """Caps the confidence (lower for causes known by time only) and ranks by it, then code."""
    cap = F.when(F.col("code") == "change_temporal_only", TEMPORAL_CAP).otherwise(CAP)
    df = hypotheses.withColumn("confidence", F.least("confidence", cap))
    return df.withColumn("rank", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("confidence"), "code")))


def changes_in_window(runs: DataFrame, changes: DataFrame, days: int = 7) -> DataFrame:
    """run_id, sha, nth: commits between the healthy run's end (or a week before) and the run's start, deployed one first.

    ``runs`` has run_id, job_id, git_sha, start_time, healthy_end; ``changes`` has job_id, sha, committed_at. The rows out, many
    for each run, are neither shuffled nor sorted: commits of a job are numbered by time, a window is a range of numbers, and a
    run meets the blocks of commits that its range touches. Only run ids that come again, and runs with a sha of jobs with
    commits without one, are sorted run by run.
    """
    since = F.coalesce("healthy_end", F.col("start_time") - F.expr(f"INTERVAL '{days}' DAY"))
    spans = runs.select("run_id", "job_id", "git_sha", "start_time", since.alias("since")).filter("since < start_time and job_id is not null")
    commits = changes.select("job_id", "sha", "committed_at").filter("job_id is not null and committed_at is not null")
    numbered = cut(_numbered(spans, commits))
    deployed = _deployed(numbered)
    ranges = cut(_ranges(numbered, deployed))
    odd = _odd(numbered, ranges)
    if not odd.limit(1).count():
        return _placed(ranges, numbered, deployed)
    is_odd = F.col("run_id").eqNullSafe(F.col("_odd"))
    return _placed(ranges.join(odd, is_odd, "left_anti"), numbered, deployed).unionByName(_sorted(spans.join(odd, is_odd, "left_semi"), commits, days))


def _numbered(spans: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits, and both ends of each run's window (``end``, with the run's sha), with ``number``: commits of the job up to then."""
    ends = spans.select("run_id", "job_id", F.col("git_sha").alias("sha"), F.explode(F.array("since", "start_time")).alias("at"), F.lit(True).alias("end"))
    rows = commits.select("job_id", "sha", F.col("committed_at").alias("at"), F.lit(False).alias("end")).unionByName(ends, allowMissingColumns=True)
    return running_number(rows, ["job_id"], ["at", "end", F.desc("sha")], ~F.col("end"), "number")


def _deployed(numbered: DataFrame) -> DataFrame:
    """The numbered rows whose sha is both a run's and a commit's of the job, with ``same``: commits of that sha up to then."""
    both = numbered.filter("sha is not null").groupBy("job_id", "sha").agg(F.max("end").alias("asked"), F.min("end").alias("never")).filter("asked and not never").select("job_id", "sha")
    both = cut(both)
    both = both.hint("broadcast" if both.limit(FEW + 1).count() <= FEW else "merge")
    return running_number(numbered.join(both, ["job_id", "sha"], "left_semi"), ["job_id", "sha"], ["at", "end", "number"], ~F.col("end"), "same")


def _ranges(numbered: DataFrame, deployed: DataFrame) -> DataFrame:
    """A row for each run_id: the numbers of its window (over ``low``, up to ``high``), those of its own sha likewise, and its window's ends."""
    ends = numbered.filter("end").select("run_id", "job_id", "sha", "number", F.lit(None).cast("long").alias("same"))
    ends = ends.unionByName(deployed.filter("end").select("run_id", "job_id", "sha", F.lit(None).cast("long").alias("number"), "same"))
    found = {"low": F.min("number"), "high": F.max("number"), "same_low": F.coalesce(F.min("same"), F.lit(0)), "same_high": F.coalesce(F.max("same"), F.lit(0))}
    return ends.groupBy("run_id").agg(F.max("job_id").alias("job_id"), F.max("sha").alias("git_sha"), F.count("number").alias("ends"), *[v.alias(k) for k, v in found.items()])


def _odd(numbered: DataFrame, ranges: DataFrame) -> DataFrame:
    """_odd: run ids of several runs, and those of runs with a sha in jobs with commits without one, which come last."""
    odd = ranges.filter("ends <> 2").select(F.col("run_id").alias("_odd"))
    nameless = numbered.filter("sha is null and not end").select("job_id").distinct()
    if nameless.limit(1).count():
        odd = odd.union(ranges.filter("ends = 2 and git_sha is not null").join(nameless, "job_id", "left_semi").select("run_id"))
    return odd


def _placed(ranges: DataFrame, numbered: DataFrame, deployed: DataFrame) -> DataFrame:
    """run_id, sha, nth of runs by their ranges: the commits of the run's sha by their count alone, the others block by block."""
    def block(number: Column) -> Column:
        return F.floor(number / F.lit(BLOCK))

    blocks = numbered.filter("not end").groupBy("job_id", block(F.col("number") - 1).alias("_slice")).agg(F.array_sort(F.collect_list(F.struct("number", "sha")))["sha"].alias("shas"))
    touched = ranges.filter("high > low").withColumn("_slice", F.explode(F.sequence(block(F.col("low")), block(F.col("high") - 1))))
    without = touched.filter("same_high = same_low").withColumns({"git_sha": F.lit(None).cast(ranges.schema["git_sha"].dataType), "before": F.lit(0)})
    upto = deployed.filter("not end").groupBy("job_id", F.col("sha").alias("git_sha"), block(F.col("number") - 1).alias("_slice")).agg(F.max("same").alias("upto"))
    earlier = W.partitionBy("run_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    held = F.coalesce(F.last("upto", ignorenulls=True).over(earlier), F.col("same_low")) - F.col("same_low")
    having = touched.filter("same_high > same_low").join(upto.hint("merge"), ["job_id", "git_sha", "_slice"], "left").withColumn("before", held)
    first, last = F.greatest("low", F.col("_slice") * BLOCK), F.least("high", (F.col("_slice") + 1) * BLOCK)
    parts = without.unionByName(having.drop("upto")).select("run_id", "job_id", "_slice", "git_sha", (first - F.col("_slice") * BLOCK).cast("int").alias("skip"), (last - first).cast("int").alias("take"), (F.col("high") - first + F.col("before")).alias("top"))
    part = F.slice("shas", F.col("skip") + 1, F.col("take"))
    others = parts.join(blocks.hint("merge"), ["job_id", "_slice"]).select("run_id", "top", F.posexplode(F.when(F.col("git_sha").isNull(), part).otherwise(F.array_remove(part, F.col("git_sha")))).alias("_k", "sha"))
    own = ranges.filter("same_high > same_low").select("run_id", F.col("git_sha").alias("sha"), (F.col("same_high") - F.col("same_low")).cast("int").alias("_n"))
    own = own.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(BLOCK)))).select("run_id", "sha", F.explode(F.sequence("_from", F.least("_n", F.col("_from") + (BLOCK - 1)))).alias("nth"))
    return others.select("run_id", "sha", (F.col("top") - F.col("_k")).cast("int").alias("nth")).unionByName(own)


def _sorted(spans: DataFrame, commits: DataFrame, days: int) -> DataFrame:
    """run_id, sha, nth of any runs, sorted run by run. A run meets only the commits of the slices of ``days`` days that its window touches."""
    def slice_of(at: str) -> Column:
        return F.floor(F.unix_date(F.col(at).cast("date")) / F.lit(days))

    spans = spans.withColumn("_slice", F.explode(F.sequence(slice_of("since"), slice_of("start_time"))))
    met = spans.join(commits.withColumn("_slice", slice_of("committed_at")), ["job_id", "_slice"]).filter("committed_at > since and committed_at <= start_time")
    w = W.partitionBy("run_id").orderBy(F.desc(F.col("sha") == F.col("git_sha")), F.desc("committed_at"), "sha")
    return met.select("run_id", "sha", F.row_number().over(w).alias("nth"))


def evidence(df: DataFrame, kind: str, summary: Column, value: Column, source: str) -> DataFrame:
    """Evidence rows of incidents: stable id of kind, source and summary; the hash adds the value."""
    return df.select("incident_id", stable_id("ev-", F.col("incident_id"), F.lit(kind), F.lit(source), summary).alias("evidence_id"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), summary.alias("summary"), value.cast("string").alias("value_json"), F.sha2(F.concat_ws("|", F.lit(kind), summary, value.cast("string")).cast("binary"), 256).alias("content_hash"))


def apply_reviews(hypotheses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds status: confirmed or rejected by the latest review, else open."""
    last = reviews.groupBy("hypothesis_id").agg(F.max(F.struct("reviewed_at", "decision")).alias("r")).select("hypothesis_id", F.when(F.col("r.decision") == "confirmed", F.lit("confirmed")).otherwise(F.lit("rejected")).alias("status"))
    return hypotheses.join(last, "hypothesis_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def top_cause(incidents: DataFrame, ranked: DataFrame) -> DataFrame:
    """incident_id, cause: the best hypothesis that is not rejected, else sem_hipotese."""
    best = ranked.filter("status <> 'rejected'").groupBy("incident_id").agg(F.min(F.struct("rank", "code")).alias("b"))
    return incidents.select("incident_id").join(best, "incident_id", "left").select("incident_id", F.coalesce("b.code", F.lit("sem_hipotese")).alias("cause"))


def timeline(df: DataFrame, kind: str, at: Column, detail: Column) -> DataFrame:
    return df.select("incident_id", stable_id("tl-", F.col("incident_id"), F.lit(kind), at.cast("string")).alias("entry_id"), F.lit(kind).alias("kind"), at.alias("at"), detail.cast("string").alias("detail"))


def narrative_fallback(ranked: DataFrame, most: int = 8, facts: DataFrame | None = None, cited: int = 2) -> DataFrame:
    """incident_id, narrative: rule-written sentences in the order of rank, each with up to ``cited`` facts.

    ``facts`` has incident_id, code, evidence_id and fact; those with the smallest ids are named.
    """
    line = F.format_string("%d. %s (%.2f)", F.col("rank"), F.col("code"), F.col("confidence"))
    if facts is not None:
        first = W.partitionBy("incident_id", "code").orderBy("evidence_id")
        named = facts.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= cited).groupBy("incident_id", "code").agg(F.array_sort(F.collect_list(F.struct("_n", "fact", "evidence_id"))).alias("_f"))
        ranked = ranked.join(named, ["incident_id", "code"], "left")
        text = F.array_join(F.transform("_f", lambda x: F.concat(x["fact"], F.lit(" ["), x["evidence_id"], F.lit("]"))), "; ")
        line = F.concat(line, F.when(F.col("_f").isNotNull(), F.concat(F.lit(": "), text)).otherwise(F.lit("")))
    return ranked.filter(F.col("rank") <= most).groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))), lambda x: x["s"]), "\n").alias("narrative"))


def validate_citations(narratives: DataFrame, evidence: DataFrame) -> DataFrame:
    """incident_id, reason: ok, invalid_json, no_citation or unknown_evidence of a narrated JSON text."""
    parsed = narratives.withColumn("p", F.from_json("text", "sentences array<struct<text:string,evidence:array<string>>>"))
    df = parsed.withColumn("cited", F.flatten(F.transform("p.sentences", lambda s: F.coalesce(s["evidence"], F.array().cast("array<string>")))))
    # only what the narratives cite is gathered, never an incident's evidence
    pairs = df.select("incident_id", F.explode("cited").alias("evidence_id")).distinct()
    missing = pairs.join(evidence.select("incident_id", "evidence_id"), ["incident_id", "evidence_id"], "left_anti")
    missing = missing.groupBy(F.col("incident_id").alias("_i")).agg(F.collect_set("evidence_id").alias("_missing"))
    df = df.join(missing, F.col("incident_id").eqNullSafe(F.col("_i")), "left")
    cited = F.col("cited")
    unknown = F.exists(cited, lambda c: c.isNull()) | F.coalesce(F.arrays_overlap(cited, "_missing"), F.lit(False))
    reason = F.when(F.col("p.sentences").isNull(), F.lit("invalid_json")).when(F.size(cited) == 0, F.lit("no_citation")).when(unknown, F.lit("unknown_evidence")).otherwise(F.lit("ok"))
    return df.select("incident_id", reason.alias("reason"))


def pending_narration(incidents: DataFrame, narratives: DataFrame) -> DataFrame:
    """Active incidents never narrated, or changed since."""
    last = narratives.groupBy("incident_id").agg(F.max("narrated_at").alias("narrated_at"))
    return incidents.filter(F.col("state").isin(*ACTIVE)).join(last, "incident_id", "left").filter("narrated_at is null or updated_at > narrated_at").select("incident_id")


def open_or_update(active: DataFrame, events: DataFrame) -> DataFrame:
    """One active incident a (tenant, subject, type): events touch it, or the first one opens it.

    ``events`` has tenant_id, subject, type, event_id, at; ``active`` has the keys, incident_id, first_event, last_event,
    version.
    """
    keys = ["tenant_id", "subject", "type"]
    ev = events.groupBy(*keys).agg(F.min(F.struct("at", "event_id")).alias("f"), F.max(F.struct("at", "event_id")).alias("l"), F.count(F.lit(1)).alias("n"))
    df = ev.join(active, keys, "full")
    fresh = F.col("incident_id").isNull()
    first = F.coalesce("first_event", "f.event_id")
    key = F.substring(F.sha2(F.concat_ws("|", *keys, first.cast("string")).cast("binary"), 256), 1, 16)
    version = F.when(fresh, F.col("n")).otherwise(F.col("version") + F.coalesce("n", F.lit(0)))
    return df.select(*keys, key.alias("correlation_key"), F.coalesce("incident_id", F.concat(F.lit("inc-"), F.substring(key, 1, 12))).alias("incident_id"), first.alias("first_event"), F.coalesce("l.event_id", "last_event").alias("last_event"), version.alias("version"), fresh.alias("opened"))


def resolve(incidents: DataFrame, evaluated: DataFrame, violating: DataFrame) -> DataFrame:
    """Active incidents whose subject was evaluated and does not violate become recovered; no evaluation resolves nothing.

    Where the sets have a type, only incidents of that type are meant.
    """
    keys = [k for k in ("subject", "type") if k in evaluated.columns]
    good = evaluated.select(*keys).distinct().join(violating.select(*keys), keys, "left_anti").withColumn("_good", F.lit(True))
    df = incidents.join(good, keys, "left")
    return df.withColumn("state", F.when(F.col("state").isin(*ACTIVE) & F.coalesce("_good", F.lit(False)), F.lit("recovered")).otherwise(F.col("state"))).drop("_good")


def closed_until(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("state").isin(*ENDED)).groupBy("subject", "type").agg(F.max("updated_at").alias("closed_until"))


def apply_impact(incidents: DataFrame, impact: DataFrame, escalations: DataFrame) -> DataFrame:
    """Adds impact_score and raises the severity; the earlier one is kept only on a real rise."""
    reached = F.col("affected_assets") if "affected_assets" in impact.columns else F.array().cast("array<string>")
    df = incidents.join(impact.select(F.col("origin").alias("asset"), F.col("impact_score").alias("_score"), reached.alias("affected_assets")), "asset", "left").join(escalations.select(F.col("origin").alias("asset"), F.col("severity").alias("_to"), "culprit"), "asset", "left")
    now, to = severity_rank(F.col("severity")), severity_rank(F.col("_to"))
    rise = F.col("_to").isNotNull() & (to > now)
    return df.withColumns({"impact_score": F.coalesce("_score", F.lit(0.0)), "escalated_from": F.when(rise, F.col("severity")), "severity": F.when(rise, F.col("_to")).otherwise(F.col("severity"))}).drop("_score", "_to")


def consumer_gaps(declared: Column, observed: Column) -> tuple[Column, Column]:
    """(undeclared, unseen) consumers, sorted."""
    return F.array_sort(F.array_except(observed, declared)), F.array_sort(F.array_except(declared, observed))


def acknowledge(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """First acknowledgement of active incidents; detected becomes triaged. Others are left as they are."""
    d = decisions.groupBy("incident_id").agg(F.min(F.struct("at", "actor")).alias("d"))
    df = incidents.join(d, "incident_id", "left")
    takes = F.col("d").isNotNull() & F.col("state").isin(*ACTIVE) & F.col("acknowledged_at").isNull()
    return df.withColumns({"acknowledged_by": F.when(takes, F.col("d.actor")), "acknowledged_at": F.when(takes, F.col("d.at")).otherwise(F.col("acknowledged_at")), "state": F.when(takes & (F.col("state") == "detected"), F.lit("triaged")).otherwise(F.col("state"))}).drop("d")


def worst_severity(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"))


# --- what was evaluated, and what still violates


def quality_state(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluated, violating) as (subject, type): any current result of an asset evaluates both quality types."""
    both = F.explode(F.array(F.lit("contract_violation"), F.lit("quality_engine_failure")))
    evaluated = results.select(F.col("asset").alias("subject")).distinct().select("subject", both.alias("type"))
    kind = F.when(F.col("status") == "violated", F.lit("contract_violation")).when(F.col("status") == "evaluation_error", F.lit("quality_engine_failure"))
    return evaluated, results.select(F.col("asset").alias("subject"), kind.alias("type")).filter("type is not null").distinct()


def runtime_state(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluated, violating) by the latest run of each job that has a baseline: a failed run proves no recovery."""
    judged = verdicts.filter("verdict <> 'insufficient_baseline'")
    last = judged.groupBy("job_id").agg(F.max(F.struct("end_time", "run_id", "result_state", "verdict")).alias("r"))
    last = last.select(F.col("job_id").alias("subject"), F.lit("runtime_regression").alias("type"), "r.result_state", "r.verdict")
    return last.filter("result_state = 'SUCCESS'").select("subject", "type"), last.filter("verdict = 'regression'").select("subject", "type")


def sla_state(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluated, violating): assets with a live forecast, and those at risk."""
    rows = predictions.filter(F.col("class").isin("no_prazo", "em_risco", "inevitavel")).select(F.col("asset").alias("subject"), F.lit("sla_risk").alias("type"), "class")
    return rows.select("subject", "type").distinct(), rows.filter("class <> 'no_prazo'").select("subject", "type").distinct()


# --- decisions, as tables that are applied in one go


def accept_regime(decisions: DataFrame, incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """(job_id, mark_at): the new regime of an accepted regression starts with the first run of its incident."""
    first = decisions.select("incident_id").distinct().join(incidents.select("incident_id", "first_event"), "incident_id")
    return first.join(runs.select(F.col("run_id").alias("first_event"), "job_id", "start_time"), "first_event").groupBy("job_id").agg(F.max("start_time").alias("mark_at"))


def promote_problem(decisions: DataFrame, incidents: DataFrame) -> DataFrame:
    """(problem_id, type, subject, cause, promoted_at, promoted_by): one problem a signature, promoted once."""
    met = decisions.join(incidents.select("incident_id", "type", "subject", "cause"), "incident_id")
    first = met.groupBy("type", "subject", "cause").agg(F.min(F.struct("at", "actor")).alias("d"))
    return first.select(stable_id("prb-", F.col("type"), F.col("subject"), F.col("cause")).alias("problem_id"), "type", "subject", "cause", F.col("d.at").alias("promoted_at"), F.col("d.actor").alias("promoted_by"))


def register_fix(problems: DataFrame, decisions: DataFrame) -> DataFrame:
    """Problems with their latest fix (fixed_at, fix_text); an empty text registers nothing."""
    last = decisions.filter(F.trim("fix_text") != "").groupBy("problem_id").agg(F.max(F.struct("at", "fix_text")).alias("d"))
    rest = [c for c in problems.columns if c not in ("fixed_at", "fix_text")]
    old = F.col("fixed_at") if "fixed_at" in problems.columns else F.lit(None).cast("timestamp")
    text = F.col("fix_text") if "fix_text" in problems.columns else F.lit(None).cast("string")
    return problems.join(last, "problem_id", "left").select(*rest, F.coalesce("d.at", old).alias("fixed_at"), F.coalesce("d.fix_text", text).alias("fix_text"))


def follow_runbook(decisions: DataFrame, applicable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses, refused): a runbook is followed once an incident, from the first time on, and only where it applies."""
    known = applicable.select("incident_id", "runbook_id").distinct()
    uses = decisions.join(known, ["incident_id", "runbook_id"]).groupBy("incident_id", "runbook_id").agg(F.min(F.struct("at", "actor")).alias("d"))
    return uses.select("incident_id", "runbook_id", F.col("d.at").alias("used_at"), F.col("d.actor").alias("used_by")), decisions.join(known, ["incident_id", "runbook_id"], "left_anti")


def review_rows(decisions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(review_id, hypothesis_id, decision, reviewed_at, actor) of legal reviews of known hypotheses."""
    known = decisions.filter(F.col("decision").isin("confirmed", "rejected")).join(hypotheses.select("hypothesis_id").distinct(), "hypothesis_id", "left_semi")
    return known.select(stable_id("rev-", F.col("hypothesis_id"), F.col("decision"), F.col("actor"), F.col("at")).alias("review_id"), "hypothesis_id", "decision", F.col("at").alias("reviewed_at"), "actor").dropDuplicates(["review_id"])
