"""Queries of hypotheses, incidents, knowledge, semantics and SLA."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.formulas import declared_hash
from opsloom.operators import incidents as I
from opsloom.operators import knowledge as K
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query



def now():
    """The fixed instant of these queries."""
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("""WITH c AS (SELECT 'i' || CAST(o_orderkey AS string) AS incident_id, 1 + o_orderkey % 20 AS skew, o_orderkey % 2 = 0 AS moved, o_orderkey % 9 IN (0, 2, 6) AS touched, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END AS growth, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 = 1 END AS env, o_orderkey % 7 = 0 AS chg FROM orders),
    h AS (SELECT incident_id, 'skew_join_change' AS code, round(CASE WHEN skew >= 10 THEN 0.35 ELSE 0 END + CASE WHEN moved THEN 0.25 ELSE 0 END + CASE WHEN touched THEN 0.25 ELSE 0 END + CASE WHEN growth < 1.5 THEN 0.05 ELSE 0 END, 4) AS conf FROM c
    UNION ALL SELECT incident_id, 'volume_growth', CASE WHEN growth IS NULL THEN 0 WHEN growth >= 1.5 THEN 0.4 ELSE 0.05 END FROM c UNION ALL SELECT incident_id, 'compute_change', CASE WHEN env IS NULL THEN 0 WHEN env THEN 0.5 ELSE 0.05 END FROM c UNION ALL SELECT incident_id, 'change_temporal_only', CASE WHEN chg THEN 0.3 ELSE 0 END FROM c)
    SELECT incident_id, code, CAST(least(conf, 0.9) AS double) AS confidence, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY conf DESC, code) AS int) AS rank FROM h WHERE conf > 0""")
def runtime_hypotheses(spark, sf_dir):
    c = table(spark, sf_dir, "orders").selectExpr("'i' || o_orderkey incident_id", "cast(1 + o_orderkey % 20 as double) skew_ratio", "case when o_orderkey % 2 = 0 then array('Window') else array('Sort') end new_operators", "case when o_orderkey % 9 = 0 then '+a.join(b)' when o_orderkey % 9 = 1 then '+joined_at = rejoin(x)' when o_orderkey % 9 = 2 then '+W.PARTITIONBY(k)' when o_orderkey % 9 = 6 then '-LEFT JOIN t' when o_orderkey % 9 = 7 then '+x = 1' end patch", "cast(case when o_orderkey % 4 = 0 then null else 1 + o_orderkey % 3 end as double) input_rows", "1.0d healthy_rows", "case when o_orderkey % 5 = 0 then null else o_orderkey % 5 = 1 end env_changed", "o_orderkey % 7 = 0 has_change")
    return I.rank_hypotheses(I.runtime_hypotheses(c))


@query("""WITH c AS (SELECT 'i' || CAST(o_orderkey AS string) AS incident_id, o_orderkey % 4 AS d, o_orderkey % 3 = 0 AS ok, o_orderkey % 5 < 2 AS chg, o_orderkey % 2 = 0 AS tc, o_orderkey % 7 = 0 AS uc, o_orderkey % 11 < 4 AS uv, o_orderkey % 13 = 0 AS vol FROM orders),
    h AS (SELECT incident_id, 'pipeline_failure' AS code, CASE WHEN ok THEN 0 WHEN d = 0 THEN 0.05 WHEN d = 1 THEN 0.75 ELSE 0.5 END AS conf FROM c UNION ALL SELECT incident_id, 'code_change', CASE WHEN chg THEN CASE WHEN tc THEN 0.6 ELSE 0.3 END ELSE 0 END FROM c UNION ALL SELECT incident_id, 'upstream_change', CASE WHEN uc THEN CASE WHEN uv THEN 0.6 ELSE 0.35 END ELSE 0 END FROM c
    UNION ALL SELECT incident_id, 'data_source_quality', CASE WHEN uv THEN CASE WHEN vol THEN 0.6 ELSE 0.45 END ELSE 0 END FROM c UNION ALL SELECT incident_id, 'change_temporal_only', CASE WHEN chg THEN 0.3 ELSE 0 END FROM c)
    SELECT incident_id, code, CAST(conf AS double) AS confidence, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY conf DESC, code) AS int) AS rank FROM h WHERE conf > 0""")
def quality_hypotheses(spark, sf_dir):
    c = table(spark, sf_dir, "orders").selectExpr("'i' || o_orderkey incident_id", "case o_orderkey % 4 when 0 then 'schema' when 1 then 'freshness' else 'volume' end dimension", "o_orderkey % 3 = 0 producer_ok", "o_orderkey % 5 < 2 has_change", "o_orderkey % 2 = 0 touches_column", "o_orderkey % 7 = 0 upstream_changed", "o_orderkey % 11 < 4 upstream_violated", "o_orderkey % 13 = 0 upstream_volume")
    return I.rank_hypotheses(I.quality_hypotheses(c))


@query(with_("runs", "changes") + """, c AS (SELECT 'job-' || CAST(CAST(substr(sha, 2) AS bigint) % 20 AS string) AS job_id, CASE WHEN CAST(substr(sha, 2) AS bigint) % 30 = 0 THEN 'sha0' || '00000' ELSE sha END AS sha, committed_at, sha AS raw FROM changes)
    SELECT run_id, sha, CAST(row_number() OVER (PARTITION BY run_id ORDER BY sha = git_sha DESC, committed_at DESC, sha) AS int) AS nth FROM runs r JOIN c ON c.job_id = r.job_id AND committed_at > start_time - INTERVAL '7' DAY AND committed_at <= start_time""")
def changes_in_window(spark, sf_dir):
    c = fixture(spark, sf_dir, "changes").selectExpr("'job-' || (cast(substr(sha, 2) as bigint) % 20) job_id", "case when cast(substr(sha, 2) as bigint) % 30 = 0 then 'sha000000' else sha end sha", "committed_at")
    return I.changes_in_window(fixture(spark, sf_dir, "runs").withColumn("healthy_end", F.lit(None).cast("timestamp")), c)


_H = with_("incidents", "hypotheses", "reviews") + """, r AS (SELECT hypothesis_id, arg_max(decision, (reviewed_at, decision)) AS d FROM reviews GROUP BY 1), h AS (SELECT incident_id, h.hypothesis_id, code, least(confidence, CASE WHEN code = 'change_temporal_only' THEN 0.5 ELSE 0.9 END) AS confidence, coalesce(r.d, 'open') AS status FROM hypotheses h LEFT JOIN r ON r.hypothesis_id = h.hypothesis_id),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, code) AS int) AS rank FROM h)"""


def _ranked(spark, sf_dir):
    return I.apply_reviews(I.rank_hypotheses(fixture(spark, sf_dir, "hypotheses")), fixture(spark, sf_dir, "reviews"))


@query(_H + " SELECT incident_id, hypothesis_id, CAST(confidence AS double) AS confidence, rank, status FROM k")
def reviewed_hypotheses(spark, sf_dir):
    return _ranked(spark, sf_dir).select("incident_id", "hypothesis_id", "confidence", "rank", "status")


@query(_H + ", b AS (SELECT incident_id, arg_min(code, rank) AS code FROM k WHERE status <> 'rejected' GROUP BY 1) SELECT i.incident_id, coalesce(b.code, 'sem_hipotese') AS cause FROM incidents i LEFT JOIN b ON b.incident_id = i.incident_id")
def top_causes(spark, sf_dir):
    return I.top_cause(fixture(spark, sf_dir, "incidents"), _ranked(spark, sf_dir))


@query(with_("incidents") + " SELECT incident_id, 'ev-' || substr(sha256(incident_id || '|metric|runs|slow ' || subject), 1, 12) AS evidence_id, sha256('metric|slow ' || subject || '|' || CAST(event_id AS string)) AS content_hash FROM incidents")
def evidence_rows(spark, sf_dir):
    return I.evidence(fixture(spark, sf_dir, "incidents"), "metric", F.concat(F.lit("slow "), "subject"), F.col("event_id"), "runs").select("incident_id", "evidence_id", "content_hash")


@query(with_("incidents") + " SELECT incident_id, 'detected' AS kind, 'tl-' || substr(sha256(incident_id || '|detected|' || CAST(date_trunc('second', detected_at) AS string)), 1, 12) AS entry_id, severity AS detail FROM incidents")
def timeline_entries(spark, sf_dir):
    return I.timeline(fixture(spark, sf_dir, "incidents"), "detected", F.date_trunc("second", F.col("detected_at").cast("timestamp")), F.col("severity")).drop("at")


@query(_H + " SELECT incident_id, string_agg(printf('%d. %s (%.2f)', rank, code, CAST(confidence AS double)), chr(10) ORDER BY rank) AS narrative FROM k WHERE rank <= 2 GROUP BY 1")
def narratives(spark, sf_dir):
    return I.narrative_fallback(_ranked(spark, sf_dir), 2)


@query(with_("incidents") + " SELECT incident_id, CASE event_id % 4 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'no_citation' WHEN 2 THEN 'unknown_evidence' ELSE 'ok' END AS reason FROM incidents")
def citations(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    n = i.selectExpr("incident_id", """case event_id % 4 when 0 then 'oops' when 1 then '{"sentences":[{"text":"a"}]}' when 2 then '{"sentences":[{"text":"a","evidence":["zz"]}]}' else '{"sentences":[{"text":"a","evidence":["e1"]}]}' end text""")
    return I.validate_citations(n, i.selectExpr("incident_id", "'e1' evidence_id"))


@query(with_("incidents") + " SELECT incident_id FROM incidents WHERE state IN ('detected', 'triaged') AND (event_id % 3 = 0 OR event_id % 4000 > 600)")
def pending_narrations(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    return I.pending_narration(i, i.filter("event_id % 3 <> 0").selectExpr("incident_id", "detected_at + interval '600' minute narrated_at"))


@query(with_("observations") + """, e AS (SELECT 't' AS tenant_id, subject, type, event_id, time FROM observations WHERE type IN ('error', 'signup')), a AS (SELECT DISTINCT 't' AS tenant_id, subject, type FROM e WHERE length(subject) = 5),
    g AS (SELECT subject, type, arg_min(event_id, (time, event_id)) AS f, arg_max(event_id, (time, event_id)) AS l, count(*) AS n FROM e GROUP BY 1, 2), j AS (SELECT g.*, a.subject IS NOT NULL AS old, CASE WHEN a.subject IS NOT NULL THEN -1 ELSE f END AS first FROM g LEFT JOIN a ON a.subject = g.subject AND a.type = g.type)
    SELECT subject, type, substr(sha256('t|' || subject || '|' || type || '|' || CAST(first AS string)), 1, 16) AS correlation_key, l AS last_event, CAST(CASE WHEN old THEN n + 3 ELSE n END AS bigint) AS version, NOT old AS opened FROM j""")
def opened_incidents(spark, sf_dir):
    e = fixture(spark, sf_dir, "observations").filter("type in ('error', 'signup')").selectExpr("'t' tenant_id", "subject", "type", "event_id", "time at")
    a = e.filter("length(subject) = 5").select("tenant_id", "subject", "type").distinct().selectExpr("*", "'x' incident_id", "-1L first_event", "-1L last_event", "3L version")
    return I.open_or_update(a, e).select("subject", "type", "correlation_key", "last_event", "version", "opened")


@query(with_("incidents") + " SELECT incident_id, CASE WHEN state IN ('detected', 'triaged') AND user_id % 25 % 3 = 0 AND user_id % 25 % 2 = 0 THEN 'recovered' ELSE state END AS state FROM incidents")
def resolved_incidents(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    return I.resolve(i, i.filter("user_id % 25 % 3 = 0").select("subject"), i.filter("user_id % 25 % 2 = 1").select("subject")).select("incident_id", "state")


@query(with_("incidents") + " SELECT subject, type, CAST(max(date_trunc('second', updated_at)) AS string) AS closed_until FROM incidents WHERE state IN ('closed', 'recovered') GROUP BY 1, 2")
def closed_until(spark, sf_dir):
    return I.closed_until(fixture(spark, sf_dir, "incidents")).withColumn("closed_until", F.date_trunc("second", F.col("closed_until").cast("timestamp")).cast("string"))


# the impact of an asset is what customers of its number owe; one that has a customer in debt of a large segment escalates
_IMPACT = ", im AS (SELECT 'asset.' || CAST(c_custkey % 40 AS string) AS asset, round(sum(c_acctbal) / 1000, 4) AS score, max(CASE WHEN c_acctbal < -900 AND c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS up FROM customer WHERE c_custkey % 40 % 7 > 0 GROUP BY 1)"


@query(with_("incidents") + _IMPACT + """ SELECT incident_id, coalesce(score, 0) AS impact_score, CASE WHEN up = 1 AND severity NOT IN ('critical', 'blocking') THEN 'critical' ELSE severity END AS severity, CASE WHEN up = 1 AND severity NOT IN ('critical', 'blocking') THEN severity END AS escalated_from FROM incidents LEFT JOIN im ON im.asset = incidents.asset""")
def impacted_incidents(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 40 % 7 > 0").selectExpr("'asset.' || (c_custkey % 40) origin", "c_acctbal", "c_mktsegment", "c_custkey")
    impact = c.groupBy("origin").agg(F.round(F.sum("c_acctbal") / 1000, 4).alias("impact_score"))
    up = c.filter("c_acctbal < -900 and c_mktsegment = 'BUILDING'").groupBy("origin").agg(F.lit("critical").alias("severity"), F.min("c_custkey").cast("string").alias("culprit"))
    out = I.apply_impact(fixture(spark, sf_dir, "incidents"), impact, up)
    return out.select("incident_id", "impact_score", "severity", "escalated_from")


@query("""WITH d AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_linenumber <= 2), o AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_linenumber % 2 = 0), p AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
    SELECT p.k, coalesce((SELECT string_agg(CAST(o.s AS string), ',' ORDER BY o.s) FROM o WHERE o.k = p.k AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = o.k AND d.s = o.s)), '') AS undeclared, coalesce((SELECT string_agg(CAST(d.s AS string), ',' ORDER BY d.s) FROM d WHERE d.k = p.k AND NOT EXISTS (SELECT 1 FROM o WHERE o.k = d.k AND o.s = d.s)), '') AS unseen FROM p""")
def consumer_gaps(spark, sf_dir):
    """Suppliers of the first lines of a part are declared, those of even lines are seen."""
    li = table(spark, sf_dir, "lineitem")
    some = lambda c: F.collect_set(F.when(c, F.col("l_suppkey")))
    sets = li.groupBy(F.col("l_partkey").alias("k")).agg(some(F.col("l_linenumber") <= 2).alias("d"), some(F.col("l_linenumber") % 2 == 0).alias("o"))
    undeclared, unseen = I.consumer_gaps(F.col("d"), F.col("o"))
    return sets.select("k", F.array_join(undeclared, ",").alias("undeclared"), F.array_join(unseen, ",").alias("unseen"))


@query(with_("incidents") + " SELECT incident_id, CASE WHEN state = 'detected' AND event_id % 2 = 0 AND acknowledged_at IS NULL THEN 'triaged' ELSE state END AS state, CASE WHEN state IN ('detected', 'triaged') AND event_id % 2 = 0 AND acknowledged_at IS NULL THEN 'a' END AS acknowledged_by FROM incidents")
def acknowledged_incidents(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    d = i.filter("event_id % 2 = 0").selectExpr("incident_id", "explode(array(named_struct('at', updated_at, 'actor', 'a'), named_struct('at', updated_at + interval '1' hour, 'actor', 'b'))) x").select("incident_id", "x.*")
    return I.acknowledge(i, d).select("incident_id", "state", "acknowledged_by")


# --- knowledge

_C = with_("incidents") + ", i AS (SELECT *, 'cause' || CAST(event_id % 3 AS string) AS cause FROM incidents)"


def _caused(spark, sf_dir):
    return fixture(spark, sf_dir, "incidents").withColumn("cause", F.expr("'cause' || cast(event_id % 3 as string)"))


@query(_C + f""" SELECT type, subject, cause, count(*) AS n, round(sum(impact_score), 4) AS impact, round(sum((floor(epoch({_NOW})) - floor(epoch(detected_at))) / 3600), 2) AS open_hours, subject = 'job-1' AS promoted FROM i WHERE detected_at > {_NOW} - INTERVAL '30' DAY GROUP BY type, subject, cause HAVING count(*) >= 3 OR subject = 'job-1'""")
def problem_candidates(spark, sf_dir):
    i = _caused(spark, sf_dir).withColumn("ended_at", F.lit(None).cast("timestamp"))
    return K.problem_candidates(i, i.filter("subject = 'job-1'"), now()).drop("first_at", "last_at")


_PROB = _C + f", p AS (SELECT type, subject, cause, CASE WHEN min(event_id) % 4 <> 0 THEN {_NOW} - INTERVAL '1' DAY * CAST(min(event_id) % 45 AS int) END AS fixed_at FROM i GROUP BY 1, 2, 3)"


@query(_PROB + f" SELECT p.type || p.subject || p.cause AS problem_id, CASE WHEN fixed_at IS NULL THEN 'aberto' WHEN EXISTS (SELECT 1 FROM i WHERE i.type = p.type AND i.subject = p.subject AND i.cause = p.cause AND i.detected_at > p.fixed_at) THEN 'ineficaz' WHEN fixed_at <= {_NOW} - INTERVAL '30' DAY THEN 'resolvido' ELSE 'em_observacao' END AS status FROM p")
def fix_efficacy(spark, sf_dir):
    return K.fix_efficacy(_problems(spark, sf_dir), _caused(spark, sf_dir), now())


def _problems(spark, sf_dir):
    p = _caused(spark, sf_dir).groupBy("type", "subject", "cause").agg(F.min("event_id").alias("e"))
    return p.selectExpr("type", "subject", "cause", "type || subject || cause problem_id", "case when e % 4 <> 0 then timestamp '2024-01-31 00:00:00' - interval '1' day * cast(e % 45 as int) end fixed_at")


@query(_C + """ SELECT incident_id, other, CAST(level AS int) AS level, CAST(nth AS int) AS nth FROM (SELECT t.incident_id, o.incident_id AS other, CASE WHEN t.cause = o.cause AND t.subject = o.subject THEN 1 WHEN t.cause = o.cause THEN 2 ELSE 3 END AS level,
    row_number() OVER (PARTITION BY t.incident_id ORDER BY CASE WHEN t.cause = o.cause AND t.subject = o.subject THEN 1 WHEN t.cause = o.cause THEN 2 ELSE 3 END, o.state = 'recovered' DESC, o.detected_at DESC, o.incident_id) AS nth
    FROM i t JOIN i o ON o.type = t.type AND (o.cause = t.cause OR o.subject = t.subject) AND o.incident_id <> t.incident_id AND o.detected_at < t.detected_at AND o.detected_at >= t.detected_at - INTERVAL '90' DAY WHERE t.state IN ('detected', 'triaged')) AS x WHERE nth <= 5""")
def similar_incidents(spark, sf_dir):
    i = _caused(spark, sf_dir)
    return K.similar_incidents(i, i.filter("state in ('detected', 'triaged')"))


@query(with_("incidents") + f""", u AS (SELECT 'rb' || CAST(event_id % 6 AS string) AS runbook_id, incident_id, state, detected_at + INTERVAL '5' MINUTE AS used_at, updated_at FROM incidents WHERE event_id % 2 = 0),
    v AS (SELECT *, state = 'recovered' AND (floor(epoch(updated_at)) - floor(epoch(used_at))) / 3600 BETWEEN 0 AND 24 AS good, (floor(epoch(updated_at)) - floor(epoch(used_at))) / 3600 AS h FROM u), w AS (SELECT *, NOT good AND used_at > {_NOW} - INTERVAL '24' HOUR AS fresh FROM v)
    SELECT runbook_id, count(CASE WHEN NOT fresh THEN 1 END) AS decided, count(CASE WHEN good THEN 1 END) AS successes, count(CASE WHEN fresh THEN 1 END) AS pending, round(median(CASE WHEN good THEN h END), 6) AS median_hours, round(count(CASE WHEN good THEN 1 END) / nullif(count(CASE WHEN NOT fresh THEN 1 END), 0), 6) AS ratio, count(CASE WHEN NOT fresh THEN 1 END) < 5 AS small_sample FROM w GROUP BY 1""")
def runbook_efficacy(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    u = i.filter("event_id % 2 = 0").selectExpr("'rb' || (event_id % 6) runbook_id", "incident_id", "explode(array(detected_at + interval '5' minute, detected_at + interval '50' minute)) used_at")
    return K.runbook_efficacy(u, i, now()).withColumns({"ratio": F.round("ratio", 6), "median_hours": F.round("median_hours", 6)})


@query(_C + """, r AS (SELECT * FROM (VALUES ('a', 'sla_risk', 'cause1', 'approved'), ('b', 'sla_risk', NULL, 'draft'), ('c', 'sla_risk', NULL, 'approved'), ('d', 'cost_regression', 'cause2', 'draft')) AS v(runbook_id, type, wants, status))
    SELECT incident_id, runbook_id, CASE WHEN wants = cause THEN 1 ELSE 2 END AS level, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN wants = cause THEN 1 ELSE 2 END, status = 'approved' DESC, runbook_id) AS int) AS nth FROM i JOIN r ON r.type = i.type WHERE wants IS NULL OR wants = cause""")
def applicable_runbooks(spark, sf_dir):
    r = spark.createDataFrame([("a", "sla_risk", ["cause1"], [], "approved"), ("b", "sla_risk", [], [], "draft"), ("c", "sla_risk", [], [], "approved"), ("d", "cost_regression", ["cause2"], [], "draft")], "runbook_id string, type string, causes array<string>, only_dimensions array<string>, status string")
    return K.applicable_runbooks(_caused(spark, sf_dir).withColumn("dimensions", F.array(F.lit("volume"))), r)


@query(_PROB + f", s AS (SELECT type || subject || cause AS problem_id, cause FROM p WHERE fixed_at <= TIMESTAMP '2024-03-15 00:00:00' - INTERVAL '30' DAY AND NOT EXISTS (SELECT 1 FROM i WHERE i.type = p.type AND i.subject = p.subject AND i.cause = p.cause AND i.detected_at > p.fixed_at)) SELECT problem_id, 'For ' || cause || ': salt the key' AS suggestion FROM s")
def knowledge_items(spark, sf_dir):
    p = _problems(spark, sf_dir)
    done = K.fix_efficacy(p, _caused(spark, sf_dir), F.expr("timestamp '2024-03-15 00:00:00'")).join(p.select("problem_id", "cause"), "problem_id")
    return K.knowledge_items(done, p.selectExpr("problem_id", "'salt the key' fix_text")).select("problem_id", "suggestion")


@query(_H + """, b AS (SELECT incident_id, arg_min(struct_pack(code := code, s := status, c := confidence), (status <> 'confirmed', rank)) AS x FROM k WHERE status <> 'rejected' GROUP BY 1), m AS (SELECT incident_id, x.code AS code, CASE WHEN x.s = 'confirmed' OR x.c >= 0.7 THEN 'act' ELSE 'collect' END AS mode FROM b)
    SELECT incident_id, code, mode, unnest([0, 1]) AS nth, unnest([mode || ' ' || code, 'then check']) AS step FROM m""")
def recommendations(spark, sf_dir):
    codes = spark.createDataFrame([(c, m, [f"{m} {c}", "then check"]) for c in ("skew_join_change", "volume_growth", "change_temporal_only") for m in ("act", "collect")], "code string, mode string, steps array<string>")
    return K.recommendations(_ranked(spark, sf_dir), codes)


@query(with_("reviews") + " SELECT count(CASE WHEN decision = 'confirmed' THEN 1 END) AS accepted, count(*) AS decided, round(count(CASE WHEN decision = 'confirmed' THEN 1 END) / count(*), 8) AS rate FROM reviews")
def acceptance_rate(spark, sf_dir):
    r = fixture(spark, sf_dir, "reviews").selectExpr("case decision when 'confirmed' then 'accepted' else 'rejected' end decision")
    return K.acceptance_rate(r).withColumn("rate", F.round("rate", 8))


@query(with_("observations") + " SELECT subject AS incident_id, array_to_string(list_sort(list(DISTINCT regexp_extract(data, '[0-9]+'))), ',') AS dimensions FROM observations GROUP BY 1")
def violation_dimensions(spark, sf_dir):
    o = fixture(spark, sf_dir, "observations").selectExpr("subject incident_id", "'{\"dimension\":\"' || get_json_object(data, '$.k') || '\"}' value_json")
    return K.violation_dimensions(o).withColumn("dimensions", F.array_join("dimensions", ","))


_ADVICE = with_("incidents") + """, cand AS (
    SELECT 'severity' AS kind, incident_id AS subject, severity AS detail FROM incidents WHERE severity IN ('warning', 'high') AND state IN ('detected', 'triaged')
    UNION ALL SELECT DISTINCT 'connector', 'c' || CAST(user_id % 50 AS string), 'degraded' FROM incidents WHERE user_id % 50 % 7 = 0
    UNION ALL SELECT 'runbook', incident_id, 'r1,r2' FROM incidents WHERE event_id % 3 = 0)"""


def _candidates(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    connectors = i.selectExpr("'c' || user_id % 50 connector", "case when user_id % 50 % 7 = 0 then 'degraded' else 'healthy' end status").distinct()
    one = i.selectExpr("incident_id", "event_id % 3 k")
    books = one.filter("k = 0").selectExpr("incident_id", "'r1' runbook_id", "1 level").unionByName(one.selectExpr("incident_id", "'r2' runbook_id", "case when k = 2 then 2 else 1 end level"))
    return K.advisor_candidates(i, connectors, books)


@query(_ADVICE + " SELECT * FROM cand")
def advisor_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(_ADVICE + " SELECT c.kind, c.subject, CAST(event_id % 100 AS double) / 100 AS confidence FROM cand c JOIN incidents ON incident_id = c.subject WHERE event_id % 100 >= 70 AND c.kind = 'severity'")
def advisor_recommendations(spark, sf_dir):
    answers = fixture(spark, sf_dir, "incidents").selectExpr("'severity' kind", "incident_id subject", "cast(event_id % 100 as double) / 100 confidence")
    return K.advisor_recommendations(_candidates(spark, sf_dir), answers)


_M = "WITH d AS (SELECT DISTINCT 'a' || CAST(c_custkey % 30 AS string) AS asset, 'm' || CAST(c_custkey % 7 AS string) AS metric_id, 'f' || CAST(c_custkey % 30 % 5 AS string) AS formula_hash FROM customer WHERE c_custkey % 30 < 25), o AS (SELECT DISTINCT 'a' || CAST(c_custkey % 30 AS string) AS asset, CASE WHEN c_custkey % 13 <> 0 THEN 'm' || CAST(c_custkey % 7 AS string) END AS metric_id, 'f' || CAST(c_custkey % 30 % 5 + CASE WHEN c_custkey % 77 = 0 THEN 1 ELSE 0 END AS string) AS formula_hash, CASE WHEN c_custkey % 91 = 0 THEN 'day' ELSE 'month' END AS grain FROM customer WHERE c_custkey % 30 > 3)"


@query(_M + """, n AS (SELECT * FROM o WHERE metric_id IS NOT NULL), per AS (SELECT asset, metric_id, count(DISTINCT formula_hash) AS f, count(DISTINCT grain) AS g FROM n GROUP BY 1, 2)
    SELECT 'formula_conflict' AS kind, asset, metric_id FROM per WHERE f > 1 UNION ALL SELECT 'grain_conflict', asset, metric_id FROM per WHERE f = 1 AND g > 1 UNION ALL SELECT 'synonym', asset, min(metric_id) FROM n GROUP BY asset, formula_hash HAVING count(DISTINCT metric_id) > 1
    UNION ALL SELECT 'declared_not_computed', asset, metric_id FROM (SELECT DISTINCT asset, metric_id FROM d EXCEPT SELECT asset, metric_id FROM per) AS q UNION ALL SELECT 'computed_not_declared', asset, metric_id FROM (SELECT asset, metric_id FROM per EXCEPT SELECT asset, metric_id FROM d) AS q
    UNION ALL SELECT 'declared_mismatch', d.asset, d.metric_id FROM d JOIN n ON n.asset = d.asset AND n.metric_id = d.metric_id GROUP BY d.asset, d.metric_id HAVING max(CASE WHEN n.formula_hash = d.formula_hash THEN 1 ELSE 0 END) = 0""")
def metric_divergences(spark, sf_dir):
    return _divergences(spark, sf_dir)


def _divergences(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    d = c.filter("c_custkey % 30 < 25").selectExpr("'a' || (c_custkey % 30) asset", "'m' || (c_custkey % 7) metric_id", "'f' || (c_custkey % 30 % 5) formula_hash", "'canonical' status").distinct()
    o = c.filter("c_custkey % 30 > 3").selectExpr("'a' || (c_custkey % 30) asset", "case when c_custkey % 13 <> 0 then 'm' || (c_custkey % 7) end metric_id", "'f' || (c_custkey % 30 % 5 + case when c_custkey % 77 = 0 then 1 else 0 end) formula_hash", "case when c_custkey % 91 = 0 then 'day' else 'month' end grain", "'extraida' extraction_status").distinct()
    return K.metric_divergences(d, o)


@query(_M + ", n AS (SELECT * FROM o WHERE metric_id IS NOT NULL), per AS (SELECT asset, metric_id, count(DISTINCT formula_hash) AS f, count(DISTINCT grain) AS g FROM n GROUP BY 1, 2), b AS (SELECT asset, 'formula_conflict:' || metric_id AS x FROM per WHERE f > 1 UNION SELECT asset, 'grain_conflict:' || metric_id FROM per WHERE f = 1 AND g > 1 UNION SELECT d.asset, 'declared_mismatch:' || d.metric_id FROM d JOIN n ON n.asset = d.asset AND n.metric_id = d.metric_id GROUP BY d.asset, d.metric_id HAVING max(CASE WHEN n.formula_hash = d.formula_hash THEN 1 ELSE 0 END) = 0) SELECT asset, array_to_string(list_sort(list(x)), ',') AS conflicts, 'sem-' || substr(sha256(asset || '|' || array_to_string(list_sort(list(x)), ',')), 1, 12) AS event_id FROM b GROUP BY asset")
def semantic_conflicts(spark, sf_dir):
    return K.semantic_conflicts(_divergences(spark, sf_dir)).withColumn("conflicts", F.array_join("conflicts", ","))


@query("SELECT asset FROM (SELECT 'a' || CAST(CAST(floor(c_custkey / 6) AS bigint) AS string) AS asset, max(CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END) AS missing FROM customer GROUP BY 1) AS x WHERE missing = 0")
def evaluated_assets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("'a' || floor(c_custkey / 6) asset", "'f' || c_custkey file", "c_custkey k")
    return K.evaluated_assets(c.select("asset", "file"), c.filter("k % 17 <> 0").select("file"))


_HEAD = "import pyspark.sql.functions as F\nRATE = 2\n"
#: Sources in eight shapes; {k} varies. State, raw formula, grain, line and whether it is the declared formula, or none.
_SOURCES = [
    (_HEAD + "def build(df):\n    return df.groupBy('k{k}').agg(F.sum(F.col('amount') * 2).alias('m'))\n", ("extraida", "F.sum(F.col('amount') * 2)", "k{k}", 4, True)),
    (_HEAD + "def build(df):\n    df = df.withColumn('net', F.col('amount') * RATE)\n    return df.groupBy('k{k}', 'day').agg(F.sum('net').alias('m'))\n", ("extraida", "F.sum('net')", "k{k},day", 5, True)),
    (_HEAD + "def build(df, flag):\n    if flag:\n        df = df.withColumn('net', F.col('amount') * {k})\n    else:\n        df = df.withColumn('net', F.col('amount'))\n    return df.groupBy('k').agg(F.sum('net').alias('m'))\n", ("ambigua", "F.sum('net')", "k", 8, False)),
    (_HEAD + "def build(df, keys):\n    return df.groupBy(*keys).agg(F.sum('amount').alias('m'))\n", ("nao_extraivel", "F.sum('amount')", "", 4, False)),
    (_HEAD + "def build(df, rate):\n    return df.agg(F.sum(F.col('amount') * rate).alias('m'))\n", ("parcial", "F.sum(F.col('amount') * rate)", "", 4, False)),
    ("def build(df:\n", ("nao_extraivel", "", "", 0, False)),
    (_HEAD + "def other(df):\n    return df.withColumn('net', F.col('amount') * 2)\n\ndef build(df):\n    return df.groupBy('k').where('net > {k}').agg(F.max('x'), F.sum('net').alias('m'))\n", ("extraida", "F.sum('net')", "k", 7, False)),
    (_HEAD + "def build(df):\n    RATE = 3\n    df = df.withColumn('a', F.col('amount')).withColumn('b', F.col('a') * RATE).withColumn('c', F.col('b'))\n    return df.groupBy('k{k}').agg(F.sum('c').alias('m'))\n", ("extraida", "F.sum('c')", "k{k}", 6, True)),
]


def _in_sql(text: str, key: str) -> str:
    """A text with its variable part as an SQL expression."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("{k}")]
    return f" || {key} || ".join(parts)


_KEY = "CAST(c_custkey % 9 AS string)"
_SHAPES = ", ".join(f"({i}, '{st}', {line}, {'true' if same else 'false'})" for i, (_, (st, _, _, line, same)) in enumerate(_SOURCES))


@query(f"""WITH s(i, extraction_status, line, as_declared) AS (VALUES {_SHAPES})
    SELECT 'src/' || CAST(c_custkey AS string) AS path, CASE WHEN i = 5 THEN '' ELSE 'm' END AS metric_id, CASE i {" ".join(f"WHEN {i} THEN {_in_sql(w[1], _KEY)}" for i, (_, w) in enumerate(_SOURCES))} END AS formula,
        CASE i {" ".join(f"WHEN {i} THEN {_in_sql(w[2], _KEY)}" for i, (_, w) in enumerate(_SOURCES))} END AS grain, line, extraction_status, as_declared FROM customer JOIN s ON i = c_custkey % 8""")
def observed_metrics(spark, sf_dir):
    key = F.expr("cast(c_custkey % 9 as string)")
    code = F.lit(None).cast("string")
    for i, (text, _) in enumerate(_SOURCES):
        parts = [x for p in text.split("{k}") for x in (F.lit(p), key)][:-1]
        code = F.when(F.col("c_custkey") % len(_SOURCES) == i, F.concat(*parts)).otherwise(code)
    out = K.observed_metrics(table(spark, sf_dir, "customer").select(F.concat(F.lit("src/"), F.col("c_custkey").cast("string")).alias("path"), code.alias("value")))
    same = F.coalesce(F.col("formula_hash") == declared_hash("F.sum(F.col('amount') * 2)"), F.lit(False))
    return out.select("path", "metric_id", "formula", "grain", "line", "extraction_status", same.alias("as_declared"))


# --- SLA


@query("""WITH a AS (SELECT DISTINCT user_id % 30 AS k FROM events), w AS (SELECT user_id % 30 AS k, ts FROM events), m AS (SELECT k, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-01-19 03:00:00' ELSE TIMESTAMP '2024-01-19 00:00:00' END AS midnight, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-01-19 10:30:00' ELSE TIMESTAMP '2024-01-19 07:30:00' END AS deadline FROM a),
    h AS (SELECT m.k, count(w.ts) > 0 AS delivered FROM m LEFT JOIN w ON w.k = m.k AND floor(epoch(w.ts)) >= epoch(midnight) AND floor(epoch(w.ts)) <= epoch(deadline) AND floor(epoch(w.ts)) <= epoch(TIMESTAMP '2024-01-19 09:00:00') GROUP BY m.k)
    SELECT 'a' || CAST(m.k AS string) AS asset, CAST(CASE WHEN delivered THEN deadline + INTERVAL '24' HOUR ELSE deadline END AS string) AS deadline, delivered, NOT delivered AND TIMESTAMP '2024-01-19 09:00:00' > deadline AS breached FROM m JOIN h ON h.k = m.k""")
def daily_deadlines(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id % 30 k", "ts")
    assets = e.selectExpr("'a' || k asset", "'07:30' clock", "case when k % 2 = 0 then 'America/Sao_Paulo' else 'UTC' end zone").distinct()
    out = K.daily_deadline(assets, e.selectExpr("'a' || k asset", "ts timestamp"), F.to_timestamp(F.lit("2024-01-19 09:00:00")))
    return out.withColumn("deadline", F.col("deadline").cast("string"))


@query(with_("runs") + " SELECT job_id, count(*) AS n, round(median(setup_s) + median(execution_s), 6) AS expected_s FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY end_time DESC, run_id DESC) AS k FROM runs WHERE result_state = 'SUCCESS') AS x WHERE k <= 20 GROUP BY job_id HAVING count(*) >= 5")
def expected_durations(spark, sf_dir):
    return K.expected_duration(fixture(spark, sf_dir, "runs")).withColumn("expected_s", F.round("expected_s", 6))


_SLA = """WITH p AS (SELECT 'p' || CAST(event_id AS string) AS prediction_id, 'a' || CAST(user_id % 60 AS string) AS asset, TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' SECOND * CAST(event_id % 5000 - 500 AS int) AS deadline, event_id % 5000 - 500 AS l, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 2000 AS double) END AS e FROM events WHERE event_type = 'view'),
    c AS (SELECT *, CASE WHEN l < 0 THEN 'violado' WHEN e IS NULL THEN 'sem_base' WHEN l - greatest(e - 100, 0) - 600 > 300 THEN 'no_prazo' WHEN l - greatest(e - 100, 0) - 600 > 0 THEN 'em_risco' ELSE 'inevitavel' END AS class FROM p), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY list_position(['violado', 'inevitavel', 'em_risco', 'no_prazo', 'sem_base'], class), CASE WHEN e IS NULL THEN 0 ELSE l - greatest(e - 100, 0) - 600 END, deadline, prediction_id) AS n FROM c) AS x WHERE n = 1)"""


def _predictions(spark, sf_dir):
    p = table(spark, sf_dir, "events").filter("event_type = 'view'").selectExpr("'p' || event_id prediction_id", "'a' || (user_id % 60) asset", "timestamp '2024-01-20 00:00:00' + interval '1' second * cast(event_id % 5000 - 500 as int) deadline", "case when event_id % 11 <> 0 then cast(event_id % 2000 as double) end e")
    given = (F.col("deadline"), F.to_timestamp(F.lit("2024-01-20 00:00:00")), F.col("e"), F.lit(100.0))
    return p.withColumns({"class": K.classify_slack(*given), "slack_s": K.slack_s(*given)})


@query(_SLA + " SELECT prediction_id, class FROM c")
def sla_classes(spark, sf_dir):
    return _predictions(spark, sf_dir).select("prediction_id", "class")


@query(_SLA + " SELECT asset, prediction_id, class FROM u")
def most_urgent(spark, sf_dir):
    return K.most_urgent(_predictions(spark, sf_dir)).select("asset", "prediction_id", "class")


@query(_SLA + " SELECT asset, CASE class WHEN 'inevitavel' THEN 'high' ELSE 'warning' END AS severity FROM u WHERE class IN ('inevitavel', 'em_risco')")
def sla_incidents(spark, sf_dir):
    return K.sla_incidents(_predictions(spark, sf_dir))


@query("""WITH p AS (SELECT event_id, 'a' || CAST(user_id AS string) AS asset, ts AS predicted, ts + INTERVAL '6' HOUR AS deadline FROM events WHERE event_type = 'click'), w AS (SELECT 'a' || CAST(user_id AS string) AS asset, ts FROM events WHERE event_type = 'view')
    SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.asset = p.asset AND w.ts > p.predicted AND w.ts <= p.deadline) THEN 'entregue_a_tempo' ELSE 'estourou' END AS outcome FROM p WHERE deadline < TIMESTAMP '2024-01-25 00:00:00'""")
def settled_predictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.filter("event_type = 'click'").selectExpr("event_id prediction_id", "'a' || user_id asset", "ts predicted_at", "ts + interval '6' hour deadline")
    return K.settle(p, e.filter("event_type = 'view'").selectExpr("'a' || user_id asset", "ts timestamp"), F.to_timestamp(F.lit("2024-01-25 00:00:00"))).withColumnRenamed("prediction_id", "event_id")


@query(with_("incidents") + " SELECT incident_id, CASE WHEN type = 'sla_risk' AND user_id % 25 % 2 = 0 AND state IN ('detected', 'triaged') THEN 'closed' ELSE state END AS state FROM incidents")
def superseded_incidents(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    return K.supersede(i, i.filter("user_id % 25 % 2 = 0").select("subject")).select("incident_id", "state")


# --- states, decisions, deadlines


_RR = with_("rule_results")


@query(_RR + """, e AS (SELECT DISTINCT asset AS subject, unnest(['contract_violation', 'quality_engine_failure']) AS type FROM rule_results),
    v AS (SELECT DISTINCT asset AS subject, CASE status WHEN 'violated' THEN 'contract_violation' ELSE 'quality_engine_failure' END AS type FROM rule_results WHERE status <> 'passed' AND numerator > 40)
    SELECT e.subject, e.type, v.subject IS NOT NULL AS violating FROM e LEFT JOIN v ON v.subject = e.subject AND v.type = e.type""")
def quality_states(spark, sf_dir):
    r = fixture(spark, sf_dir, "rule_results")
    evaluated, _ = I.quality_state(r)
    _, violating = I.quality_state(r.filter("numerator > 40"))
    return evaluated.join(violating.withColumn("violating", F.lit(True)), ["subject", "type"], "left").withColumn("violating", F.coalesce("violating", F.lit(False)))


_VERDICTS = with_("runs") + """, j AS (SELECT job_id, end_time, run_id, result_state, CASE WHEN CAST(run_id AS bigint) % 4 = 0 THEN 'insufficient_baseline' WHEN CAST(run_id AS bigint) % 4 = 1 THEN 'regression' ELSE 'healthy' END AS verdict FROM runs),
    l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY end_time DESC, run_id DESC) AS n FROM j WHERE verdict <> 'insufficient_baseline')"""


@query(_VERDICTS + " SELECT job_id AS subject, 'runtime_regression' AS type, result_state = 'SUCCESS' AS evaluated, verdict = 'regression' AS violating FROM l WHERE n = 1 AND (result_state = 'SUCCESS' OR verdict = 'regression')")
def runtime_states(spark, sf_dir):
    verdict = "case when cast(run_id as bigint) % 4 = 0 then 'insufficient_baseline' when cast(run_id as bigint) % 4 = 1 then 'regression' else 'healthy' end"
    evaluated, violating = I.runtime_state(fixture(spark, sf_dir, "runs").selectExpr("job_id", "end_time", "run_id", "result_state", f"{verdict} verdict"))
    both = evaluated.withColumn("evaluated", F.lit(True)).join(violating.withColumn("violating", F.lit(True)), ["subject", "type"], "full")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("evaluated", "violating")})


@query(_SLA + " SELECT DISTINCT asset AS subject, 'sla_risk' AS type, max(class <> 'no_prazo') OVER (PARTITION BY asset) AS violating FROM c WHERE class IN ('no_prazo', 'em_risco', 'inevitavel')")
def sla_states(spark, sf_dir):
    evaluated, violating = I.sla_state(_predictions(spark, sf_dir))
    return evaluated.join(violating.withColumn("violating", F.lit(True)), ["subject", "type"], "left").withColumn("violating", F.coalesce("violating", F.lit(False)))


_CAUSED = "CASE WHEN user_id % 3 = 0 THEN 'skew' ELSE 'growth' END"


@query(with_("incidents") + f""", d AS (SELECT type, subject, {_CAUSED} AS cause, detected_at, 'u' || CAST(user_id % 4 AS string) AS actor FROM incidents WHERE event_id % 3 = 0)
    SELECT 'prb-' || substr(sha256(type || '|' || subject || '|' || cause), 1, 12) AS problem_id, type, subject, cause, arg_min(actor, (detected_at, actor)) AS promoted_by FROM d GROUP BY type, subject, cause""")
def promoted_problems(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents").withColumn("cause", F.expr(_CAUSED.lower()))
    d = i.filter("event_id % 3 = 0").selectExpr("incident_id", "detected_at at", "'u' || user_id % 4 actor")
    return I.promote_problem(d, i).drop("promoted_at")


@query("SELECT 'p' || CAST(c_custkey AS string) AS problem_id, CASE WHEN c_custkey % 3 <> 2 THEN 'fix ' || CAST(c_custkey % 5 + 10 * (1 - c_custkey % 3) AS string) END AS fix_text FROM customer")
def registered_fixes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("'p' || c_custkey problem_id", "c_custkey k")
    d = c.filter("k % 3 <> 2").selectExpr("problem_id", "timestamp '2024-01-01 00:00:00' at", "'fix ' || (k % 5) fix_text")
    later = c.filter("k % 3 = 0").selectExpr("problem_id", "timestamp '2024-01-02 00:00:00' at", "'fix ' || (k % 5 + 10) fix_text")
    empty = c.selectExpr("problem_id", "timestamp '2024-01-03 00:00:00' at", "' ' fix_text")
    return I.register_fix(c.select("problem_id"), d.unionByName(later).unionByName(empty)).select("problem_id", "fix_text")


@query("SELECT job_id, CAST(max(start_time) AS string) AS mark_at FROM (" + with_("runs") + " SELECT * FROM runs WHERE CAST(run_id AS bigint) % 97 = 3) AS x GROUP BY job_id")
def accepted_regimes(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs")
    i = runs.selectExpr("'inc-' || run_id incident_id", "run_id first_event", "cast(run_id as bigint) k")
    out = I.accept_regime(i.filter("k % 97 = 3").select("incident_id"), i, runs)
    return out.withColumn("mark_at", F.col("mark_at").cast("string"))


@query(with_("incidents") + """ SELECT incident_id, 'rb1' AS runbook_id, event_id % 2 = 0 AS used FROM incidents WHERE event_id % 5 < 2""")
def followed_runbooks(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    d = i.filter("event_id % 5 < 2").selectExpr("incident_id", "'rb1' runbook_id", "detected_at at", "'u' actor")
    uses, refused = I.follow_runbook(d.unionByName(d), i.filter("event_id % 2 = 0").selectExpr("incident_id", "'rb1' runbook_id"))
    return uses.selectExpr("incident_id", "runbook_id", "true used").unionByName(refused.distinct().selectExpr("incident_id", "runbook_id", "false used"))


@query("SELECT event_id, CAST(ts + INTERVAL '1' SECOND * CASE event_id % 4 WHEN 0 THEN 90 WHEN 1 THEN 1800 WHEN 2 THEN 86400 ELSE 604800 END AS string) AS deadline FROM events".replace("ts +", "date_trunc('second', ts) +"))
def window_deadlines(spark, sf_dir):
    fresh = F.expr("case event_id % 4 when 0 then '90s' when 1 then '30m' when 2 then '24h' else '7d' end")
    return table(spark, sf_dir, "events").select("event_id", K.window_deadline(F.date_trunc("second", "ts"), fresh).cast("string").alias("deadline"))


@query(_H + """ , t AS (SELECT incident_id, rank, code || ': f1-' || code || ' [e1]; f2-' || code || ' [e2]' AS s FROM k WHERE rank <= 2)
    SELECT incident_id, string_agg(s, chr(10) ORDER BY rank) AS narrative FROM t GROUP BY 1""")
def cited_narratives(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    facts = ranked.select("incident_id", "code", F.explode(F.array(*[F.lit(x) for x in ("3", "1", "2")])).alias("x")).selectExpr("incident_id", "code", "'e' || x evidence_id", "'f' || x || '-' || code fact")
    out = I.narrative_fallback(ranked, 2, facts)
    return out.withColumn("narrative", F.regexp_replace("narrative", r"(?m)^[0-9]+\. (\S+) \([0-9.]+\)", "$1"))
