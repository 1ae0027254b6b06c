"""Queries of the console's read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import governance as G
from opsloom.operators import incidents as I
from opsloom.operators import views as V
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query

# the incidents of a page: the 200 newest ones
_PAGE = ", page AS (SELECT incident_id FROM incidents ORDER BY detected_at DESC, incident_id LIMIT 200)"


def _page(spark, sf_dir):
    return G.last_incidents(fixture(spark, sf_dir, "incidents"), 200).select("incident_id")


@query(with_("incidents") + _PAGE + """, e AS (SELECT incident_id, 'detected' AS kind, 0 AS o, 'tl-' || substr(sha256(incident_id || '|detected|' || CAST(date_trunc('second', detected_at) AS string)), 1, 12) AS entry_id, date_trunc('second', detected_at) AS at_ FROM incidents
    UNION ALL SELECT incident_id, 'updated', 1, 'tl-' || substr(sha256(incident_id || '|updated|' || CAST(date_trunc('second', updated_at) AS string)), 1, 12), date_trunc('second', updated_at) FROM incidents)
    SELECT incident_id, kind, entry_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY at_, kind, entry_id) AS int) AS nth FROM e WHERE incident_id IN (SELECT incident_id FROM page)""")
def view_timeline(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    at = lambda c: F.date_trunc("second", F.col(c).cast("timestamp"))
    entries = I.timeline(i, "detected", at("detected_at"), F.col("severity")).unionByName(I.timeline(i, "updated", at("updated_at"), F.col("state")))
    return V.timeline(entries, _page(spark, sf_dir)).select("incident_id", "kind", "entry_id", "nth")


@query(with_("incidents", "hypotheses") + _PAGE + """, k AS (SELECT incident_id, hypothesis_id, code, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY least(confidence, CASE WHEN code = 'change_temporal_only' THEN 0.5 ELSE 0.9 END) DESC, code) AS int) AS rank FROM hypotheses)
    SELECT k.incident_id, hypothesis_id, code, rank, CASE WHEN right(k.incident_id, 1) IN ('2', '4') THEN 1 ELSE 0 END AS evidence FROM k JOIN page ON page.incident_id = k.incident_id""")
def view_hypotheses(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    evidence = I.evidence(i.filter("event_id % 10 in (2, 4)"), "metric", F.col("subject"), F.col("event_id"), "runs")
    return V.hypotheses(I.rank_hypotheses(fixture(spark, sf_dir, "hypotheses")), evidence, _page(spark, sf_dir)).select("incident_id", "hypothesis_id", "code", "rank", "evidence")


@query(with_("incidents") + _PAGE + " SELECT incident_id, CASE WHEN CAST(substr(incident_id, 5) AS bigint) % 3 = 0 THEN 'second' ELSE 'first' END AS text FROM page WHERE CAST(substr(incident_id, 5) AS bigint) % 4 <> 1")
def view_narratives(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents").filter("event_id % 4 <> 1")
    told = i.selectExpr("incident_id", "'n1' narrative_id", "detected_at narrated_at", "'first' text").unionByName(i.filter("event_id % 3 = 0").selectExpr("incident_id", "'n2' narrative_id", "detected_at + interval '1' hour narrated_at", "'second' text"))
    return V.narratives(told, _page(spark, sf_dir)).select("incident_id", "text")


@query(with_("incidents") + """ SELECT 'tk-' || substr(sha256(incident_id), 1, 12) AS outbox_id, event_id % 3 AS tries, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'sent' END AS status FROM incidents""")
def view_communications(spark, sf_dir):
    i = fixture(spark, sf_dir, "incidents")
    outbox = G.ticket_outbox(i)
    tries = outbox.select("outbox_id", "incident_id").join(i.select("incident_id", "event_id", "detected_at"), "incident_id")
    one = tries.filter("event_id % 3 > 0").selectExpr("outbox_id", "detected_at at", "'failed' status")
    two = tries.filter("event_id % 3 = 2").selectExpr("outbox_id", "detected_at + interval '1' minute at", "'sent' status")
    return V.communications(outbox, one.unionByName(two)).select("outbox_id", F.col("tries").cast("bigint").alias("tries"), "status")


@query(with_("changes") + " SELECT sha, author, CASE WHEN n % 6 = 0 THEN 'block' ELSE 'allow' END AS decision, CASE WHEN n % 6 = 0 THEN 'secret' END AS reason, n % 12 = 0 AS overridden FROM (SELECT *, CAST(substr(sha, 2) AS bigint) AS n FROM changes) AS c")
def view_gates(spark, sf_dir):
    c = fixture(spark, sf_dir, "changes").withColumn("n", F.expr("cast(substr(sha, 2) as bigint)"))
    none = c.limit(0).selectExpr("sha", "'alta' severity")
    d = G.gate_decisions(c.selectExpr("sha", "'baixo' band"), c.filter("n % 6 = 0").selectExpr("sha", "'alta' severity"), none)
    o = c.filter("n % 12 = 0").selectExpr("sha", "'approved' status", "timestamp '2024-02-01 00:00:00' expires_at")
    effective = G.effective_gate(d, o, F.to_timestamp(F.lit("2024-01-31 00:00:00")))
    return V.gates(d, effective, c.select("sha", "author")).select("sha", "author", "decision", "reason", "overridden")


@query("""WITH d AS (SELECT 'lib-' || CAST(p_size AS string) AS package, p_partkey, p_size, CAST(p_partkey % 4 AS string) || '.' || CAST(p_partkey % 13 AS string) || '.0' AS version, p_partkey % 4 < 2 OR p_partkey % 4 = 2 AND p_partkey % 13 < 5 AS old FROM part)
    SELECT package, count(DISTINCT p_partkey) AS files, count(DISTINCT version) AS versions, count(CASE WHEN old AND p_size <= 10 THEN 1 END) AS findings, CASE WHEN count(CASE WHEN old AND p_size <= 10 THEN 1 END) > 0 THEN CASE WHEN max(p_size) % 2 = 0 THEN 'alta' ELSE 'média' END END AS severity FROM d GROUP BY package""")
def view_dependencies(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.expr("'f' || p_partkey").alias("file"), F.expr("'Lib_' || p_size || '>=' || (p_partkey % 4) || '.' || (p_partkey % 13) || '.0\n'").alias("text"))
    deps = G.dependencies(m)
    advisories = spark.range(1, 11).selectExpr("'lib-' || id package", "'2.5' fixed_in", "case when id % 2 = 0 then 'alta' else 'média' end severity", "'cve' cve")
    return V.dependencies(deps, G.dependency_findings(deps, advisories))


@query("""WITH l AS (SELECT date_trunc('month', l_shipdate) AS period, CASE l_linenumber % 3 WHEN 0 THEN 'dominio' WHEN 1 THEN 'plataforma' ELSE 'nao_alocado' END AS category, CAST(l_quantity AS bigint) AS cost FROM lineitem), p AS (SELECT period, category, sum(cost) AS cost FROM l GROUP BY 1, 2)
    SELECT CAST(CAST(period AS timestamp) AS string) AS period, category, CAST(cost AS bigint) AS cost, round(CAST(cost / sum(cost) OVER (PARTITION BY period) AS double), 8) AS share FROM p""")
def view_costs_per_period(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_shipdate", "case l_linenumber % 3 when 0 then 'dominio' when 1 then 'plataforma' else 'nao_alocado' end category", "cast(l_quantity as decimal(38,10)) cost")
    return V.costs_per_period(rows, "l_shipdate").select(F.col("period").cast("string").alias("period"), "category", F.col("cost").cast("bigint").alias("cost"), F.round("share", 8).alias("share"))
