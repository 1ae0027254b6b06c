"""Queries of change risk, supply chain, gates, notifications, audit, executive figures and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.columns import version_key
from opsloom.operators import governance as G
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query



def now():
    """The fixed instant of these queries."""
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _changes(spark, sf_dir):
    return fixture(spark, sf_dir, "changes")


_PATH = "CASE p_partkey % 5 WHEN 0 THEN 'part.' || CAST(p_partkey AS string) || '.py' WHEN 1 THEN 'src/part.' || CAST(p_partkey AS string) || '.py' WHEN 2 THEN 'old/deep/part.' || CAST(p_partkey AS string) || '.py' WHEN 3 THEN CAST(p_partkey AS string) || '.py' ELSE 'src/part.' || CAST(p_partkey AS string) || '.sql' END"


def _sources(spark, sf_dir):
    """(path, asset) of every part: paths of the whole file, of its end, of its name elsewhere, of the end of its name, and others."""
    return table(spark, sf_dir, "part").selectExpr(f"{_PATH} path", "'part.' || p_partkey asset")


# a file stands for a path that it ends with, or that has the same last part
_CA = with_("changes") + f""", assets AS (SELECT {_PATH} AS path, 'part.' || CAST(p_partkey AS string) AS asset FROM part), fs AS (SELECT DISTINCT file FROM changes),
    fa AS (SELECT DISTINCT file, asset FROM fs JOIN assets ON suffix(file, path) OR regexp_replace(file, '.*/', '') = regexp_replace(path, '.*/', '')), ca AS (SELECT DISTINCT sha, asset FROM changes JOIN fa ON fa.file = changes.file)"""


@query(_CA + " SELECT sha, asset FROM ca")
def assets_for_change(spark, sf_dir):
    return G.assets_for_change(_changes(spark, sf_dir), _sources(spark, sf_dir))


@query(_CA + ", r AS (SELECT asset, max(CASE WHEN CAST(regexp_extract(asset, '[0-9]+') AS int) % 5 = 0 THEN 1 ELSE 0 END) AS dash, sum(CAST(regexp_extract(asset, '[0-9]+') AS int) % 7) / 2.0 AS s FROM assets GROUP BY 1), b AS (SELECT sha, max(dash) AS dash, max(s) AS s FROM ca LEFT JOIN r ON r.asset = ca.asset GROUP BY 1) SELECT sha, round(CAST(CASE WHEN dash = 1 THEN 1 ELSE least(1, s / 3) END AS double), 8) AS blast FROM b")
def blast_scores(spark, sf_dir):
    a = _sources(spark, sf_dir).withColumn("n", F.regexp_extract("asset", "[0-9]+", 0).cast("int"))
    reached = a.selectExpr("asset origin", "case when n % 5 = 0 then 'dashboard' else 'job' end entity_type", "n % 7 / 2.0d score")
    return G.blast_score(G.assets_for_change(_changes(spark, sf_dir), _sources(spark, sf_dir)), reached).withColumn("blast", F.round("blast", 8))


_HIST = ", inc AS (SELECT 'i' || CAST(c_custkey AS string) AS incident_id, 'part.' || CAST(c_custkey % 200 AS string) AS asset, TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 1000 AS int) AS detected_at FROM customer)"


def _history(spark, sf_dir):
    inc = table(spark, sf_dir, "customer").selectExpr("'i' || c_custkey incident_id", "'part.' || (c_custkey % 200) asset", "timestamp '1995-01-01 00:00:00' + interval '1' day * cast(c_custkey % 1000 as int) detected_at")
    c = _changes(spark, sf_dir)
    return G.history_score(G.assets_for_change(c, _sources(spark, sf_dir)), c, inc)


@query(_CA + _HIST + """, aft AS (SELECT DISTINCT i.asset, incident_id FROM inc i JOIN ca ON ca.asset = i.asset JOIN changes c ON c.sha = ca.sha AND detected_at >= committed_at AND detected_at <= committed_at + INTERVAL '14' DAY), n AS (SELECT sha, count(DISTINCT incident_id) AS n FROM ca JOIN aft ON aft.asset = ca.asset GROUP BY 1)
    SELECT c.sha, round(CAST(least(1, coalesce(n, 0) / 3) AS double), 8) AS history FROM changes c LEFT JOIN n ON n.sha = c.sha""")
def history_scores(spark, sf_dir):
    return _history(spark, sf_dir).withColumn("history", F.round("history", 8))


_SP = with_("changes") + ", s AS (SELECT sha, CAST(least(1, 0.5 * n_files / 10 + 0.5 * 2 / 400) AS double) AS size, CAST(CASE WHEN author LIKE '%[bot]%' OR message LIKE '%a-bot%' THEN 1 ELSE 0 END AS double) AS provenance, CAST(CAST(substr(sha, 2) AS bigint) % 11 AS double) / 10 AS blast, CAST(CAST(substr(sha, 2) AS bigint) % 4 AS double) / 3 AS history, CAST(substr(sha, 2) AS bigint) % 70 = 0 AS high FROM changes), r AS (SELECT *, round(0.4 * blast + 0.3 * history + 0.2 * size + 0.1 * provenance, 4) AS score FROM s), k AS (SELECT *, CASE WHEN high OR score >= 0.66 THEN 'alto' WHEN score >= 0.34 THEN 'medio' ELSE 'baixo' END AS band FROM r)"


def _risks(spark, sf_dir):
    c = _changes(spark, sf_dir).withColumn("n", F.expr("cast(substr(sha, 2) as bigint)"))
    s = c.select("sha", "n", G.size_score(F.col("n_files"), F.col("patch")).alias("size"), G.provenance_score(F.col("author"), F.col("message")).alias("provenance"), F.expr("cast(n % 11 as double) / 10").alias("blast"), F.expr("cast(n % 4 as double) / 3").alias("history"), F.expr("n % 70 = 0").alias("high_finding"))
    return G.change_risk(s)


@query(_SP + " SELECT sha, round(size, 8) AS size, provenance, score, band FROM k")
def change_risks(spark, sf_dir):
    return _risks(spark, sf_dir).select("sha", F.round("size", 8).alias("size"), "provenance", "score", "band")


_DEP = "WITH d AS (SELECT 'f' || CAST(p_partkey AS string) AS file, 'lib-' || CAST(p_size AS string) AS package, CAST(p_partkey % 4 AS string) || '.' || CAST(p_partkey % 13 AS string) || '.0' AS version, p_partkey % 4 AS a, p_partkey % 13 AS b, p_size FROM part)"


def _deps(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.expr("'f' || p_partkey").alias("file"), F.expr("'# c\nLib_' || p_size || '>=' || (p_partkey % 4) || '.' || (p_partkey % 13) || '.0\nplain\n'").alias("text"))
    return G.dependencies(m)


@query(_DEP + " SELECT file, package, version FROM d")
def dependencies(spark, sf_dir):
    return _deps(spark, sf_dir)


@query(_DEP + " SELECT file, package, version, CASE WHEN p_size % 2 = 0 THEN 'alta' ELSE 'media' END AS severity FROM d WHERE p_size <= 10 AND (a < 2 OR a = 2 AND b < 5)")
def dependency_findings(spark, sf_dir):
    adv = spark.range(1, 11).selectExpr("'LIB-' || id package", "'2.5' fixed_in", "case when id % 2 = 0 then 'alta' else 'media' end severity", "'cve' cve")
    return G.dependency_findings(_deps(spark, sf_dir), adv).select("file", "package", "version", "severity")


@query("SELECT p_partkey, p_size % 3 * 100 + p_partkey % 5 < 102 AS older FROM part")
def version_order(spark, sf_dir):
    v = F.expr("(p_size % 3) || '.' || (p_partkey % 5) || '.0'")
    return table(spark, sf_dir, "part").select("p_partkey", (version_key(v) < version_key(F.lit("1.2"))).alias("older"))


# texts with a secret of each kind, and near misses: one character less, another case, an unquoted or a short value
_LEAK = """CASE doc_id % 9 WHEN 0 THEN ' key AKIA' || upper(substr(md5(CAST(doc_id AS string)), 1, 16)) WHEN 1 THEN ' key AKIA' || upper(substr(md5(CAST(doc_id AS string)), 1, 15)) || 'x' WHEN 2 THEN ' dapi' || md5(CAST(doc_id AS string)) WHEN 3 THEN ' dapi' || upper(md5(CAST(doc_id AS string)))
    WHEN 4 THEN ' -----BEGIN RSA PRIVATE KEY-----' WHEN 5 THEN ' -----BEGIN RSA PUBLIC KEY-----' WHEN 6 THEN ' Api_Key = "two words ' || CAST(doc_id AS string) || '"' WHEN 7 THEN ' password: "short"' ELSE ' token: unquoted' || CAST(doc_id AS string) END"""
_LEAKS = f"WITH t AS (SELECT doc_id, text || {_LEAK} AS text FROM documents)"


@query(_LEAKS + r""" SELECT doc_id, pattern, severity, masked, count(*) AS n FROM (
    SELECT doc_id, 'aws_access_key' AS pattern, 'alta' AS severity, substr(unnest(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')), 1, 4) || '***' AS masked FROM t
    UNION ALL SELECT doc_id, 'private_key', 'alta', substr(unnest(regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')), 1, 4) || '***' FROM t
    UNION ALL SELECT doc_id, 'databricks_token', 'alta', substr(unnest(regexp_extract_all(text, 'dapi[0-9a-f]{32}')), 1, 4) || '***' FROM t
    UNION ALL SELECT doc_id, 'generic_secret', 'média', substr(unnest(regexp_extract_all(text, '(?i)(?:api[_-]?key|token|secret|password)\s*[:=]\s*[\x22\x27][^\x22\x27]{8,}[\x22\x27]')), 1, 4) || '***' FROM t) AS x GROUP BY ALL""")
def secret_findings(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").selectExpr("doc_id", f"text || {_LEAK} text")
    f = G.secret_findings(texts, "doc_id").filter("pattern <> 'entropy'")
    return f.groupBy("doc_id", "pattern", "severity", "masked").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}'))) AS tok FROM documents), c AS (SELECT doc_id, tok, unnest(string_split(tok, '')) AS ch FROM t),
    k AS (SELECT doc_id, tok, ch, count(*) / length(tok) AS p FROM c GROUP BY 1, 2, 3), e AS (SELECT doc_id, tok FROM k GROUP BY 1, 2 HAVING -sum(p * log2(p)) >= 3.2)
    SELECT doc_id, substr(tok, 1, 4) || '***' AS masked, count(*) AS n FROM e GROUP BY 1, 2""")
def secret_entropy(spark, sf_dir):
    f = G.secret_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", least_bits=3.2).filter("pattern = 'entropy'")
    return f.groupBy("doc_id", "masked").agg(F.count(F.lit(1)).alias("n"))


_GATE = _SP + ", g AS (SELECT sha, CASE WHEN CAST(substr(sha, 2) AS bigint) % 90 = 0 THEN 'secret' WHEN CAST(substr(sha, 2) AS bigint) % 110 = 0 THEN 'dependency' WHEN band = 'alto' THEN 'risk' END AS reason FROM k)"


def _gates(spark, sf_dir):
    r = _risks(spark, sf_dir)
    return G.gate_decisions(r, r.filter("n % 90 = 0").selectExpr("sha", "'alta' severity").unionByName(r.selectExpr("sha", "'media' severity")), r.filter("n % 110 = 0").selectExpr("sha", "'alta' severity"))


@query(_GATE + " SELECT sha, CASE WHEN reason IS NULL THEN 'allow' ELSE 'block' END AS decision, reason FROM g")
def gate_decisions(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(_GATE + " SELECT sha, CASE WHEN reason IS NULL OR CAST(substr(sha, 2) AS bigint) % 60 = 0 THEN 'allow' ELSE 'block' END AS decision FROM g")
def effective_gates(spark, sf_dir):
    o = _changes(spark, sf_dir).selectExpr("sha", "case when cast(substr(sha, 2) as bigint) % 60 = 0 then 'approved' else 'pending' end status", "timestamp '2024-02-01 00:00:00' expires_at")
    return G.effective_gate(_gates(spark, sf_dir), o, now())


@query(_SP + ", r2 AS (SELECT run_id, git_sha FROM (SELECT 'run' || sha AS run_id, sha AS git_sha FROM changes) AS q) SELECT run_id, band FROM r2 JOIN k ON k.sha = r2.git_sha")
def change_risk_by_run(spark, sf_dir):
    r = _risks(spark, sf_dir)
    return r.selectExpr("'run' || sha run_id", "sha git_sha").join(r.select(F.col("sha").alias("git_sha"), "band"), "git_sha").select("run_id", "band")


_INC = with_("incidents") + ", esc AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'info' END AS escalated_from FROM incidents)"


def _inc(spark, sf_dir):
    return fixture(spark, sf_dir, "incidents").withColumn("escalated_from", F.expr("case when event_id % 9 = 0 then 'info' end"))


_EVENTS = _INC + f", ev AS (SELECT incident_id, severity, 'aberto' AS event FROM esc WHERE detected_at > {_NOW} - INTERVAL '48' HOUR UNION ALL SELECT incident_id, severity, 'escalou' FROM esc WHERE updated_at > {_NOW} - INTERVAL '48' HOUR AND escalated_from IS NOT NULL UNION ALL SELECT incident_id, severity, 'recuperado' FROM esc WHERE updated_at > {_NOW} - INTERVAL '48' HOUR AND state = 'recovered')"


@query(_EVENTS + " SELECT incident_id, severity, event, 'nt-' || substr(sha256(incident_id || '|' || event), 1, 12) AS dedup_key FROM ev")
def material_events(spark, sf_dir):
    return G.material_events(_inc(spark, sf_dir), now(), 48)


@query("""WITH e AS (SELECT event_id, date_trunc('second', ts) AS t, date_trunc('second', ts) - INTERVAL '3' HOUR AS l, CASE WHEN event_id % 4 = 0 THEN 'critical' ELSE 'high' END AS s FROM events)
    SELECT event_id, CAST(CASE WHEN s = 'critical' THEN t WHEN hour(l) >= 22 THEN date_trunc('day', l) + INTERVAL '34' HOUR WHEN hour(l) < 7 THEN date_trunc('day', l) + INTERVAL '10' HOUR ELSE t END AS string) AS send_at FROM e""")
def quiet_hours(spark, sf_dir):
    s = F.expr("case when event_id % 4 = 0 then 'critical' else 'high' end")
    return table(spark, sf_dir, "events").select("event_id", G.send_after(F.date_trunc("second", F.col("ts").cast("timestamp")), s, "America/Sao_Paulo").cast("string").alias("send_at"))


@query(_EVENTS + " SELECT incident_id, event, 'e3,e2' AS evidence FROM ev WHERE severity IN ('high', 'critical', 'blocking')")
def notification_outbox(spark, sf_dir):
    i = _inc(spark, sf_dir)
    e = i.selectExpr("incident_id", "explode(array(1, 2, 3)) k").selectExpr("incident_id", "k at", "'e' || k evidence_id")
    return G.notification_outbox(G.material_events(i, now(), 48), e)


@query(with_("incidents") + """ SELECT 'tk-' || substr(sha256(incident_id), 1, 12) AS outbox_id, incident_id, '{"incident_id":"' || incident_id || '","type":"' || type || '","severity":"' || severity || '","subject":"' || subject || '"}' AS body FROM incidents""")
def ticket_outbox(spark, sf_dir):
    return G.ticket_outbox(fixture(spark, sf_dir, "incidents"))


@query("SELECT 2 * count(*) AS rows, count(CASE WHEN o_orderkey % 1000 = 7 THEN 1 END) AS bad_hashes, count(CASE WHEN o_orderkey % 777 = 5 THEN 1 END) AS orphans, CAST(0 AS bigint) AS forks, min(CASE WHEN o_orderkey % 1000 = 7 OR o_orderkey % 777 = 5 THEN o_orderkey + 1000000 END) AS first_bad FROM orders")
def audit_chain(spark, sf_dir):
    """Two-row chains: a genesis row an order and a row on top of it; some hashes are wrong, some parents unknown."""
    o = table(spark, sf_dir, "orders")
    first = o.selectExpr("o_orderkey seq", "'u' || (o_custkey % 9) actor", "'ack' action", "'t' target", "cast(null as string) prev_hash", "o_orderkey k")
    body = F.to_json(F.struct("seq", "actor", "action", "target"))
    first = first.withColumn("hash", F.sha2(body.cast("binary"), 256))
    second = first.select((F.col("seq") + 1000000).alias("seq"), "actor", "action", "target", F.when(F.col("k") % 777 == 5, F.concat(F.lit("lost"), F.col("k").cast("string"))).otherwise(F.col("hash")).alias("prev_hash"), "k")
    second = second.withColumn("hash", F.when(F.col("k") % 1000 == 7, F.concat(F.lit("wrong"), F.col("k").cast("string"))).otherwise(F.sha2(F.concat(body, "prev_hash").cast("binary"), 256)))
    return G.verify_audit_chain(first.drop("k").unionByName(second.drop("k")))


@query(with_("incidents") + f""", i AS (SELECT *, (floor(epoch(updated_at)) - floor(epoch(detected_at))) / 3600 AS h, (floor(epoch(acknowledged_at)) - floor(epoch(detected_at))) / 3600 AS a, state IN ('detected', 'triaged') AS act, state = 'recovered' AND updated_at >= {_NOW} - INTERVAL '7' DAY AS rec, acknowledged_at IS NOT NULL AND detected_at >= {_NOW} - INTERVAL '7' DAY AS ack FROM incidents),
    r AS (SELECT list_sort(list(h)) AS s, count(*) AS n FROM i WHERE rec), q AS (SELECT n, s, CAST(greatest(least(floor(0.9 * (n + 1)), n - 1), 1) AS int) AS lo FROM r),
    m AS (SELECT 'active' AS metric, count(CASE WHEN act THEN 1 END) AS value, count(*) AS n, true AS sure, 'incidents' AS unit, 'now' AS w FROM i UNION ALL SELECT 'critical', count(CASE WHEN severity IN ('critical', 'blocking') THEN 1 END), count(*), true, 'incidents', 'now' FROM i WHERE act
    UNION ALL SELECT 'mttr_median_h', median(h), count(*), false, 'hours', '7 d' FROM i WHERE rec UNION ALL SELECT 'mttr_p90_h', s[lo] + (0.9 * (n + 1) - lo) * (s[lo + 1] - s[lo]), n, false, 'hours', '7 d' FROM q
    UNION ALL SELECT 'administrative_closures', count(*), count(*), true, 'incidents', '7 d' FROM i WHERE state = 'closed' AND updated_at >= {_NOW} - INTERVAL '7' DAY UNION ALL SELECT 'mtta_median_h', median(a), count(*), false, 'hours', '7 d' FROM i WHERE ack
    UNION ALL SELECT 'ack_pending', count(CASE WHEN acknowledged_at IS NULL THEN 1 END), count(*), true, 'incidents', 'now' FROM i WHERE act UNION ALL SELECT 'sla_risk_incidents', count(CASE WHEN type = 'sla_risk' THEN 1 END), count(*), true, 'incidents', 'now' FROM i WHERE act UNION ALL SELECT 'impacted_assets', count(DISTINCT asset), count(asset), false, 'assets', 'now' FROM i WHERE act)
    SELECT metric, round(CAST(value AS double), 6) AS value, n, CASE WHEN sure THEN 'alta' WHEN n = 0 THEN 'sem_dados' WHEN n < 5 THEN 'baixa' ELSE 'alta' END AS confidence, unit, w AS looked_back, true AS explained FROM m""")
def executive_summary(spark, sf_dir):
    out = G.executive_summary(fixture(spark, sf_dir, "incidents"), now())
    told = (F.length("source") > 0) & (F.length("formula") > 0)
    return out.select("metric", F.round("value", 6).alias("value"), "n", "confidence", "unit", F.col("window").alias("looked_back"), told.alias("explained"))


@query("SELECT c_custkey, round(CAST(CASE WHEN c_custkey % 7 = 0 THEN least(50 * a + 50 * b, 60) ELSE 50 * a + 50 * b END AS double), 4) AS score FROM (SELECT c_custkey, c_custkey % 11 / 10 AS a, c_custkey % 6 / 5 AS b FROM customer) AS x")
def health_scores(spark, sf_dir):
    m = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 11 / 10 a", "c_custkey % 6 / 5 b", "case when c_custkey % 7 = 0 then 1 else 0 end critical")
    return G.health_score(m, {"a": 50.0, "b": 50.0}).select("c_custkey", "score")


@query("SELECT 's' || CAST(user_id % 5 AS string) AS service, CAST(date_trunc('hour', ts) AS string) AS start, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS bad, round(count(CASE WHEN event_type = 'error' THEN 1 END) / count(*) / 0.05, 6) AS burn FROM events GROUP BY 1, 2")
def burn_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("'s' || (user_id % 5) service", "ts", "event_type = 'error' bad")
    return G.burn_rate(e, "1 hour", 0.95).withColumns({"start": F.col("start").cast("string"), "burn": F.round("burn", 6)})


@query("""WITH c AS (SELECT event_id, event_type AS model, 10 + event_id % 90 AS i, 5 + event_id % 40 AS o, event_id % 8 <> 0 AS ok, event_id % 3 AS retry, floor(value) AS cost FROM events)
    SELECT model, count(*) AS requests, round(avg(i + o), 6) AS tokens_per_request, round(sum(i + o) / count(CASE WHEN ok THEN 1 END), 6) AS tokens_per_success, CAST(sum(CASE WHEN retry > 0 THEN i + o ELSE 0 END) AS bigint) AS retry_tokens, CAST(sum(CASE WHEN NOT ok THEN cost ELSE 0 END) AS double) AS failed_cost, round(sum(i) / sum(o), 6) AS input_output_ratio FROM c GROUP BY 1""")
def token_usage(spark, sf_dir):
    c = table(spark, sf_dir, "events").selectExpr("event_id invocation_id", "event_type model", "10 + event_id % 90 input_tokens", "5 + event_id % 40 output_tokens", "event_id % 8 <> 0 ok", "event_id % 3 retry", "cast(floor(value) as double) cost")
    out = G.token_usage(c.unionByName(c.filter("invocation_id % 4 = 0")))
    return out.withColumns({k: F.round(k, 6) for k in ("tokens_per_request", "tokens_per_success", "input_output_ratio")})


@query("""WITH a AS (SELECT 'k' || CAST(c_custkey % 8 AS string) AS cohort, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 > 0 END AS approved, CAST(c_custkey % 1000 AS double) AS age, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 777 AS double) END AS lag, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 200 END AS ro FROM customer)
    SELECT cohort, count(*) AS n, round(count(CASE WHEN approved THEN 1 END) / count(approved), 8) AS approval_rate, round(quantile_cont(age, 0.95), 6) AS age_p95_s, round(median(lag), 6) AS lag_median_s, round(count(CASE WHEN ro <= 86400 THEN 1 END) / count(*), 8) AS reopened_24h, round(count(CASE WHEN ro <= 604800 THEN 1 END) / count(*), 8) AS reopened_7d FROM a GROUP BY 1""")
def action_metrics(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("'k' || (c_custkey % 8) cohort", "case when c_custkey % 5 <> 0 then c_custkey % 3 > 0 end approved", "cast(c_custkey % 1000 as double) age_s", "case when c_custkey % 5 <> 0 then cast(c_custkey % 777 as double) end decided_after_s", "case when c_custkey % 4 = 0 then c_custkey * 200 end reopened_after_s")
    return G.action_metrics(a).withColumns({c: F.round(c, 8) for c in ("approval_rate", "reopened_24h", "reopened_7d")} | {c: F.round(c, 6) for c in ("age_p95_s", "lag_median_s")})


@query(with_("incidents") + " SELECT incident_id, state FROM incidents ORDER BY detected_at DESC, incident_id LIMIT 50")
def view_last_incidents(spark, sf_dir):
    return G.last_incidents(fixture(spark, sf_dir, "incidents")).select("incident_id", "state")


@query(with_("rule_results") + " SELECT asset, result_id, CAST(nth AS int) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY evaluated_at DESC, result_id) AS nth FROM rule_results) AS x WHERE nth <= 20")
def view_last_rule_results(spark, sf_dir):
    return G.top_per(fixture(spark, sf_dir, "rule_results"), "asset", "evaluated_at", "result_id", 20).select("asset", "result_id", "nth")


@query(with_("reviews") + " SELECT hypothesis_id, arg_max(decision, (reviewed_at, event_id)) AS decision FROM reviews GROUP BY 1")
def view_latest_decision(spark, sf_dir):
    return G.latest_by(fixture(spark, sf_dir, "reviews"), "hypothesis_id", "reviewed_at", "event_id").select("hypothesis_id", "decision")


# --- contributors, sliding windows, operational figures, views


@query("""SELECT c_custkey, array_to_string(list_transform(list_sort(list_filter([struct_pack(o := -round(0.4 * b, 4), n := 'blast'), struct_pack(o := -round(0.3 * h, 4), n := 'history'), struct_pack(o := -round(0.1 * p, 4), n := 'provenance')], lambda x: x.o < 0)), lambda x: x.n), ',') AS contributors
    FROM (SELECT c_custkey, c_custkey % 5 / 4 AS b, c_custkey % 4 / 3 AS h, c_custkey % 2 AS p FROM customer) AS x""")
def risk_contributors(spark, sf_dir):
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 5 / 4 blast", "c_custkey % 4 / 3 history", "0.0d size", "cast(c_custkey % 2 as double) provenance", "false high_finding")
    return G.risk_contributors(s).select("c_custkey", F.array_join(F.transform("contributors", lambda x: x["name"]), ",").alias("contributors"))


@query("""WITH e AS (SELECT event_type AS service, ts, user_id % 10 = 0 AS bad FROM events), w AS (
    SELECT service, '1 hour' AS width, unnest(generate_series(time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes', time_bucket(INTERVAL '30 minutes', ts), INTERVAL '30 minutes')) AS start, bad FROM e
    UNION ALL SELECT service, '6 hours', unnest(generate_series(time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01 00:00:00') - INTERVAL '3 hours', time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01 00:00:00'), INTERVAL '3 hours')), bad FROM e)
    SELECT service, width, CAST(start AS string) AS start, count(*) AS n, count(CASE WHEN bad THEN 1 END) AS bad, round(count(CASE WHEN bad THEN 1 END) / count(*) / 0.01, 6) AS burn FROM w GROUP BY 1, 2, 3""")
def sliding_burn_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_type service", "cast(ts as timestamp) ts", "user_id % 10 = 0 bad")
    return G.burn_rates_sliding(e, {"1 hour": "30 minutes", "6 hours": "3 hours"}, 0.99).withColumns({"start": F.col("start").cast("string"), "burn": F.round("burn", 6)})


@query("""SELECT metric, round(CAST(value AS double), 6) AS value, n, CASE WHEN n = 0 THEN 'sem_dados' WHEN n < 5 THEN 'baixa' ELSE 'alta' END AS confidence FROM (
    SELECT 'sla_at_risk' AS metric, count(DISTINCT CASE WHEN c_custkey % 4 < 2 THEN c_nationkey END) AS value, count(DISTINCT c_nationkey) AS n FROM customer
    UNION ALL SELECT 'incremental_cost', sum(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END), count(CASE WHEN c_custkey % 3 = 0 THEN 1 END) FROM customer
    UNION ALL SELECT 'incremental_cost_pending', count(CASE WHEN c_custkey % 3 = 1 THEN 1 END), count(*) FROM customer
    UNION ALL SELECT 'connectors_healthy', count(CASE WHEN c_custkey % 8 <> 0 THEN 1 END) / count(*), count(*) FROM customer
    UNION ALL SELECT 'recommendations_accepted', count(CASE WHEN c_custkey % 5 = 0 THEN 1 END) / count(CASE WHEN c_custkey % 5 < 2 THEN 1 END), count(CASE WHEN c_custkey % 5 < 2 THEN 1 END) FROM customer
    UNION ALL SELECT 'savings_identified', sum(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END), count(CASE WHEN c_custkey % 2 = 0 THEN 1 END) FROM customer
    UNION ALL SELECT 'savings_approved', sum(CASE WHEN c_custkey % 3 > 0 THEN c_custkey END), count(CASE WHEN c_custkey % 3 > 0 THEN 1 END) FROM customer
    UNION ALL SELECT 'savings_realized', sum(CASE WHEN c_custkey % 9 = 0 THEN c_custkey END), count(CASE WHEN c_custkey % 9 = 0 THEN 1 END) FROM customer
    UNION ALL SELECT 'savings_rate', count(CASE WHEN c_custkey % 9 = 0 THEN 1 END) / count(CASE WHEN c_custkey % 9 < 3 THEN 1 END), count(CASE WHEN c_custkey % 9 < 3 THEN 1 END) FROM customer) AS x""")
def executive_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("double"))
    out = G.executive_operations(
        c.selectExpr("c_nationkey asset", "case when c_custkey % 4 = 0 then 'violado' when c_custkey % 4 = 1 then 'em_risco' else 'no_prazo' end class"),
        c.selectExpr("k incremental_cost", "case c_custkey % 3 when 0 then 'available' when 1 then 'pending' else 'not_available' end status"),
        c.selectExpr("case when c_custkey % 8 = 0 then 'degraded' else 'healthy' end status"),
        c.selectExpr("case c_custkey % 5 when 0 then 'accepted' when 1 then 'rejected' else 'noted' end decision"),
        c.selectExpr("k saving", "c_custkey % 2 = 0 counted"),
        c.selectExpr("k saving", "case c_custkey % 3 when 0 then 'identified' when 1 then 'approved' else 'implemented' end status"),
        c.selectExpr("k net", "case c_custkey % 9 when 0 then 'realizada' when 1 then 'nao_realizada' when 2 then 'expirada' else 'em_medicao' end status"),
    )
    return out.select("metric", F.round("value", 6).alias("value"), "n", "confidence")


@query("SELECT 'rec' || CAST(c_custkey AS string) AS recommendation_id, CASE WHEN c_custkey % 3 = 0 THEN 'accepted' WHEN c_custkey % 3 = 1 THEN 'rejected' ELSE 'pending' END AS decision FROM customer")
def view_recommendations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    r = c.selectExpr("'rec' || c_custkey recommendation_id")
    one = c.filter("c_custkey % 3 < 2").selectExpr("'rec' || c_custkey recommendation_id", "timestamp '2024-01-01 00:00:00' decided_at", "'d1' decision_id", "'rejected' decision")
    two = c.filter("c_custkey % 3 = 0").selectExpr("'rec' || c_custkey recommendation_id", "timestamp '2024-01-02 00:00:00' decided_at", "'d2' decision_id", "'accepted' decision")
    return G.recommendations_with_decision(r, one.unionByName(two))


@query(with_("runs") + """, p AS (SELECT run_id, job_id, healthy_run_id FROM (SELECT r.run_id, r.job_id, h.run_id AS healthy_run_id, row_number() OVER (PARTITION BY r.run_id ORDER BY h.end_time DESC, h.run_id DESC) AS n
    FROM runs r LEFT JOIN runs h ON h.job_id = r.job_id AND h.result_state = 'SUCCESS' AND h.end_time <= r.start_time) AS x WHERE n = 1)
    SELECT c.run_id, p.healthy_run_id, CASE WHEN h.execution_s > 0 THEN round(c.execution_s / h.execution_s, 4) END AS times FROM p JOIN runs c ON c.run_id = p.run_id LEFT JOIN runs h ON h.run_id = p.healthy_run_id""")
def view_run_comparison(spark, sf_dir):
    from opsloom.operators.baselines import last_healthy_run

    runs = fixture(spark, sf_dir, "runs")
    return G.run_comparison(runs, last_healthy_run(runs)).select("run_id", "healthy_run_id", "times")


@query("SELECT 'j' || CAST(c_custkey AS string) AS subject, CASE WHEN c_custkey % 2 = 0 THEN 'approved' END AS initiative, CASE WHEN c_custkey % 4 = 0 THEN 'realizada' END AS measure FROM customer")
def view_opportunities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("'s' source", "'j' || c_custkey subject", "'i' || c_custkey initiative_id", "c_custkey k")
    out = G.opportunities_with_measure(c.select("source", "subject"), c.filter("k % 2 = 0").selectExpr("source", "subject", "initiative_id", "'approved' status"), c.filter("k % 4 = 0").selectExpr("initiative_id", "1.0d net", "'realizada' status"))
    return out.select("subject", "initiative", "measure")
