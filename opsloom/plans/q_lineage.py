"""Queries of the lineage graph, impact and ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import lineage as L
from opsloom.plans.fixtures import fixture, table, with_
from opsloom.registry import query



def now():
    """The fixed instant of these queries."""
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))
_EDGES = with_("edges") + """, dated AS (SELECT source, target, entity_type, entity_id, max(seen) AS last_seen FROM edges WHERE seen > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '30' DAY GROUP BY 1, 2, 3, 4),
    d2 AS (SELECT *, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_seen)) / 86400 AS days FROM (SELECT source, target, entity_type, entity_id, max(seen) AS last_seen FROM edges GROUP BY 1, 2, 3, 4) AS q),
    w AS (SELECT source, CASE WHEN target <> '' THEN target ELSE CASE WHEN entity_type = '' THEN 'unknown' ELSE entity_type END || '/' || entity_id END AS node, entity_type,
          (CASE WHEN days <= 7 THEN 1.0 WHEN days >= 90 THEN 0.3 ELSE 1.0 - 0.7 * (days - 7) / 83.0 END) * CASE WHEN entity_type = '' THEN 0.4 ELSE 1.0 END * CASE entity_type WHEN 'dashboard' THEN 1.0 WHEN 'pipeline' THEN 0.8 WHEN 'job' THEN 0.7 WHEN '' THEN 0.5 ELSE 0.6 END AS weight
          FROM d2 WHERE target <> '' OR entity_id <> '')"""


def _walk(key: str, to: str) -> str:
    one = f"e AS (SELECT {key} AS k, {to} AS t, max(CAST(weight AS double)) AS weight, max_by(entity_type, (weight, entity_type)) AS entity_type FROM w GROUP BY 1, 2)"
    out = one
    for hop in (1, 2, 3):
        src = "o" if hop == 1 else f"b{hop - 1}"
        out += f", s{hop} AS (SELECT {src}.origin, t AS node, {src}.score * weight * 0.5 AS score, e.entity_type FROM {src} JOIN e ON e.k = {src}.node WHERE t <> {src}.origin), b{hop} AS (SELECT origin, node, max(score) AS score, max_by(entity_type, (score, entity_type)) AS entity_type FROM s{hop} GROUP BY 1, 2)"
    return out + ", al AS (SELECT *, 1 AS hops FROM b1 UNION ALL SELECT *, 2 FROM b2 UNION ALL SELECT *, 3 FROM b3), reached AS (SELECT origin, node, round(score, 6) AS score, hops, entity_type, entity_type = '' AS uncertain FROM (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY score DESC, hops, entity_type DESC) AS n FROM al) AS x WHERE n = 1)"


_DOWN = _EDGES + ", o AS (SELECT 'region.' || CAST(r_regionkey AS string) AS origin, 'region.' || CAST(r_regionkey AS string) AS node, CAST(1 AS double) AS score FROM region), " + _walk("source", "node")
_UP = _EDGES + ", o AS (SELECT 'part.' || CAST(p_partkey AS string) AS origin, 'part.' || CAST(p_partkey AS string) AS node, CAST(1 AS double) AS score FROM part), " + _walk("node", "source")


def weighted(spark, sf_dir):
    e = fixture(spark, sf_dir, "edges").groupBy("source", "target", "entity_type", "entity_id").agg(F.max("seen").alias("last_seen"))
    return e.withColumn("weight", L.edge_weight(F.col("last_seen"), F.col("entity_type"), now()))


def _down(spark, sf_dir):
    return L.traverse(weighted(spark, sf_dir), table(spark, sf_dir, "region").selectExpr("'region.' || r_regionkey origin"))


@query(_EDGES + " SELECT source, target, entity_type, entity_id, CAST(last_seen AS string) AS last_seen FROM dated")
def lineage_edges(spark, sf_dir):
    return L.lineage_edges(fixture(spark, sf_dir, "edges").withColumnRenamed("seen", "event_time"), now()).withColumn("last_seen", F.col("last_seen").cast("string"))


@query(_DOWN + " SELECT * FROM reached")
def impact_walk(spark, sf_dir):
    return _down(spark, sf_dir)


@query(_UP + " SELECT * FROM reached")
def upstream_walk(spark, sf_dir):
    return L.traverse(weighted(spark, sf_dir), table(spark, sf_dir, "part").selectExpr("'part.' || p_partkey origin"), "up")


@query(_DOWN + " SELECT origin, CAST(round(sum(CAST(score AS decimal(28,6))), 4) AS double) AS impact_score, count(*) AS assets, count(CASE WHEN uncertain THEN 1 END) AS uncertain FROM reached GROUP BY origin")
def impact_scores(spark, sf_dir):
    return L.impact_score(_down(spark, sf_dir))


@query(_DOWN + " SELECT origin, max_by(node, (score, node)) AS culprit, 'critical' AS severity FROM reached WHERE entity_type = 'dashboard' GROUP BY origin")
def escalations(spark, sf_dir):
    return L.escalate(_down(spark, sf_dir))


@query(_EDGES + " SELECT source, node, round(CAST(weight AS double), 6) AS weight FROM w")
def edge_weights(spark, sf_dir):
    node = F.expr("case when target <> '' then target else case when entity_type = '' then 'unknown' else entity_type end || '/' || entity_id end")
    return weighted(spark, sf_dir).filter("target <> '' or entity_id <> ''").select("source", node.alias("node"), F.round("weight", 6).alias("weight"))


_FP = ", col AS (SELECT 'nation.' || CAST(n_nationkey AS string) AS asset, n_name AS c, 'INT' AS t FROM nation UNION ALL SELECT 'nation.' || CAST(n_nationkey AS string), r_name, 'string' FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(with_("edges") + _FP + " SELECT asset, sha256(array_to_string(list_sort(list(lower(c) || ':' || lower(t))), ',')) AS fingerprint FROM col GROUP BY asset")
def schema_fingerprints(spark, sf_dir):
    return L.schema_fingerprints(_columns(spark, sf_dir))


def _columns(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.selectExpr("'nation.' || n_nationkey asset", "n_name column_name", "'INT' data_type").unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("'nation.' || n_nationkey asset", "r_name column_name", "'string' data_type"))


def _merged(spark, sf_dir):
    e = L.lineage_edges(fixture(spark, sf_dir, "edges").withColumnRenamed("seen", "event_time"), now()).withColumn("fingerprint", F.concat(F.lit("f"), F.expr("length(source) % 3")))
    prior = e.filter("length(target) % 2 = 0").select("source", "target", "entity_type", "entity_id", F.expr("last_seen - interval '40' day").alias("first_seen"), F.concat(F.lit("f"), F.expr("length(source) % 2")).alias("fingerprint"), F.lit("").alias("previous_fingerprint"), F.lit(None).cast("timestamp").alias("changed_at"), F.lit(4).alias("observed_cycles"))
    return L.merge_graph(prior, e, now())


_MERGED = _EDGES + """, f AS (SELECT *, 'f' || CAST(length(source) % 3 AS string) AS fp, CASE WHEN length(target) % 2 = 0 THEN 'f' || CAST(length(source) % 2 AS string) END AS old FROM dated),
    m AS (SELECT source, target, entity_type, entity_id, CAST(CASE WHEN old IS NULL THEN last_seen ELSE last_seen - INTERVAL '40' DAY END AS string) AS first_seen, fp AS fingerprint, CASE WHEN old <> fp THEN old ELSE '' END AS previous_fingerprint, CASE WHEN old <> fp THEN '2024-01-31 00:00:00' END AS changed_at, CASE WHEN old IS NULL THEN 1 ELSE 5 END AS observed_cycles FROM f)"""


@query(_MERGED + " SELECT * FROM m")
def merged_graph(spark, sf_dir):
    return _merged(spark, sf_dir).drop("last_seen").withColumns({c: F.col(c).cast("string") for c in ("first_seen", "changed_at")})


@query(_MERGED + " SELECT DISTINCT source AS asset FROM m WHERE previous_fingerprint <> '' AND previous_fingerprint <> fingerprint")
def changed_assets(spark, sf_dir):
    return L.changed_assets(_merged(spark, sf_dir))


@query(_UP + " SELECT origin, node FROM reached WHERE node LIKE 'nation.%' AND length(node) = 9")
def changed_upstream(spark, sf_dir):
    changed = table(spark, sf_dir, "nation").selectExpr("'nation.' || n_nationkey asset").filter("length(asset) = 9")
    return L.changed_upstream(weighted(spark, sf_dir), table(spark, sf_dir, "part").selectExpr("'part.' || p_partkey origin"), changed)


def _triples(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    contracts = c.selectExpr("'nation.' || c_nationkey asset", "'team-' || (c_custkey % 4) owner", "case c_custkey % 3 when 0 then 'PII' when 1 then 'public' else 'restricted' end classification")
    metrics = c.selectExpr("'nation.' || c_nationkey asset", "'m' || (c_custkey % 6) metric_id")
    return L.ontology_edges(weighted(spark, sf_dir), contracts, metrics)


_TRIPLES = with_("edges") + """, l AS (SELECT DISTINCT source, target, entity_type || '/' || entity_id AS who FROM edges WHERE entity_id <> ''),
    t AS (SELECT who AS subject, 'produces' AS predicate, target AS object, 'lineage' AS origin, 'inferred' AS status, 0.85 AS confidence FROM l WHERE target <> '' UNION SELECT who, 'consumes', source, 'lineage', 'inferred', 0.85 FROM l
    UNION SELECT 'nation.' || CAST(c_nationkey AS string), 'owned_by', 'team-' || CAST(c_custkey % 4 AS string), 'contract', 'declared', 1.0 FROM customer
    UNION SELECT 'nation.' || CAST(c_nationkey AS string), 'contains_sensitive_data', CASE WHEN c_custkey % 3 = 0 THEN 'pii' ELSE 'restricted' END, 'contract', 'declared', 1.0 FROM customer WHERE c_custkey % 3 <> 1
    UNION SELECT 'nation.' || CAST(c_nationkey AS string), 'implements_metric', 'm' || CAST(c_custkey % 6 AS string), 'registry', 'declared', 1.0 FROM customer)"""


@query(_TRIPLES + " SELECT subject, predicate, object, origin, status, CAST(confidence AS double) AS confidence FROM t")
def ontology_edges(spark, sf_dir):
    return _triples(spark, sf_dir)


@query(_TRIPLES + ", u AS (SELECT * FROM t UNION ALL SELECT subject, predicate, object, 'review', 'confirmed', 0.9 FROM t WHERE predicate = 'owned_by' AND length(subject) = 8 UNION ALL SELECT subject, predicate, object, 'review', 'rejected', 0.9 FROM t WHERE predicate = 'owned_by') SELECT subject, predicate, object, origin, status, CAST(confidence AS double) AS confidence, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY r DESC, confidence DESC, origin) = 1 AS canonical FROM (SELECT *, list_position(['rejected', 'inferred', 'declared', 'confirmed'], status) AS r, row_number() OVER (PARTITION BY subject, predicate, object, origin ORDER BY list_position(['rejected', 'inferred', 'declared', 'confirmed'], status) DESC, confidence DESC) AS k FROM u) AS x WHERE k = 1")
def ontology_merged(spark, sf_dir):
    t = _triples(spark, sf_dir)
    owned = t.filter("predicate = 'owned_by'").withColumn("origin", F.lit("review")).withColumn("confidence", F.lit(0.9))
    return L.ontology_merge(t.unionByName(owned.filter("length(subject) = 8").withColumn("status", F.lit("confirmed"))).unionByName(owned.withColumn("status", F.lit("rejected"))))
