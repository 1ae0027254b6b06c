"""Lineage graph, impact walks and ontology edges.

A walk is unrolled into one join per hop; at each hop only the best score of an (origin, node) pair goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.sources.scratch import cut

DECAY, DEPTH = 0.5, 3
#: Weights of what reads an asset.
CRITICALITY = {"dashboard": 1.0, "pipeline": 0.8, "job": 0.7, "": 0.5}
#: Data classes that count as sensitive, and the order of an edge's statuses.
SENSITIVE = ("restricted", "confidential", "pii")
STATUS_ORDER = ("rejected", "inferred", "declared", "confirmed")


def lineage_edges(events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Distinct edges of the window with their last sighting; missing entities read as empty."""
    recent = events.filter(F.col("event_time") > now - F.expr(f"INTERVAL '{days}' DAY"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return recent.groupBy("source", "target", blank("entity_type").alias("entity_type"), blank("entity_id").alias("entity_id")).agg(F.max("event_time").alias("last_seen"))


def schema_fingerprints(columns: DataFrame) -> DataFrame:
    """asset, fingerprint: sha256 of the sorted column:type list of each table."""
    part = F.concat_ws(":", F.lower("column_name"), F.lower("data_type"))
    return columns.groupBy("asset").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ",").cast("binary"), 256).alias("fingerprint"))


def merge_graph(prior: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """The graph after a cycle: first sighting kept, the previous fingerprint only on a change, one more cycle."""
    keys = ["source", "target", "entity_type", "entity_id"]
    p = prior.select(*keys, F.col("first_seen").alias("p_first"), F.col("fingerprint").alias("p_fp"), F.col("previous_fingerprint").alias("p_prev"), F.col("changed_at").alias("p_changed"), F.col("observed_cycles").alias("p_cycles"))
    df = edges.join(p, keys, "left")
    changed = F.col("p_fp").isNotNull() & (F.col("p_fp") != "") & (F.col("p_fp") != F.col("fingerprint"))
    return df.select(*keys, F.coalesce("p_first", "last_seen").alias("first_seen"), "last_seen", "fingerprint", F.when(changed, F.col("p_fp")).otherwise(F.coalesce("p_prev", F.lit(""))).alias("previous_fingerprint"), F.when(changed, now).otherwise(F.col("p_changed")).alias("changed_at"), (F.coalesce("p_cycles", F.lit(0)) + 1).alias("observed_cycles"))


def changed_assets(graph: DataFrame) -> DataFrame:
    return graph.filter("previous_fingerprint <> '' and previous_fingerprint <> fingerprint").select(F.col("source").alias("asset")).distinct()


def edge_weight(last_seen: Column, entity_type: Column, now: Column) -> Column:
    """Recency (1 up to 7 days, down to 0.3 at 90; the future counts as now) x certainty x criticality."""
    days = (now.cast("timestamp").cast("long") - last_seen.cast("timestamp").cast("long")) / 86400.0
    recency = F.when(days <= 7, 1.0).when(days >= 90, 0.3).otherwise(1.0 - 0.7 * (days - 7) / 83.0)
    certainty = F.when(entity_type == "", 0.4).otherwise(1.0)
    crit = F.lit(0.6)
    for k, v in CRITICALITY.items():
        crit = F.when(entity_type == k, v).otherwise(crit)
    return recency * certainty * crit


def _usable(edges: DataFrame, direction: str, excluded: DataFrame | list[str] | None) -> DataFrame:
    """(k, to, weight, entity_type): the heaviest edge between two nodes, in the direction of the walk."""
    kind = F.when(F.col("entity_type") == "", F.lit("unknown")).otherwise(F.col("entity_type"))
    node = F.when(F.col("target") != "", F.col("target")).otherwise(F.concat_ws("/", kind, "entity_id"))
    e = edges.filter("target <> '' or entity_id <> ''").withColumn("node", node)
    key, to = ("source", "node") if direction == "down" else ("node", "source")
    e = e.select(F.col(key).alias("k"), F.col(to).alias("to"), "weight", "entity_type")
    if isinstance(excluded, DataFrame):
        out = excluded.select(F.col("node").alias("x")).distinct()
        e = e.join(out, F.col("k") == F.col("x"), "left_anti").join(out, F.col("to") == F.col("x"), "left_anti")
    for end in filter(None, excluded if isinstance(excluded, list) else ()):
        e = e.filter(~F.endswith(F.col("k"), F.lit(end)) & ~F.endswith(F.col("to"), F.lit(end)))
    best = e.groupBy(pair_hash("k", "to"), "k", "to").agg(F.max(F.struct("weight", "entity_type")).alias("b"))
    return best.select(F.xxhash64("k").alias("hash"), "k", "to", "b.weight", "b.entity_type")


def pair_hash(one: str, two: str) -> Column:
    """Number that stands before two names in a grouping: names of a graph begin alike, so that sorting by them alone compares them to the end."""
    return F.xxhash64(one, two).alias("pair")


def expand(level: DataFrame, known: DataFrame | None, edges: DataFrame, hop: int, least: float = 0.0) -> DataFrame:
    """pair, origin, node, score, entity_type, hops: what a hop from ``level`` adds to ``known``.

    Of the paths to a node the best one stays. It is dropped if a shorter path is as good: whatever it leads to, that
    path leads to as well, at least as well and within the depth. It is also dropped below ``least``.
    """
    step = level.select("origin", "node", "score").join(edges, (F.xxhash64("node") == F.col("hash")) & (F.col("node") == F.col("k"))).filter(F.col("to") != F.col("origin"))
    step = step.select("origin", F.col("to").alias("node"), (F.col("score") * F.col("weight") * DECAY).alias("score"), "entity_type")
    if least:
        step = step.filter(F.col("score") >= least)
    best = step.groupBy(pair_hash("origin", "node"), "origin", "node").agg(F.max(F.struct("score", "entity_type")).alias("b")).select("pair", "origin", "node", "b.score", "b.entity_type", F.lit(hop).alias("hops"))
    if known is None:
        return best
    told = known.groupBy("pair", "origin", "node").agg(F.max("score").alias("_known"))
    return best.join(told, ["pair", "origin", "node"], "left").filter(F.col("_known").isNull() | (F.col("score") > F.col("_known"))).drop("_known")


def traverse(edges: DataFrame, origins: DataFrame, direction: str = "down", depth: int = DEPTH, excluded: DataFrame | list[str] | None = None, least: float = 0.0) -> DataFrame:
    """origin, node, score, hops, entity_type, uncertain: the best path to each node within ``depth`` hops.

    ``edges`` has source, target, entity_type, entity_id, weight; ``origins`` has origin. An edge without a target
    leads to ``type/id``; one without both is dropped. An excluded node (of a table: by name; of a list: by the end of
    its name) is neither entered nor left. Only paths that better what is known go on to the next hop; an optional ``least``
    score gives up what is below it. The joins are equi-joins on the node, so that hubs can be split;
    the edges, and each hop but the last, are written once.
    """
    e = cut(_usable(edges, direction, excluded))
    level, known = origins.select("origin", F.col("origin").alias("node"), F.lit(1.0).alias("score")).distinct(), None
    for hop in range(1, depth + 1):
        level = expand(level, known, e, hop, least)
        if hop < depth:
            level = cut(level)  # it is read by every later hop
        known = level if known is None else known.unionByName(level)
    top = known.groupBy("pair", "origin", "node").agg(F.max(F.struct("score", (-F.col("hops")).alias("m"), "entity_type")).alias("b"))
    return top.select("origin", "node", F.round("b.score", 6).alias("score"), (-F.col("b.m")).alias("hops"), F.col("b.entity_type").alias("entity_type"), (F.col("b.entity_type") == "").alias("uncertain"))


def impact_score(reached: DataFrame) -> DataFrame:
    """Per origin: sum of scores, number of assets reached and of uncertain ones (their names are the rows of ``reached``)."""
    return reached.groupBy("origin").agg(F.round(F.sum(F.col("score").cast("decimal(28,6)")), 4).cast("double").alias("impact_score"), F.count(F.lit(1)).alias("assets"), F.count_if("uncertain").alias("uncertain"))


def escalate(reached: DataFrame) -> DataFrame:
    """origin, culprit, severity: a dashboard within reach raises to critical; the highest score names the culprit."""
    dash = reached.filter("entity_type = 'dashboard'")
    return dash.groupBy("origin").agg(F.max(F.struct("score", "node")).alias("b")).select("origin", F.col("b.node").alias("culprit"), F.lit("critical").alias("severity"))


def changed_upstream(edges: DataFrame, origins: DataFrame, changed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """origin, node: changed assets upstream of each origin."""
    up = traverse(edges, origins, "up", depth)
    return up.join(changed.select(F.col("asset").alias("node")), "node", "left_semi").select("origin", "node")


def ontology_edges(lineage: DataFrame, contracts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(subject, predicate, object, origin, status, confidence) triples from lineage, contracts and metric declarations."""
    who = F.concat_ws("/", "entity_type", "entity_id")

    def rows(df, s, p, o, origin, status, conf):
        return df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(origin).alias("origin"), F.lit(status).alias("status"), F.lit(conf).alias("confidence"))

    named = lineage.filter("entity_id <> ''")
    parts = [
        rows(named.filter("target <> ''"), who, "produces", F.col("target"), "lineage", "inferred", 0.85),
        rows(named, who, "consumes", F.col("source"), "lineage", "inferred", 0.85),
        rows(contracts, F.col("asset"), "owned_by", F.col("owner"), "contract", "declared", 1.0),
        rows(contracts.filter(F.lower("classification").isin(*SENSITIVE)), F.col("asset"), "contains_sensitive_data", F.lower("classification"), "contract", "declared", 1.0),
        rows(metrics, F.col("asset"), "implements_metric", F.col("metric_id"), "registry", "declared", 1.0),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def ontology_merge(triples: DataFrame) -> DataFrame:
    """One row a triple and origin; ``canonical`` marks the highest status of each triple, others stay as competitors."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    one = triples.groupBy("subject", "predicate", "object", "origin").agg(F.max(F.struct(rank.alias("r"), "confidence", "status")).alias("b")).select("subject", "predicate", "object", "origin", "b.r", "b.confidence", "b.status")
    w = W.partitionBy("subject", "predicate", "object").orderBy(F.desc("r"), F.desc("confidence"), "origin")
    return one.withColumn("canonical", F.row_number().over(w) == 1).drop("r")
