"""Read models of a console: what belongs to some incidents, commits or periods, in the order in which it is shown.

A view takes the ids it is for as a table, so one call serves a page of incidents as well as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators.governance import latest_by


def of(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted ids, all others left where they are."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def timeline(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the incidents with ``nth``, in order of time, kind and id."""
    w = W.partitionBy("incident_id").orderBy("at", "kind", "entry_id")
    return of(entries, ids, "incident_id").withColumn("nth", F.row_number().over(w))


def hypotheses(ranked: DataFrame, evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """Ranked hypotheses of the incidents, each with the number of its incident's evidence rows."""
    known = of(evidence, ids, "incident_id").groupBy("incident_id").agg(F.count(F.lit(1)).alias("evidence"))
    return of(ranked, ids, "incident_id").join(known, "incident_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))


def narratives(told: DataFrame, ids: DataFrame) -> DataFrame:
    """The newest narrative of each incident; none for an incident that has none."""
    return latest_by(of(told, ids, "incident_id"), "incident_id", "narrated_at", "narrative_id")


def communications(outbox: DataFrame, attempts: DataFrame) -> DataFrame:
    """Messages with their attempts: number, the last status (pending without any) and when it was."""
    last = attempts.groupBy("outbox_id").agg(F.count(F.lit(1)).alias("tries"), F.max(F.struct("at", "status")).alias("l"))
    df = outbox.join(last, "outbox_id", "left")
    return df.select(*outbox.columns, F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("l.status", F.lit("pending")).alias("status"), F.col("l.at").alias("last_at"))


def gates(decisions: DataFrame, effective: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits with the decision of their gate, its reason, and whether an override let them pass."""
    df = commits.join(decisions, "sha").join(effective.select("sha", F.col("decision").alias("effective")), "sha")
    return df.withColumn("overridden", (F.col("decision") == "block") & (F.col("effective") == "allow"))


def dependencies(deps: DataFrame, findings: DataFrame) -> DataFrame:
    """The bill of materials: package, files, versions (lowest and highest as text), findings, worst severity known."""
    per = deps.groupBy("package").agg(F.count_distinct("file").alias("files"), F.count_distinct("version").alias("versions"))
    bad = findings.groupBy("package").agg(F.count(F.lit(1)).alias("findings"), F.max((F.col("severity") == "alta").cast("int")).alias("_high"))
    df = per.join(bad, "package", "left")
    return df.select("package", "files", "versions", F.coalesce("findings", F.lit(0)).alias("findings"), F.when(F.col("_high") == 1, F.lit("alta")).when(F.col("_high") == 0, F.lit("média")).alias("severity"))


def costs_per_period(allocated: DataFrame, at: str, period: str = "month") -> DataFrame:
    """period, category, cost and its share of the period's cost."""
    per = allocated.groupBy(F.date_trunc(period, F.col(at).cast("timestamp")).alias("period"), "category").agg(F.sum("cost").alias("cost"))
    whole = F.sum("cost").over(W.partitionBy("period"))
    return per.withColumn("share", F.when(whole != 0, F.col("cost").cast("double") / whole.cast("double")))
