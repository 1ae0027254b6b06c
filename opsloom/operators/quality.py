"""Data-contract rules. All single-table counts of a contract are fused into one aggregation of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.columns import rule_status, severity_name, severity_rank, violation_limit

#: Spellings of one type.
TYPE_ALIASES = {"integer": "int", "long": "bigint", "text": "string", "varchar": "string"}


def _rows(one: DataFrame, rules: list[tuple[str, str, Column, Column, str]]) -> DataFrame:
    """(rule_id, dimension, numerator, denominator, threshold) rows of a one-row aggregate."""
    items = [F.struct(F.lit(i).alias("rule_id"), F.lit(d).alias("dimension"), n.cast("long").alias("numerator"), m.cast("long").alias("denominator"), F.lit(t).alias("threshold")) for i, d, n, m, t in rules]
    return one.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def scan_rules(df: DataFrame, completeness: dict[str, str] | None = None, validity: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Completeness (rule of column -> threshold) and validity (rule -> (predicate, threshold)) in one scan.

    A null predicate is no violation.
    """
    aggs, rules = [F.count(F.lit(1)).alias("n")], []
    for c, t in (completeness or {}).items():
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"c_{c}"))
        rules.append((f"complete_{c}", "completeness", F.col(f"c_{c}"), F.col("n"), t))
    for name, (predicate, t) in (validity or {}).items():
        aggs.append(F.count_if(~F.expr(predicate)).alias(f"v_{name}"))
        rules.append((name, "validity", F.col(f"v_{name}"), F.col("n"), t))
    return _rows(df.agg(*aggs), rules)


def uniqueness(df: DataFrame, column: str, threshold: str = "<=0%") -> DataFrame:
    """All rows of groups with more than one row; the null key is one group. Counted per key before it moves."""
    per = df.groupBy(F.col(column).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    one = per.agg(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("bad"), F.sum("_n").alias("n"))
    return _rows(one, [(f"unique_{column}", "uniqueness", F.coalesce("bad", F.lit(0)), F.coalesce("n", F.lit(0)), threshold)])


def referential(child: DataFrame, column: str, parent: DataFrame, key: str, threshold: str = "<=0%") -> DataFrame:
    """Child rows without a parent; a null child is an orphan; parents are made distinct so that nothing fans out."""
    known = parent.select(F.col(key).alias("_k")).filter("_k is not null").distinct().withColumn("_hit", F.lit(1))
    per = child.groupBy(F.col(column).alias("_c")).agg(F.count(F.lit(1)).alias("k"))
    one = per.join(known, F.col("_c") == F.col("_k"), "left").agg(F.sum(F.when(F.col("_hit").isNull(), F.col("k")).otherwise(0)).alias("bad"), F.sum("k").alias("n"))
    return _rows(one, [(f"ref_{column}", "referential", F.coalesce("bad", F.lit(0)), F.coalesce("n", F.lit(0)), threshold)])


def judged(results: DataFrame) -> DataFrame:
    """Adds limit, ratio and status to rule rows; a threshold that cannot be read is an evaluation error."""
    df = results.withColumn("limit", violation_limit(F.col("threshold"))).withColumn("ratio", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")))
    return df.withColumn("status", F.when(F.col("limit").isNull(), F.lit("evaluation_error")).otherwise(rule_status(F.col("numerator"), F.col("denominator"), F.col("limit"))))


def volume_rule(counts: DataFrame, history: DataFrame, least_ratio: float = 0.5) -> DataFrame:
    """(asset, rows) against the median of the last ten own results; under three, or a median of 0, passes."""
    w = W.partitionBy("asset").orderBy(F.desc("evaluated_at"), F.desc("result_id"))
    past = history.filter("status <> 'evaluation_error'").withColumn("_n", F.row_number().over(w)).filter("_n <= 10").groupBy("asset").agg(F.median("numerator").alias("usual"), F.count(F.lit(1)).alias("known"))
    df = counts.join(past, "asset", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    passes = (F.col("known") < 3) | (F.col("usual") == 0) | (F.col("rows") / F.col("usual") >= least_ratio)
    return df.withColumn("status", F.when(passes, F.lit("passed")).otherwise(F.lit("violated")))


def freshness_rule(writes: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """asset, last_write, age_s, status: late when the last write is older than the limit; never written is violated."""
    last = writes.groupBy("asset").agg(F.max("timestamp").alias("last_write"))
    df = limits.join(last, "asset", "left").withColumn("age_s", now.cast("timestamp").cast("long") - F.col("last_write").cast("timestamp").cast("long"))
    return df.withColumn("status", F.when(F.col("age_s") <= F.col("limit_s"), F.lit("passed")).otherwise(F.lit("violated")))


def _plain(kind: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.trim(kind), r"\(.*\)", ""))
    out = bare
    for a, b in TYPE_ALIASES.items():
        out = F.when(bare == a, F.lit(b)).otherwise(out)
    return out


def schema_rule(contract: DataFrame, actual: DataFrame) -> DataFrame:
    """asset, numerator (conforming columns), denominator, missing, mismatched, extra, status.

    Inputs are (asset, column_name, data_type) rows; extra columns only inform.
    """
    c = contract.select("asset", F.lower("column_name").alias("c"), _plain(F.col("data_type")).alias("want"))
    a = actual.select("asset", F.lower("column_name").alias("c"), _plain(F.col("data_type")).alias("have"))
    df = c.join(a, ["asset", "c"], "full")
    out = df.groupBy("asset").agg(
        F.count_if(F.col("want") == F.col("have")).alias("numerator"), F.count("want").alias("denominator"), F.count_if(F.col("want").isNotNull() & F.col("have").isNull()).alias("missing"),
        F.count_if(F.col("want") != F.col("have")).alias("mismatched"), F.count_if(F.col("want").isNull()).alias("extra"),
    )
    return out.withColumn("ratio_kind", F.lit("conformance")).withColumn("status", F.when(F.col("missing") + F.col("mismatched") > 0, F.lit("violated")).otherwise(F.lit("passed")))


def latest_per_rule(results: DataFrame) -> DataFrame:
    """The newest result of each (asset, rule)."""
    cols = [c for c in results.columns if c not in ("asset", "rule_id")]
    newest = results.groupBy("asset", "rule_id").agg(F.max(F.struct("evaluated_at", "result_id", *[c for c in cols if c not in ("evaluated_at", "result_id")])).alias("r"))
    return newest.select("asset", "rule_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def group_violations(results: DataFrame, status: str = "violated") -> DataFrame:
    """Per asset: rules with that status, worst severity, blocking rules, summary."""
    bad = results.filter(F.col("status") == status)
    out = bad.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"), F.count_if(F.col("severity") == "blocking").alias("blocking"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return out.withColumn("summary", F.concat_ws(" ", F.col("n").cast("string"), F.lit("rule(s):"), F.array_join("rules", ", ")))


def recent_results(results: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    return results.filter((F.col("evaluated_at") > now - F.expr(f"INTERVAL '{hours}' HOUR")) & (F.col("evaluated_at") <= now))


def latest_batch(observed: DataFrame, now: Column, column: str = "observed_at", hours: int = 6) -> DataFrame:
    """Rows of the newest batch; none when it is older than the window."""
    top = observed.agg(F.max(column).alias("_top"))
    return observed.join(F.broadcast(top), F.col(column) == F.col("_top")).filter(F.col("_top") > now - F.expr(f"INTERVAL '{hours}' HOUR")).drop("_top")


def distribution_rule(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, n, share) of a numeric column over given edges; null is a bin of its own (-1)."""
    where = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        where = F.when(F.col(column) < edges[i], F.lit(i)).otherwise(where)
    per = df.groupBy(F.when(F.col(column).isNull(), F.lit(-1)).otherwise(where).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def reconciliation_rule(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose sums differ by more than the tolerance between two tables."""
    left = a.groupBy(*keys).agg(F.sum(value).alias("left"))
    right = b.groupBy(*keys).agg(F.sum(value).alias("right"))
    gap = F.coalesce("left", F.lit(0.0)) - F.coalesce("right", F.lit(0.0))
    return left.join(right, keys, "full").withColumn("gap", gap).filter(F.abs("gap") > tolerance)


def ranged(column: str, low: float | None = None, high: float | None = None) -> str:
    """Predicate of a range rule for ``scan_rules``."""
    parts = [f"{column} >= {low!r}"] * (low is not None) + [f"{column} <= {high!r}"] * (high is not None)
    return " and ".join(parts) or "true"


def matching(column: str, pattern: str) -> str:
    """Predicate of a regular-expression rule for ``scan_rules``: the whole value matches."""
    text = pattern.replace("'", r"\'")
    return f"{column} rlike r'^(?:{text})$'"


def custom_rule(counts: DataFrame, rule_id: str, threshold: str) -> DataFrame:
    """A rule row out of any one-row query with numerator and denominator."""
    return _rows(counts, [(rule_id, "custom", F.col("numerator"), F.col("denominator"), threshold)])
