"""Evaluation of declared contracts: every declared rule gives one row, whatever becomes of the others.

A rule is resolved against the schema of its table before anything runs; one that names what is not there, cannot be
parsed or is no predicate becomes an ``evaluation_error`` row of its own. The rest of an asset, of all contracts, is one scan:
each row is turned into the rules it violates and the keys it holds, and (rule, key) counts are added up before they
move. If that scan fails while it runs (a cast of a bad value, a division by zero), the rules are halved until the
failing ones stand alone. Samples of violating rows are the ``samples`` smallest hashes of a second scan of the assets
that have violations; a bound on the hash keeps it from sorting or gathering more than a few rows a rule.

Declarations, counts a rule and samples are all that reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.columns import duration_seconds, rule_status, stable_id, violation_limit
from opsloom.operators.quality import TYPE_ALIASES, matching, ranged

MOST_ERROR_CHARS = 500
#: A volume rule looks at so many own results, and judges from so many on.
HISTORY, LEAST_HISTORY = 10, 3
#: Rows that the hash bound of a sample lets through, as expected from the number of violations.
DRAWN = 64
HASH_BITS = 60

SCHEMA = "contract_id string, rule_id string, asset string, dimension string, numerator long, denominator long, threshold string, severity string, window string, definition string, sample array<string>, sample_keys array<string>, detail string, error_message string, measured string"


class Unresolved(ValueError):
    """A rule that cannot be planned against its table."""


@dataclass
class Rule:
    """A declared rule, what it counts (one of the columns or neither), and what became of it."""

    said: Row
    violation: Column | None = None
    key: Column | None = None
    parent: DataFrame | None = None
    found: dict = field(default_factory=dict)

    def fails(self, error: Exception | str) -> None:
        self.found = {"error_message": str(error).strip()[:MOST_ERROR_CHARS] or type(error).__name__, "measured": "error"}


def hash_of(text: Column) -> Column:
    """A portable hash of ``HASH_BITS`` bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def planned(rule: Rule, tables: dict[str, DataFrame]) -> None:
    """Fill in the columns of a rule that counts rows or keys; raises if its table has no such thing."""
    r, df = rule.said, tables.get(rule.said["asset"])
    if df is None:
        raise Unresolved(f"no table {r['asset']}")
    if r["kind"] in ("volume", "schema", "freshness", "custom"):
        return
    if not (r["column"] or "").strip() and r["kind"] != "validity":
        raise Unresolved(f"rule {r['rule_id']} ({r['kind']}) needs a column")
    if r["kind"] in ("uniqueness", "referential"):
        rule.key = F.expr(r["column"])
        if r["kind"] == "uniqueness":
            df.groupBy(rule.key).count()
        else:
            parent, _, name = (r["argument"] or "").rpartition(".")
            if parent not in tables:
                raise Unresolved(f"no table {parent} for {r['argument']}")
            known = tables[parent].select(F.col(name).alias("_parent"))
            kind = df.select(rule.key.alias("_child")).join(known, F.col("_child") == F.col("_parent")).select(F.coalesce("_child", "_parent").alias("k")).schema["k"].dataType
            rule.key, rule.parent = rule.key.cast(kind), known.select(F.col("_parent").cast(kind).alias("_parent"))
        return
    if r["kind"] == "completeness":
        rule.violation = F.expr(r["column"]).isNull()
    elif r["kind"] in ("validity", "range", "regex"):
        text = r["argument"] or ""
        if r["kind"] == "range":
            low, _, high = text.partition("..")
            text = ranged(r["column"], *[float(x) if x else None for x in (low, high)])
        elif r["kind"] == "regex":
            text = matching(r["column"], text)
        if not text.strip():
            raise Unresolved(f"rule {r['rule_id']} ({r['kind']}) needs a predicate")
        rule.violation = ~F.expr(text)
    else:
        raise Unresolved(f"no rule of kind {r['kind']}")
    df.filter(rule.violation)  # fails here for what is not there, or is no predicate of one row


def long_form(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, key, n): rule -1 counts rows, a rule of a predicate the rows against it, other rules the rows of each key."""
    none = F.lit(None).cast("string")
    entry = lambda i, key: F.struct(F.lit(i).alias("rule"), key.alias("key"))
    each = [entry(-1, none)] + [F.when(r.violation, entry(i, none)) for i, r in enumerate(rules) if r.violation is not None]
    each += [entry(i, r.key.cast("string")) for i, r in enumerate(rules) if r.key is not None]
    entries = df.select(F.explode(F.array(*each)).alias("e")).filter("e is not null")
    return entries.groupBy("e.rule", "e.key").agg(F.count(F.lit(1)).alias("n"))


def judged_keys(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The long form with ``bad``: rows of a key that occurs again, or has no parent, or break a predicate."""
    counted, parents = long_form(df, rules), None
    for i, r in enumerate(rules):
        if r.parent is not None:
            own = r.parent.filter("_parent is not null").select(F.lit(i).alias("rule"), F.col("_parent").cast("string").alias("key")).distinct()
            parents = own if parents is None else parents.unionByName(own)
    orphan = [i for i, r in enumerate(rules) if r.parent is not None]
    if parents is not None:
        counted = counted.join(parents.withColumn("hit", F.lit(True)), ["rule", "key"], "left")
    else:
        counted = counted.withColumn("hit", F.lit(True))
    twice = [i for i, r in enumerate(rules) if r.key is not None and r.parent is None]
    bad = F.when(F.col("rule").isin(twice), F.col("n") > 1).when(F.col("rule").isin(orphan), F.col("hit").isNull()).otherwise(F.col("rule") >= 0)
    return counted.withColumn("bad", bad)


def measure(df: DataFrame, rules: list[Rule], samples: int, identity: list[str] | None) -> None:
    """Count all the rules of an asset in one scan; halve them where it fails."""
    if not rules:
        return
    try:
        sums = judged_keys(df, rules).groupBy("rule").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.count_if("bad").alias("keys"), F.sum("n").alias("n")).collect()
        by = {r["rule"]: r for r in sums}
        rows = by[-1]["n"] if -1 in by else 0
        for i, r in enumerate(rules):
            r.found = {"numerator": by[i]["bad"] if i in by else 0, "denominator": rows, "measured": "share"}
        short = {i: by[i]["keys"] if r.key is not None else by[i]["bad"] for i, r in enumerate(rules) if i in by and by[i]["bad"]}
        for i, some in sampled(df, rules, short, samples, identity).items():
            rules[i].found |= {"sample": [s["text"] for s in some], "sample_keys": [s["id"] for s in some]}
    except Exception as e:  # of Spark's workers, in any shape: it says which rules cannot be evaluated
        if len(rules) == 1:
            rules[0].fails(e)
        else:
            for half in (rules[: len(rules) // 2], rules[len(rules) // 2 :]):
                measure(df, half, samples, identity)


def sampled(df: DataFrame, rules: list[Rule], many: dict[int, int], samples: int, identity: list[str] | None) -> dict[int, list[Row]]:
    """For each rule the violations of smallest hash: (id, text). many: how many there are of each, copies included.

    The bound on the hash is raised eightfold for rules that found too few (copies have one hash), up to no bound.
    """
    out: dict[int, list[Row]] = {}
    share, ident = dict.fromkeys(many, 1), F.concat_ws("|", *[F.col(c).cast("string") for c in identity or df.columns])
    while many:
        top = {i: min(1 << HASH_BITS, (share[i] * DRAWN << HASH_BITS) // n) for i, n in many.items()}
        below = lambda i, h: h < F.lit(top[i])  # noqa: B023, E731
        parts = []
        if flat := [i for i in many if rules[i].violation is not None]:
            entry = [F.when(rules[i].violation & below(i, F.col("_h")), F.struct(F.lit(i).alias("rule"), F.col("_h").alias("h"), F.col("_id").alias("id"), F.to_json(F.struct(*df.columns)).alias("text"))) for i in flat]
            parts.append(df.withColumns({"_id": ident, "_h": hash_of(ident)}).select(F.explode(F.array(*entry)).alias("e")).filter("e is not null").select("e.*"))
        if keyed := [i for i in many if rules[i].key is not None]:
            h = hash_of(F.coalesce("key", F.lit("")))
            bound = F.element_at(F.create_map(*[F.lit(x) for i in keyed for x in (i, top[i])]), F.col("rule"))
            parts.append(judged_keys(df, [r if i in keyed else Rule(r.said) for i, r in enumerate(rules)]).filter("bad and rule >= 0").select("rule", h.alias("h"), F.col("key").alias("id"), F.to_json(F.struct("key", "n")).alias("text")).filter(F.col("h") < bound))
        drawn = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        w = W.partitionBy("rule").orderBy("h", "id")
        best = drawn.groupBy("rule", "h", "id").agg(F.min("text").alias("text")).withColumn("at", F.row_number().over(w)).filter(F.col("at") <= samples)
        found: dict[int, list[Row]] = {}
        for r in sorted(best.collect(), key=lambda r: r["at"]):
            found.setdefault(r["rule"], []).append(r)
        done = [i for i in many if len(found.get(i, ())) >= samples or top[i] == 1 << HASH_BITS]
        out |= {i: found.get(i, []) for i in done}
        many = {i: n for i, n in many.items() if i not in done}
        share = {i: 8 * share[i] for i in many}
    return out


def measure_custom(df: DataFrame, rule: Rule) -> None:
    """Two aggregates: ``argument`` is the numerator, ``column`` the denominator (all rows, if empty)."""
    try:
        row = df.agg(F.expr(rule.said["argument"] or "").cast("long").alias("n"), F.expr((rule.said["column"] or "").strip() or "count(1)").cast("long").alias("d")).first()
        rule.found = {"numerator": row["n"] or 0, "denominator": row["d"] or 0, "measured": "share"}
    except Exception as e:  # as in measure
        rule.fails(e)


def plain_type(kind: str) -> str:
    """A type's name without its parameters, in one spelling."""
    bare = kind.strip().lower().split("(")[0]
    return TYPE_ALIASES.get(bare, bare)


def measure_schema(df: DataFrame, rule: Rule, declared: list[Row]) -> None:
    """Declared columns that are there with their type; new columns only inform."""
    have, want = {c.lower(): t for c, t in df.dtypes}, {r["column_name"].lower(): r["data_type"] for r in declared}
    missing = sorted(set(want) - set(have))
    other = sorted(c for c in want if c in have and plain_type(want[c]) != plain_type(have[c]))
    new = sorted(set(have) - set(want))
    said = [f"{name}: {', '.join(some)}" for name, some in (("missing", missing), ("other type", other), ("new", new if want else [])) if some]
    rule.found = {"numerator": len(want) - len(missing) - len(other), "denominator": len(want), "measured": "violated" if missing or other else "passed", "detail": "; ".join(said) or ("as declared" if want else "no columns declared")}


def measure_freshness(rule: Rule, last: dict[str, datetime], limit: int | None, now: datetime) -> None:
    """Seconds since the last write against the limit."""
    if limit is None:
        rule.fails(f"no duration: {rule.said['threshold']}")
    elif (at := last.get(rule.said["asset"])) is None:
        rule.fails(f"no write of {rule.said['asset']} is known")
    else:
        age = int((now - at).total_seconds())
        rule.found = {"numerator": age, "denominator": 0, "measured": "passed" if age <= limit else "violated", "detail": f"last write {age} s ago"}


def measure_volume(rule: Rule, rows: int, past: Row | None) -> None:
    """Rows against the median of the rule's own last results."""
    r = rule.said
    try:
        least = float((r["threshold"] or "").strip(" <>=%"))
    except ValueError:
        rule.fails(f"no share: {r['threshold']}")
        return
    known = 0 if past is None else past["known"]
    if known < LEAST_HISTORY or not past["usual"]:
        verdict, detail = "passed", f"{known} results known" if known < LEAST_HISTORY else "usual count is 0"
    else:
        verdict, detail = ("passed" if rows / past["usual"] >= least else "violated"), f"{rows} rows, {rows / past['usual']:.0%} of the usual {past['usual']:g}"
    rule.found = {"numerator": rows, "denominator": rows, "measured": verdict, "detail": detail}


def run_contracts(contracts: DataFrame, tables: dict[str, DataFrame], now: datetime, columns: DataFrame | None = None, writes: DataFrame | None = None, history: DataFrame | None = None, identity: dict[str, list[str]] | None = None, samples: int = 5) -> DataFrame:
    """One result row for every rule of the active or approved contracts.

    ``contracts`` (contract_id, status, asset, rule_id, kind, column, argument, threshold, severity, window) holds one row a
    rule. Kinds: completeness and uniqueness of ``column`` (an expression), validity (``argument`` is a predicate; null is no
    violation), range (``low..high``), regex (of the whole value), referential (``argument`` is ``table.key``), volume (least share of the
    usual count), freshness (``writes``: asset, timestamp; a duration such as 24h), schema (``columns``: contract_id, column_name,
    data_type) and custom (see ``measure_custom``). ``history`` (asset, rule_id, numerator, status, evaluated_at, result_id) is for
    volume. ``identity`` names the columns of a table that tell its rows apart, for samples (all columns otherwise).
    """
    spark = contracts.sparkSession
    rules = [Rule(r) for r in contracts.filter(F.col("status").isin("active", "approved")).orderBy("contract_id", "rule_id").collect()]
    for r in rules:
        try:
            planned(r, tables)
        except (PySparkException, ValueError) as e:
            r.fails(e)
    live = [r for r in rules if not r.found]
    counting = {"volume", "schema", "freshness", "custom"}
    for asset in dict.fromkeys(r.said["asset"] for r in live):
        measure(tables[asset], [r for r in live if r.said["asset"] == asset and r.said["kind"] not in counting], samples, (identity or {}).get(asset))
    own = [r for r in live if r.said["kind"] in counting]
    kinds = {r.said["kind"] for r in own}
    declared = columns.collect() if columns is not None and "schema" in kinds else []
    last = {r["asset"]: r["at"] for r in writes.filter(F.col("asset").isin(sorted({r.said["asset"] for r in own}))).groupBy("asset").agg(F.max("timestamp").alias("at")).collect()} if writes is not None and "freshness" in kinds else {}
    past = {}
    if history is not None and "volume" in kinds:
        w = W.partitionBy("asset", "rule_id").orderBy(F.desc("evaluated_at"), F.desc("result_id"))
        wanted = history.filter("status <> 'evaluation_error'").join(F.broadcast(spark.createDataFrame([(r.said["asset"], r.said["rule_id"]) for r in own], "asset string, rule_id string").distinct()), ["asset", "rule_id"])
        usual = wanted.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= HISTORY).groupBy("asset", "rule_id").agg(F.median("numerator").alias("usual"), F.count(F.lit(1)).alias("known"))
        past = {(r["asset"], r["rule_id"]): r for r in usual.collect()}
    limits = {}
    if "freshness" in kinds:
        texts = spark.createDataFrame([(r.said["threshold"],) for r in own], "t string").distinct()
        limits = {r["t"]: r["s"] for r in texts.select("t", duration_seconds(F.regexp_replace(F.coalesce("t", F.lit("")), r"^[<=\s]+|\s+$", "")).alias("s")).collect()}
    counts: dict[str, int] = {}
    for r in own:
        kind, asset = r.said["kind"], r.said["asset"]
        try:
            if kind == "schema":
                measure_schema(tables[asset], r, [c for c in declared if c["contract_id"] == r.said["contract_id"]])
            elif kind == "custom":
                measure_custom(tables[asset], r)
            elif kind == "freshness":
                measure_freshness(r, last, limits.get(r.said["threshold"]), now)
            else:
                if asset not in counts:
                    counts[asset] = next((x.found["denominator"] for x in live if x.said["asset"] == asset and x.said["kind"] not in counting and x.found.get("measured") == "share"), None) or tables[asset].count()
                measure_volume(r, counts[asset], past.get((asset, r.said["rule_id"])))
        except Exception as e:  # as in measure
            r.fails(e)
    return results(spark, rules, now)


def results(spark, rules: list[Rule], now: datetime) -> DataFrame:
    """Rows of evaluated rules with ids, hash of the definition, ratio and status."""
    empty = dict.fromkeys(("numerator", "denominator", "sample", "sample_keys", "detail", "error_message"))
    text = lambda r: "|".join(str(r[c] or "").strip() for c in ("kind", "asset", "column", "argument"))
    made = [{**empty, **r.found, **{c: r.said[c] for c in ("contract_id", "rule_id", "asset", "threshold", "severity", "window")}, "dimension": r.said["kind"], "definition": text(r.said)} for r in rules]
    order = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(m[c] for c in order) for m in made], SCHEMA)
    limit = violation_limit(F.col("threshold"))
    unread = (F.col("measured") == "share") & limit.isNull()
    status = F.when((F.col("measured") == "error") | unread, F.lit("evaluation_error")).when(F.col("measured") == "share", rule_status(F.col("numerator"), F.col("denominator"), limit)).otherwise(F.col("measured"))
    return df.select(
        stable_id("res-", F.col("contract_id"), F.col("rule_id"), F.lit(now.isoformat())).alias("result_id"), "contract_id", "rule_id", "asset", "dimension", status.alias("status"), "numerator", "denominator",
        F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).alias("ratio"), "threshold", "severity", "window", F.substring(F.sha2(F.col("definition").cast("binary"), 256), 1, 16).alias("query_hash"),
        "sample", "sample_keys", "detail", F.when(unread, F.concat(F.lit("no limit: "), F.coalesce("threshold", F.lit("none")))).otherwise(F.col("error_message")).alias("error_message"), F.lit(now).alias("evaluated_at"))
