"""Robust baselines and regressions of run time and cost.

The threshold of a sample is the largest of twice its median, its median plus five median absolute deviations, and its
median plus a floor. Nothing here collects; the fold over a job's runs takes them batch by batch in the order of their ends.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.columns import once, volume_band
from opsloom.functions.ordered import last_known, last_values, running_number, values_before
from opsloom.functions.quantiles import INCLUSIVE, exact_quantiles
from opsloom.sources.scratch import cut

RATIO, DEVIATIONS, FLOOR_S, FLOOR_COST = 2.0, 5.0, 30.0, 0.05
WINDOW, LEAST = 20, 5


def median_of(values: Column) -> Column:
    """Exact median of an array without nulls, which is sorted once; null for an empty one."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)

    return once(F.sort_array(values), middle)


def robust_terms(median: Column, mad: Column, floor: float) -> Column:
    """Struct of median, mad, threshold and deciding_term (ties in the order ratio, mad, floor)."""
    ratio, spread, least = RATIO * median, median + DEVIATIONS * mad, median + floor
    top = F.greatest(ratio, spread, least)
    term = F.when(top == ratio, F.lit("ratio")).when(top == spread, F.lit("mad")).when(top.isNotNull(), F.lit("floor"))
    return F.struct(median.alias("median"), mad.alias("mad"), top.alias("threshold"), term.alias("deciding_term"))


def robust_threshold(df: DataFrame, sample: str, floor: float = FLOOR_S) -> DataFrame:
    """Adds median, mad, threshold and deciding_term of an array column; two sorts a row."""

    def of_median(m: Column) -> Column:
        return once(median_of(F.transform(sample, lambda x: F.abs(x - m))), lambda d: robust_terms(m, d, floor))

    return df.select("*", F.inline(F.array(once(median_of(F.col(sample)), of_median))))


def robust_thresholds(rows: DataFrame, key: str, value: str, floor: float = FLOOR_S) -> DataFrame:
    """(key, median, mad, threshold, deciding_term) over all values of a key, however many.

    Medians are exact and gather no key's values.
    """
    middle = exact_quantiles(rows, [key], value, {"_m": (0.5, INCLUSIVE)}).drop("n")
    apart = rows.join(middle, key).select(key, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    spread = exact_quantiles(apart, [key], "_d", {"_d": (0.5, INCLUSIVE)}).drop("n").join(middle, key)
    return spread.select(key, F.inline(F.array(robust_terms(F.col("_m"), F.col("_d"), floor))))


def measured(runs: DataFrame) -> DataFrame:
    """Adds metric and value: the execution time where it was measured, else the total time."""
    has = F.col("execution_s").isNotNull()
    return runs.withColumns({"metric": F.when(has, "execution").otherwise("total"), "value": F.coalesce("execution_s", "duration_s")})


def runtime_samples(runs: DataFrame, value: str = "execution_s", size: int = WINDOW, within: dict[str, list[str]] | None = None, excluded: DataFrame | None = None, regimes: DataFrame | None = None) -> DataFrame:
    """Each run with the values of the last ``size`` successful runs of its job that ended by its start, latest first.

    ``within`` has for each sample the columns in which sample and run must agree (a volume band, a metric), each those
    of the samples before it as well; ``excluded`` (run_id) are runs that are no sample, ``regimes`` (job_id,
    regime_start) the start from which on runs are.

    However far back they are: ends and starts are merged into one ordered stream per key, once for all samples. A run
    that does not take any time stands before its own end.
    """
    names = {name: ["job_id", *columns] for name, columns in (within or {"sample": []}).items()}
    keys, order = list(names.values())[-1], ["_at", "_k", "_r", "_s"]
    good = runs.filter((F.col("result_state") == "SUCCESS") & F.col(value).isNotNull() & F.col("end_time").isNotNull())
    if regimes is not None:
        good = good.join(regimes.select("job_id", F.col("regime_start").alias("_from")), "job_id", "left").filter("_from is null or start_time >= _from")
    if excluded is not None:
        good = good.join(excluded.select("run_id"), "run_id", "left_anti")
    ends = good.select(*keys, F.col("end_time").alias("_at"), F.lit(0).alias("_k"), F.col("run_id").alias("_r"), F.lit(1).alias("_s"), F.col(value).alias("_v"))
    instant = F.coalesce(F.col("end_time") <= F.col("start_time"), F.lit(False))
    starts = runs.withColumns({"_at": F.when(instant, F.col("end_time")).otherwise(F.col("start_time")), "_k": F.when(instant, 0).otherwise(1), "_r": F.col("run_id"), "_s": F.lit(0)})
    return values_before(starts, ends, names, order, "_v", size).drop(*order)


def runtime_baseline(runs: DataFrame, value: str = "execution_s", floor: float = FLOOR_S, least: int = LEAST, excluded: DataFrame | None = None, regimes: DataFrame | None = None) -> DataFrame:
    """One-pass baseline and verdict of every run (regressed runs stay in the sample of later ones unless ``excluded``)."""
    df = robust_threshold(runtime_samples(runs, value, excluded=excluded, regimes=regimes), "sample", floor)
    return _with_verdict(df, value, least)


def _with_verdict(df: DataFrame, value: str, least: int) -> DataFrame:
    enough = F.size("sample") >= least
    verdict = F.when(~enough, F.lit("insufficient_baseline")).when(F.col(value) > F.col("threshold"), F.lit("regression")).otherwise(F.lit("healthy"))
    for c in ("median", "mad", "threshold", "deciding_term"):
        df = df.withColumn(c, F.when(enough, F.col(c)))
    return df.withColumn("n", F.size("sample")).withColumn("verdict", verdict)


def banded_baseline(runs: DataFrame, floor: float = FLOOR_S, least: int = LEAST, excluded: DataFrame | None = None, regimes: DataFrame | None = None) -> DataFrame:
    """The baseline of every run among those with its metric (execution or total time) and volume band.

    A band with fewer than ``least`` values gives way to all bands of the metric (``band_fallback``). A run without a
    row count has no band and is compared with all.
    """
    df = measured(runs).withColumn("band", volume_band(F.col("input_rows")))
    df = runtime_samples(df, "value", within={"sample": ["metric"], "same_band": ["metric", "band"]}, excluded=excluded, regimes=regimes)
    use_band = F.col("band").isNotNull() & (F.size("same_band") >= least)
    df = df.withColumns({"sample": F.when(use_band, F.col("same_band")).otherwise(F.col("sample")), "band_fallback": F.col("band").isNotNull() & ~use_band}).drop("same_band")
    return _with_verdict(robust_threshold(df, "sample", floor), "value", least)


#: Runs of a job that one task folds, and those of them from which what it leaves is guessed first.
SEGMENT, TAIL = 50_000, 2_000
FOLD_SCHEMA = "run_id string, job_id string, metric string, value double, median double, mad double, threshold double, deciding_term string, n int, band int, band_fallback boolean, verdict string, opens boolean"


def _threshold(sample, floor: float):
    s = sorted(sample)
    n = len(s)
    low, high = (n - 1) // 2, n // 2
    mid = (s[low] + s[high]) / 2
    d = sorted([abs(x - mid) for x in s])
    mad = (d[low] + d[high]) / 2
    name, top = "ratio", RATIO * mid
    if mid + DEVIATIONS * mad > top:
        name, top = "mad", mid + DEVIATIONS * mad
    if mid + floor > top:
        name, top = "floor", mid + floor
    return mid, mad, top, name


def fold_job(rows: list[dict], excluded: set | None = None, closed_until=None, regime_start=None, floor: float = FLOOR_S, history: dict | None = None) -> list[dict]:
    """The sequential rule over one job's runs, ordered by end: regressed runs leave the baseline, healthy ones return.

    The history is the whole job. Eligible runs are kept by metric, and by metric and band, in the order of their ends,
    so those that ended by a start are a prefix that bisection finds. ``history`` is changed in place, so that a later
    call goes on from here. Runs without a start have no sample, those without an end (last in order) are in none.
    """
    excluded, out, history = excluded or set(), [], {} if history is None else history

    def ended(key: tuple, by) -> list:
        ends, values = history.get(key, ((), ()))
        upto = 0 if by is None else bisect_right(ends, by)
        return values[max(0, upto - WINDOW) : upto]

    for r in rows:
        metric, value = ("execution", r["execution_s"]) if r["execution_s"] is not None else ("total", r["duration_s"])
        band, end = r["band"], r["end_time"]
        same = ended((metric, band), r["start_time"]) if band is not None else []
        use_band = len(same) >= LEAST
        sample = same if use_band else ended((metric,), r["start_time"])
        line = {"run_id": r["run_id"], "job_id": r["job_id"], "metric": metric, "value": value, "median": None, "mad": None, "threshold": None, "deciding_term": None, "n": len(sample), "band": band, "band_fallback": band is not None and not use_band, "verdict": "insufficient_baseline", "opens": False}
        if len(sample) >= LEAST and value is not None:
            line["median"], line["mad"], line["threshold"], line["deciding_term"] = _threshold(sample, floor)
            line["verdict"] = "regression" if value > line["threshold"] else "healthy"
        closed = closed_until is not None and end is not None and end <= closed_until
        regressed = line["verdict"] == "regression"
        line["opens"] = regressed and not closed
        inside = regime_start is None or (r["start_time"] is not None and r["start_time"] >= regime_start)
        if r["result_state"] == "SUCCESS" and value is not None and end is not None and inside and not regressed and not (closed and r["run_id"] in excluded):
            for key in ((metric,), (metric, band)):
                ends, values = history.setdefault(key, ([], []))
                ends.append(end)
                values.append(value)
        out.append(line)
    return out


def forget(history: dict, before) -> None:
    """Drops eligible runs that no later run can see whose start is not before an instant: all but the last WINDOW by then."""
    for ends, values in history.values():
        gone = max(0, bisect_right(ends, before) - WINDOW)
        del ends[:gone], values[:gone]


def plain_rows(pdf) -> list[dict]:
    """The rows of a pandas frame with None for what is missing, and whole bands."""
    names, columns = list(pdf.columns), []
    for c in names:
        column, known = pdf[c], pdf[c].notna().to_numpy()
        values = column.to_numpy().astype("datetime64[us]") if column.dtype.kind == "M" else column
        columns.append([v if k else None for v, k in zip(values.tolist(), known, strict=True)])
    rows = [dict(zip(names, r, strict=True)) for r in zip(*columns, strict=True)]
    for r in rows:
        if r["band"] is not None:
            r["band"] = int(r["band"])
    return rows


def folded_frame(lines: list[dict]):
    """Verdicts of the fold as a pandas frame, a column at a time."""
    import pandas as pd

    return pd.DataFrame({c: [r[c] for r in lines] for c in (c.split()[0] for c in FOLD_SCHEMA.split(", "))})


def _told(history: dict) -> str:
    """A history as text; equal histories have equal texts."""
    import pandas as pd

    told = [[list(key), [pd.Timestamp(e).value for e in ends], values] for key, (ends, values) in history.items() if ends]
    return json.dumps(sorted(told, key=lambda t: repr(t[0])), default=float)


def _known(text: str | None) -> dict:
    """The history of a text."""
    import pandas as pd

    return {tuple(key): ([pd.Timestamp(e) for e in ends], values) for key, ends, values in json.loads(text or "[]")}


def _folded(rows: DataFrame, begins: DataFrame, floor: float, lines: bool) -> DataFrame:
    """Each segment (job_id, seg) folded from the history that it begins with: its verdicts and, unless only these ``lines``
    are asked for, one more row with the history that it leaves (``after``; null in verdicts)."""

    def run(key, part, begin):
        import pandas as pd

        part = part.sort_values(["_at", "run_id"], kind="stable")
        some, history = plain_rows(part), _known(begin["before"].iloc[0])
        found = []
        if some:
            first = some[0]
            found = fold_job(some, set(() if first["excluded"] is None else first["excluded"]), first["closed_until"], first["regime_start"], floor, history)
        out = folded_frame(found).assign(seg=int(key[1]), after=None)
        if not lines:
            earliest = begin["earliest"].iloc[0]
            if not pd.isna(earliest):
                forget(history, earliest)
            left = {c: None for c in out.columns} | {"job_id": key[0], "seg": int(key[1]), "after": _told(history)}
            out = pd.concat([out.astype(object), pd.DataFrame([left], dtype=object)])
        return out

    own = begins.select(F.col("job_id").alias("j"), F.col("seg").alias("s"), "before", "earliest")  # names of its own: both come from the same rows
    return rows.groupBy("job_id", "seg").cogroup(own.groupBy("j", "s")).applyInPandas(run, f"{FOLD_SCHEMA}, seg long, after string")


def detect_in_segments(keep: DataFrame, floor: float, size: int) -> DataFrame:
    """The verdicts of jobs of any size: segments of ``size`` runs are folded at once and again where they began wrong.

    A segment first begins with what the last ``TAIL`` runs of the one before leave from an empty history. Where a segment leaves something
    else in the end, the next one is folded again, until every segment began with what the one before it leaves; as
    the first one begins right, all of them did. Old values leave a history soon, so few are folded more than twice.
    """
    at = F.coalesce("end_time", F.to_timestamp(F.lit("2200-01-01 00:00:00")))
    rows = running_number(keep.withColumn("_at", at), ["job_id"], ["_at", "run_id"], F.lit(True), "_n")
    rows = cut(rows.withColumn("seg", F.floor((F.col("_n") - 1) / size)))
    later = W.partitionBy("job_id").orderBy("seg").rowsBetween(1, W.unboundedFollowing)
    bounds = rows.groupBy("job_id", "seg").agg(F.min("start_time").alias("_s")).select("job_id", "seg", F.min("_s").over(later).alias("earliest"))
    begins = cut(bounds.withColumn("before", F.lit(None).cast("string")))
    named = lambda df: df.select(F.col("job_id").alias("j"), F.col("seg").alias("s"))
    same = F.col("job_id").eqNullSafe(F.col("j")) & (F.col("seg") == F.col("s"))
    tails = rows.filter((F.col("seg") == 0) | ((F.col("_n") - 1) % size >= size - TAIL))  # the first segment begins right, so it is folded whole
    folded = cut(_folded(tails, begins, floor, False))
    while True:
        left = folded.filter("after is not null").select(F.col("job_id").alias("j"), (F.col("seg") + 1).alias("s"), F.col("after").alias("told"))
        new = begins.join(left, same, "left")
        new = cut(new.select("job_id", "seg", "earliest", F.col("told").alias("before"), (~F.col("told").eqNullSafe(F.col("before"))).alias("changed")))
        begins, again = new.drop("changed"), new.filter("changed").drop("changed")
        if not again.limit(1).count():
            return folded.filter("after is null").drop("seg", "after")
        redone = _folded(rows.join(named(again), same, "left_semi"), again, floor, False)
        folded = cut(folded.join(named(again), same, "left_anti").unionByName(redone))


def detect_runtime_regressions(runs: DataFrame, regimes: DataFrame | None = None, closed: DataFrame | None = None, active: DataFrame | None = None, floor: float = FLOOR_S, segment: int = SEGMENT) -> DataFrame:
    """Verdict of every run by the sequential rule.

    ``regimes`` (job_id, regime_start), ``closed`` (job_id, closed_until) and ``active`` (job_id, excluded array of run
    ids of open incidents) are optional. The rule is sequential, so a job's runs stream through one task in the order of
    their ends (Spark sorts and spills); the task holds a batch, the eligible runs that a later start can still ask for,
    and a job's ``excluded`` ids, but never a whole job. Jobs of more than ``segment`` runs are folded in segments by many tasks.
    """
    df = runs.withColumn("band", volume_band(F.col("input_rows")))
    for extra, column, kind in ((regimes, "regime_start", "timestamp"), (closed, "closed_until", "timestamp"), (active, "excluded", "array<string>")):
        df = df.join(extra.select("job_id", column), "job_id", "left") if extra is not None else df.withColumn(column, F.lit(None).cast(kind))

    def run(batches):
        job, history, excluded = None, None, set()
        for pdf in batches:
            out = []
            for one, part in groupby(plain_rows(pdf), key=lambda r: r["job_id"]):
                part = list(part)
                first = part[0]
                if history is None or one != job:
                    job, history, excluded = one, {}, set(() if first["excluded"] is None else first["excluded"])
                out += fold_job(part, excluded, first["closed_until"], first["regime_start"], floor, history)
                if part[-1]["earliest"] is not None:
                    forget(history, part[-1]["earliest"])
            if out:
                yield folded_frame(out)

    order = [F.col("end_time").asc_nulls_last(), F.col("run_id")]
    onwards = W.partitionBy("job_id").orderBy(F.col("end_time").desc_nulls_first(), F.desc("run_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    keep = df.select("run_id", "job_id", "start_time", "end_time", "execution_s", "duration_s", "result_state", "band", "regime_start", "closed_until", "excluded")
    large = keep.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > segment).select(F.col("job_id").alias("_j"))
    if large.limit(1).count():
        of_large = F.col("job_id").eqNullSafe(F.col("_j"))
        parts = detect_in_segments(keep.join(large, of_large, "left_semi"), floor, segment)
        small = detect_runtime_regressions_of(keep.join(large, of_large, "left_anti"), run, order, onwards)
        return small.unionByName(parts)
    return detect_runtime_regressions_of(keep, run, order, onwards)


def detect_runtime_regressions_of(keep: DataFrame, run, order: list, onwards) -> DataFrame:
    """Jobs streamed through one task each."""
    keep = keep.repartition("job_id").withColumn("earliest", F.min("start_time").over(onwards))
    return keep.sortWithinPartitions("job_id", *order).mapInPandas(run, FOLD_SCHEMA)


def regime_start(regimes: DataFrame, runs: DataFrame) -> DataFrame:
    """(job_id, regime_start): the latest mark of each job, by instant or by the first run of a commit prefix (7+ chars)."""
    by_time = regimes.filter("mark_at is not null").select("job_id", F.col("mark_at").alias("at"))
    marks = regimes.filter("mark_sha is not null and length(mark_sha) >= 7").select(F.col("job_id").alias("j"), F.lower("mark_sha").alias("mark_sha")).distinct()
    met = runs.join(marks, (F.col("job_id") == F.col("j")) & F.lower("git_sha").startswith(F.col("mark_sha")))
    by_sha = met.groupBy("job_id", "mark_sha").agg(F.min("start_time").alias("at")).select("job_id", "at")
    return by_time.unionByName(by_sha).groupBy("job_id").agg(F.max("at").alias("regime_start"))


def last_healthy_run(runs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Each run with healthy_run_id: the latest successful run of its job that ended by its start and is not excluded.

    Runs and their starts are merged into one ordered stream per job, in slices of time, so no pairs are formed.
    """
    ok = runs.filter("result_state = 'SUCCESS'")
    if excluded is not None:
        ok = ok.join(excluded.select("run_id"), "run_id", "left_anti")
    ends = ok.select("job_id", F.col("end_time").alias("at"), F.lit(0).alias("k"), F.struct("end_time", "run_id").alias("h"), F.lit(None).cast("string").alias("run_id"))
    starts = runs.select("job_id", F.col("start_time").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("struct<end_time:timestamp,run_id:string>").alias("h"), "run_id")
    df = last_known(ends.unionByName(starts), ["job_id"], ["at", "k", F.col("h.run_id")], "h", "best")
    return df.filter("k = 1").select("run_id", "job_id", F.col("best.run_id").alias("healthy_run_id"))


#: What two runs are compared in; a dimension that the runs have no column for is not available.
DIMENSIONS = (
    "git_sha", "job_parameters", "env_hash", "duration_s", "execution_s", "setup_s", "input_rows", "max_key_rows", "median_key_rows", "skew_ratio", "top_key_share", "plan_operators",
    "spill_bytes", "gc_ms",
)
_PLACES = {"duration_s": 1, "execution_s": 1, "setup_s": 1, "skew_ratio": 2, "top_key_share": 4}


def diff_runs(pairs: DataFrame, runs: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """(run_id, dimension, healthy, current, status): differences of each run from its healthy one.

    Times are compared to a tenth of a second, the run's own id among its parameters is not compared.
    """
    kinds = dict(runs.dtypes)
    present = [d for d in dimensions if d in kinds]

    def shown(side: str, d: str) -> Column:
        if d not in kinds:
            return F.lit(None).cast("string")
        value = F.col(f"{side}.{d}")
        if kinds[d].startswith("map"):
            kept = F.array_sort(F.transform(F.map_entries(F.map_filter(value, lambda k, _: k != "run_id")), lambda e: F.concat_ws("=", e["key"], e["value"])))
            return F.nullif(F.array_join(kept, ", "), F.lit(""))
        if kinds[d].startswith("array"):
            return F.nullif(F.array_join(value, ", "), F.lit(""))
        return (F.round(value, _PLACES[d]) if d in _PLACES else value).cast("string")

    def side(name: str, alias: str):
        return runs.select(F.col("run_id").alias(name), F.struct(F.lit(True).alias("_is"), *present).alias(alias))

    # runs are joined as they are; texts of every dimension are made afterwards, row by row
    both = pairs.select("run_id", "healthy_run_id").join(side("run_id", "c"), "run_id").join(side("healthy_run_id", "h"), "healthy_run_id", "left")
    rows = both.select("run_id", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), shown("h", d).alias("healthy"), shown("c", d).alias("current")) for d in dimensions])))
    status = F.when(F.col("healthy").isNull() | F.col("current").isNull(), F.lit("not_available")).when(F.col("healthy") == F.col("current"), F.lit("equal")).otherwise(F.lit("changed"))
    return rows.select("run_id", "dimension", "healthy", "current", status.alias("status"))


def incremental_cost(costs: DataFrame, now: Column, last: int = 5, pending_hours: int = 24) -> DataFrame:
    """Adds baseline_cost, incremental_cost and status of (run_id, job_id, end_time, result_state, cost).

    The baseline is the median of the last five successful earlier runs of the same job.
    """
    good = (F.col("result_state") == "SUCCESS") & F.col("cost").isNotNull()
    # the running number of good runs turns "the last five before" into a lookup among the good ones
    ranked = running_number(costs, ["job_id"], ["end_time", "run_id"], good, "_upto").withColumn("_g", F.col("_upto") - F.when(good, 1).otherwise(0)).drop("_upto")
    good_ones = ranked.filter(good).withColumn("_k", F.col("_g") + 1)
    lasts = last_values(good_ones, ["job_id"], "_k", "cost", last, "_last").select(F.col("job_id").alias("_j"), "_k", "_last")
    df = ranked.join(lasts, (F.col("job_id") == F.col("_j")) & (F.col("_g") == F.col("_k")), "left")
    df = df.withColumn("baseline_cost", median_of(F.col("_last"))).drop("_last", "_g", "_j", "_k")
    fresh = F.col("end_time") > now - F.expr(f"INTERVAL '{pending_hours}' HOUR")
    status = F.when(F.col("cost").isNull() & fresh, F.lit("pending")).when(F.col("cost").isNull() | F.col("baseline_cost").isNull(), F.lit("not_available")).otherwise(F.lit("available"))
    return df.withColumn("status", status).withColumn("incremental_cost", F.when(F.col("status") == "available", F.round(F.col("cost") - F.col("baseline_cost"), 4)))


def cost_regressions(costs: DataFrame, runtime: DataFrame) -> DataFrame:
    """Runs whose cost regressed although their run time did not, by the sequential rule on the cost column."""
    shaped = costs.select("run_id", "job_id", "start_time", "end_time", F.col("cost").alias("execution_s"), F.lit(None).cast("double").alias("duration_s"), "result_state", F.lit(None).cast("bigint").alias("input_rows"))
    verdicts = detect_runtime_regressions(shaped.filter("execution_s is not null"), floor=FLOOR_COST).filter("verdict = 'regression'")
    slow = runtime.filter("verdict = 'regression'").select("run_id")
    return verdicts.join(slow, "run_id", "left_anti").withColumn("metric", F.lit("cost"))


def run_facts(runs: DataFrame, value: str = "duration_s") -> DataFrame:
    """Per job: runs, median, linearly interpolated p95, slowest two values, slowest against p95."""
    by_value = runs.filter(F.col(value).isNotNull()).groupBy("job_id", value).agg(F.count(F.lit(1)).alias("_n"))
    top = by_value.groupBy("job_id").agg(F.max_by("_n", value).alias("_ties"), F.max(value).alias("_top"))
    below = by_value.join(top, "job_id").filter(F.col(value) < F.col("_top")).groupBy("job_id").agg(F.max(value).alias("_below"))
    slowest = top.join(below, "job_id", "left").select("job_id", F.when(F.col("_ties") > 1, F.col("_top")).otherwise(F.col("_below")).alias("second"))
    out = runs.groupBy("job_id").agg(F.count(F.lit(1)).alias("runs"), F.median(value).alias("median"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.max(value).alias("slowest"))
    return out.join(slowest, "job_id", "left").withColumn("factor", F.when(F.col("p95") > 0, F.round(F.col("slowest") / F.col("p95"), 4)))
