"""Mixing sources to target weights by hash-threshold histograms (operator 6, DataFrame functions only).

Every document gets a 60-bit hash. A source that must give ``target`` words takes each document
``floor(target / source_size)`` times and once more those whose hash lies below a threshold. The threshold is
found without sorting: words are summed by (source, 12-bit hash bucket), the bucket in which the budget falls is
found by a running sum over at most 4096 rows a source, and only that boundary bucket is split again by the next
12 bits, until it holds one document, or the copies of one (rows that share all 60 bits). Of m such copies the mix takes the k
that end nearest to the target: they are numbered as they were written, by counts a partition and a row number in it.

Defined results: a null text has size 0 and is never taken; null sources form one source that sorts last; repeated
rows have one hash and are treated alike, but for those at the boundary, of which k are taken once more than the others
(which ones follows from the order of the files if they differ in other columns); an empty table gives an empty
result. Only ``doc_id``, ``text`` and
``source`` are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import n_words_of, table, text_of, written

#: Weights of the sources in code-point order, repeating; share of all words that the mix takes; repeats allowed.
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
BITS_PER_LEVEL = 12
LEVELS = 5
HASH_BITS = BITS_PER_LEVEL * LEVELS


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share=BUDGET_SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Targets share the budget by weight, stop at ``max_repeats`` times the source and hand the excess on by weight
    until none is above. The fixed point is ``min(cap, level * weight)``: with sources ordered by cap / weight, the
    level is the first one at which the next source is not capped. One row a source: the window sees the
    aggregated table only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(max_repeats))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * budget_share).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("nth", F.row_number().over(by_ratio))
    s = s.withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("first"), F.lit(float("inf"))) * F.col("weight"))
    return s.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright(F.col("h"), HASH_BITS - BITS_PER_LEVEL * (level + 1))


def hash_of(doc_id: Column, text: Column) -> Column:
    """The 60-bit hash of a row."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - HASH_BITS)


def limits_of(rows: DataFrame, weights=WEIGHTS, budget_share=BUDGET_SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """(s, source_size, target, base, threshold) of each source, from rows of (source, size, h)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = source_targets(sizes, weights, budget_share, max_repeats)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = state.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    # prefix: the boundary bucket so far; below: words of the documents under it; many: documents in it
    state = written(state.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "inside": F.col("source_size"), "many": F.lit(2).cast("long")}))
    level = 0
    while level < LEVELS and state.filter("many > 1").limit(1).count():
        live = state.filter("many > 1").select(F.col("source").alias("s"), "prefix")
        at_boundary = F.col("source").eqNullSafe(F.col("s")) & ((_bucket(level - 1) if level else F.lit(0).cast("long")) == F.col("prefix"))
        sums = rows.join(live, at_boundary, "inner").groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        running = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", running).withColumnRenamed("source", "s")
        met = state.filter("many > 1").join(sums, F.col("source").eqNullSafe(F.col("s")), "inner")
        # The boundary bucket is the first whose running sum reaches the rest, or the last one of the source.
        hit = F.when(F.col("below") + F.col("upto") >= F.col("rest"), F.struct(F.lit(0).alias("k"), F.col("bucket").alias("o"), "bucket", "words", "docs", "upto"))
        miss = F.struct(F.lit(1).alias("k"), (-F.col("bucket")).alias("o"), "bucket", "words", "docs", "upto")
        keys = ["source", "source_size", "weight", "target", "base", "rest", "below"]
        found = met.groupBy(*keys).agg(F.min(F.coalesce(hit, miss)).alias("b"))
        refined = found.select(*[k for k in keys if k != "below"], F.col("b.bucket").alias("prefix"), (F.col("below") + F.col("b.upto") - F.col("b.words")).alias("below"), F.col("b.words").alias("inside"), F.col("b.docs").alias("many"))
        # a boundary that one document fills is settled: widen it to the full 60 bits so that all rows share one scale
        shift = HASH_BITS - BITS_PER_LEVEL * (level + 1)
        settled = state.filter("many <= 1").select(refined.columns + ["low", "high"]) if "low" in state.columns else None
        new = refined.withColumns({"low": F.shiftleft("prefix", shift), "high": F.shiftleft(F.col("prefix") + 1, shift)})
        state = written(new.unionByName(settled) if settled is not None else new)
        level += 1
    if "low" not in state.columns:  # an empty table
        state = state.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long")})
    # a single document at the boundary is taken when that ends nearer to the target, and k of m copies likewise
    take_it = 2 * (F.col("rest") - F.col("below")) >= F.col("inside")
    copies = F.col("many") > 1
    threshold = F.when(take_it & ~copies, F.col("high")).otherwise(F.col("low"))
    k = F.least(F.greatest(F.round((F.col("rest") - F.col("below")) * F.col("many") / F.col("inside")), F.lit(0)), F.col("many")).cast("long")
    edge = F.when(copies & (F.col("inside") > 0), F.col("low"))
    return state.select(F.col("source").alias("s"), "source_size", "target", "base", threshold.alias("threshold"), edge.alias("edge"), k.alias("k"))


def _copies(more: Column) -> Column:
    return F.when(F.col("size") > 0, F.col("base") + more.cast("long")).otherwise(F.lit(0)).cast("long")


def with_copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds source_size, target and copies (how often the mix takes the row) to rows with source, size and h."""
    joined = rows.join(limits, F.col("source").eqNullSafe(F.col("s")), "left")
    names = [*rows.columns, "source_size", "target"]
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    plain = joined.filter(~at_edge).select(*names, _copies(F.col("h") < F.col("threshold")).alias("copies"))
    if not limits.filter("edge is not null").limit(1).count():
        return plain
    # rows at the edge are numbered in two steps, so that no task has to hold them all
    edge = written(joined.filter(at_edge).select(*names, "s", "base", "k", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = edge.groupBy("s", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col("s").alias("s2"), F.col("part").alias("p2"), F.coalesce(before, F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("s", "part").orderBy("at"))
    met = edge.withColumn("part", part).withColumn("nth", nth).join(offsets, F.col("s").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    return plain.unionByName(met.select(*names, _copies(F.col("offset") + F.col("nth") <= F.col("k")).alias("copies")))


def mix(docs: DataFrame, weights=WEIGHTS, budget_share=BUDGET_SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document), taken."""
    rows = written(docs.select("doc_id", "source", n_words_of(text_of()).alias("size"), hash_of(F.col("doc_id"), text_of()).alias("h")))
    out = with_copies(rows, limits_of(rows, weights, budget_share, max_repeats))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them, which may be never.

    The limits (one row a source) are joined to the documents; the copies follow from a row's own hash.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "source", n_words_of(text_of()).alias("size"), hash_of(F.col("doc_id"), text_of()).alias("h"))
    taken = with_copies(rows, limits_of(written(rows.drop("row")))).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in names])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
