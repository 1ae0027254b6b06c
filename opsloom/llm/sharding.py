"""Sharding by balanced label propagation (operator 3, DataFrame functions only). Law: ``rows``.

Documents with equal texts are linked. The labels start feasible: groups lie behind one another and fill the shards in
proportion to their room, so a group begins whole unless a shard ends inside it; the largest groups (more than a quarter of a
shard, so fewer than ``4 * shards`` whatever the data) are seeded first, whole in one shard where they fit, else in as
few as can hold them. Then all linked rows move, in rounds of Spark joins, to the shard where most of their group is;
ties go to a shard that the group's hash picks, so that groups spread. A round's moves between two shards are limited
by quotas (an 8 x 8 table computed from the demand counts) so that no shard ever holds more rows than its even share. Rows
without a link have no edge to cut and fill the shards up at the end, so row counts differ by one at most.

Numbers without gaps come from counts of buckets of 16384 rows, their running sum and a row number in each bucket:
no task sees a whole shard.

Defined results: a null text has size 1 and crc32 0 and is linked with nothing; an empty text is a text; repeated rows are rows
of their own; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import table, text_of, written

SHARDS = 8
BUCKET_ROWS = 16_384
ROUNDS = 6


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within equal keys, in the order of the dense row index ``idx``."""
    df = df.withColumn("_b", F.floor(F.col("idx") / BUCKET_ROWS))
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1) if keys else W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("idx")) - 1
    return df.withColumn("_r", here).join(offsets, [*keys, "_b"]).withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")


def indexed(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``idx``, a dense index of the rows in the order of a hash."""
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    h = F.xxhash64("doc_id", "size", "text_crc32", "group")
    df = rows.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    counts = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    here = F.row_number().over(W.partitionBy("_b").orderBy("_h", "doc_id", "size", "text_crc32")) - 1
    return df.withColumn("_r", here).join(offsets, "_b").withColumn("idx", F.col("_o") + F.col("_r")).drop("_h", "_b", "_o", "_r")


def quotas(demand: dict[tuple[int, int], int], held: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Most moves i -> j, at most the demand, after which no shard holds more than its capacity."""
    x = dict(demand)
    shards = range(len(held))
    while True:
        over = {j: held[j] + sum(v for (a, b), v in x.items() if b == j) - sum(v for (a, b), v in x.items() if a == j) - capacity[j] for j in shards}
        worst = max(shards, key=lambda j: over[j])
        if over[worst] <= 0:
            return x
        left, inflow = over[worst], sorted((k for k in x if k[1] == worst), key=lambda k: (-x[k], k))
        total = sum(x[k] for k in inflow)
        for k in inflow:
            cut = min(x[k], left, math.ceil(over[worst] * x[k] / total)) if total else 0
            x[k] -= cut
            left -= cut


def packed(sizes: dict[str, int], room: list[int]) -> dict[str, list[tuple[int, int]]]:
    """(shard, rows) parts of each group, largest group first; takes the rows out of ``room``.

    A part goes to the fullest shard that can hold it; what no shard can hold fills up the emptiest one first.
    """
    parts = {}
    for group, left in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        parts[group] = []
        while left:
            fitting = [j for j in range(len(room)) if room[j] >= left]
            j = min(fitting, key=lambda j: (room[j], j)) if fitting else max(range(len(room)), key=lambda j: (room[j], -j))
            parts[group].append((j, min(left, room[j])))
            left -= parts[group][-1][1]
            room[j] -= parts[group][-1][1]
    return parts


def shares(many: int, room: list[int]) -> list[int]:
    """``many`` rows dealt over the shards in proportion to their room."""
    ends, total = [], 0
    for r in room:
        total += r
        ends.append(many * total // max(1, sum(room)))
    return [b - a for a, b in zip([0, *ends], ends)]


def offsets(groups: DataFrame) -> DataFrame:
    """group, offset: rows of the groups before each one, in the order of a hash."""
    buckets = max(1, math.ceil(groups.count() / BUCKET_ROWS))
    df = groups.withColumn("_h", F.xxhash64("group")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = df.groupBy("_b").agg(F.sum("many").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    here = F.coalesce(F.sum("many").over(W.partitionBy("_b").orderBy("_h", "group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_i", here).join(before, "_b").select("group", (F.col("_o") + F.col("_i")).alias("offset"))


def _cases(value: Column, limits: list[tuple[int, int]]) -> Column:
    """The label of the first (upper bound, label) above the value."""
    out = F.lit(None).cast("int")
    for upto, label in reversed(limits):
        out = F.when(value < upto, F.lit(label)).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    text = text_of()
    group = F.when(F.col("text").isNotNull(), F.concat_ws("-", F.hex(F.xxhash64("text")), F.hex(F.crc32(text.cast("binary"))), F.octet_length("text").cast("string")))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group.alias("group")))
    n = rows.count()
    capacity = [n // shards + (j < n % shards) for j in range(shards)]
    rows = written(indexed(rows, n))
    groups = rows.filter("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    groups = written(groups)
    quarter = max(1, n // (4 * shards))
    large, room = {r["group"]: r["many"] for r in groups.filter(F.col("many") > quarter).collect()}, list(capacity)
    steps = []
    for key, parts in packed(large, room).items():
        total = 0
        for j, k in parts:
            steps.append((key, total, total + k, j))
            total += k
    small = groups.filter(F.col("many") <= quarter)
    total, limits = 0, []
    for j, k in enumerate(shares(small.agg(F.sum("many")).first()[0] or 0, room)):
        total += k
        limits.append((total, j))
    linked = rows.join(groups.join(offsets(small), "group", "left"), "group").select("idx", F.col("group").alias("key"), "many", "offset")
    ranked = numbered(linked, ["key"], "_k")
    spans = F.broadcast(docs.sparkSession.createDataFrame(steps, "key string, low long, high long, shard int"))
    seeds = ranked.filter(F.col("many") > quarter).join(spans, "key").filter("_k >= low and _k < high").select("idx", "key", "shard")
    dealt = ranked.filter(F.col("many") <= quarter).select("idx", "key", _cases(F.col("offset") + F.col("_k"), limits).alias("shard"))
    state = written(dealt.unionByName(seeds))
    for _ in range(rounds):
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        votes = state.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("votes"))
        favoured = F.struct("votes", F.pmod(F.xxhash64("key") + F.col("shard"), F.lit(shards)), "shard")
        wanted = votes.groupBy("key").agg(F.max(favoured).getField("shard").alias("target"))
        movers = written(state.join(wanted, "key").filter("shard <> target").select("idx", "shard", "target"))
        demand = {(r["shard"], r["target"]): r["n"] for r in movers.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()}
        allowed = quotas(demand, [held.get(j, 0) for j in range(shards)], capacity)
        if not sum(allowed.values()):
            break
        quota = F.lit(0)
        for (i, j), v in allowed.items():
            quota = F.when((F.col("shard") == i) & (F.col("target") == j), F.lit(v)).otherwise(quota)
        moved = numbered(movers, ["shard", "target"], "_k").filter(F.col("_k") < quota).select("idx", "target")
        state = written(state.join(moved, "idx", "left").select("idx", "key", F.coalesce("target", "shard").alias("shard")))
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    limits, total = [], 0
    for j in range(shards):
        total += capacity[j] - held.get(j, 0)
        limits.append((total, j))
    placed = rows.join(state.select("idx", "shard"), "idx", "left").select("idx", "doc_id", "size", "text_crc32", "shard")
    placed = written(placed)
    free = numbered(placed.filter("shard is null").drop("shard"), [], "_k").withColumn("shard", _cases(F.col("_k"), limits)).drop("_k")
    both = written(placed.filter("shard is not null").unionByName(free))
    return numbered(both, ["shard"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
