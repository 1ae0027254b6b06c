"""Running figures of a key in order of time, cut so that a key with a large share of the rows is many tasks.

A key's rows are cut into slices of time. A slice is a window of its own; what it must know of the slices before it (how
many, or the last ones) is summed up a slice and handed on. Lists of the last k values are cut into blocks of the dense
running number, each of which begins with the last k - 1 values of the block before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days in a slice, and values in a block.
SLICE_DAYS, BLOCK = 30, 50_000


def _slice(at: str) -> Column:
    """Number of the slice of an instant; a missing one comes before all others."""
    return F.coalesce(F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / F.lit(SLICE_DAYS * 86_400)), F.lit(-(1 << 40)))


def _same(keys: list[str], renamed: str) -> Column:
    """Null-safe equality of keys with their renamed copies."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{renamed}{k}"))
    return out


def _handed_on(df: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their slice is told (``per`` has keys, _slice and other columns); none for the first slice."""
    both = [*keys, "_slice"]
    told = per.select(*[F.col(c).alias(f"_o_{c}") if c in both else F.col(c) for c in per.columns])
    return df.join(told, _same(both, "_o_"), "left").drop(*[f"_o_{c}" for c in both])


def running_number(df: DataFrame, keys: list[str], order: list, flag: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the key have the flag up to and with this one. The first of ``order`` is the time."""
    rows = df.withColumns({"_slice": _slice(order[0]), "_flag": F.when(flag, 1).otherwise(0)})
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    per = rows.groupBy(*keys, "_slice").agg(F.sum("_flag").alias("_f")).select(*keys, "_slice", F.sum("_f").over(before).alias("_before"))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _handed_on(rows.withColumn("_inside", F.sum("_flag").over(inside)), per, keys)
    return out.withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_slice", "_flag", "_inside", "_before")


def last_known(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the last value of the key, up to and with this row, that is not null."""
    rows = df.withColumn("_slice", _slice(order[0]))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    rows = rows.withColumn("_inside", F.last(value, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # the last of a slice: of its rows with a value the one behind the most others
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(inside))
    ends = ranked.groupBy(*keys, "_slice").agg(F.max_by(value, "_k").alias("_end"))
    all_slices = rows.select(*keys, "_slice").distinct()
    told = _handed_on(all_slices, ends, keys)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    per = told.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    return _handed_on(rows, per, keys).withColumn(name, F.coalesce("_inside", "_before")).drop("_slice", "_inside", "_before")


def last_values(df: DataFrame, keys: list[str], number: str, value: str, k: int, name: str, block: int | None = None) -> DataFrame:
    """Adds ``name``: the values of the last k rows, this one last; ``number`` is 1, 2, 3, ... within a key."""
    size = max(block or BLOCK, k)
    at = F.floor((F.col(number) - 1) / size)
    late = (F.col(number) - 1) % size >= size - (k - 1)
    homes = F.when(late, F.array(at, at + 1)).otherwise(F.array(at)) if k > 1 else F.array(at)
    rows = df.withColumn("_home", at).withColumn("_block", F.explode(homes))
    near = W.partitionBy(*keys, "_block").orderBy(number).rowsBetween(-(k - 1), 0)
    return rows.withColumn(name, F.collect_list(value).over(near)).filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def _slice_tails(ends: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The last k rows of each slice of a key."""
    latest = W.partitionBy(*keys, "_slice").orderBy(*[F.desc(c) for c in order])
    return ends.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= k).drop("_back")


def _before_slices(tails: DataFrame, asked: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """keys, _slice, order and value: the last k rows before each slice that is asked for (keys, _slice), from the tails of all slices."""
    by_slice = W.partitionBy(*keys).orderBy("_slice")
    lists = tails.groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_t"))
    near = F.flatten(F.collect_list("_t").over(by_slice.rowsBetween(-(k - 1), 0)))  # a slice has one row at least
    upto = lists.withColumn("_t", F.slice(near, F.greatest(F.size(near) - k, F.lit(0)) + 1, k)).withColumn("_asked", F.lit(False))
    both = upto.unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    per = both.groupBy(*keys, "_slice").agg(F.first("_t", ignorenulls=True).alias("_t"), F.max("_asked").alias("_asked"))
    told = per.withColumn("_b", F.last("_t", ignorenulls=True).over(by_slice.rowsBetween(W.unboundedPreceding, -1))).filter("_asked")
    return told.select(*keys, "_slice", F.inline("_b"))


def values_before(rows: DataFrame, ends: DataFrame, names: dict[str, list[str]], order: list[str], value: str, k: int) -> DataFrame:
    """Adds for each name the values, not null, of the last k ``ends`` before the row that have its keys, latest first.

    Both have the keys and ``order``, the time first. A name's keys hold those of the names before it, so that rows and
    ends are dealt once, by the first name's keys and the slice. What a slice must know of those before it, k ends a
    name, comes into it as rows of its own.
    """
    rows, ends = rows.withColumns({"_slice": _slice(order[0]), "_row": F.lit(True)}), ends.withColumn("_slice", _slice(order[0]))
    every = [rows, ends.withColumns({f"_v_{name}": F.col(value) for name in names}).drop(value)]
    tails = ends
    for name, keys in reversed(names.items()):
        tails = _slice_tails(tails, keys, order, k)
        every.append(_before_slices(tails, rows.select(*keys, "_slice").distinct(), keys, order, value, k).withColumnRenamed(value, f"_v_{name}"))
    out = every[0]
    for part in every[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for name, keys in names.items():
        placed = W.partitionBy(*keys, "_slice").orderBy(*order)
        lags = [F.expr(f"lag(`_v_{name}`, {i}) ignore nulls").over(placed) for i in range(1, k + 1)]
        out = out.withColumn(name, F.array_compact(F.array(*lags)))
    return out.filter("_row").drop("_row", "_slice", *[f"_v_{name}" for name in names])
