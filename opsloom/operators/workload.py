"""The monitored analytical workload: daily sales, a light and a heavy variant, dashboard sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME_ROWS = 20_000
#: Values of a customer that one task ranks, and buckets that more of them are cut into.
MOST_VALUES, BUCKETS = 500_000, 256
_KEY = ["customer_id", "_day"]


def _enriched(orders: DataFrame, customers: DataFrame, segments: DataFrame) -> DataFrame:
    """Orders with region, segment, net amount (null where the discount is not known) and the day as a number.

    A missing customer is one customer with an empty id; a missing day is before all others.
    """
    df = orders.join(customers, "customer_id", "left").join(segments, "customer_id", "left")
    day = F.coalesce(F.unix_date("order_date"), F.lit(-(1 << 31)))
    return df.withColumns({"net": F.col("amount") * (1 - F.col("discount_pct") / 100), "customer_id": F.coalesce(F.col("customer_id").cast("string"), F.lit("")), "_day": day})


def numbered_rows(rows: DataFrame, running: bool = True) -> DataFrame:
    """Adds ``seq``, the number of a row among its customer's in order of time and id, and ``running``, the sum of net up to its time.

    A day carries the count and sum of the days before it, so no window holds more than a customer's rows of one day
    or one row a day.
    """
    days = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("s"))
    before = W.partitionBy("customer_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(*_KEY, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"), F.sum("s").over(before).alias("_sum"))
    of_day = W.partitionBy(*_KEY).orderBy("order_ts", "order_id")
    up_to = W.partitionBy(*_KEY).orderBy("order_ts")
    df = rows.withColumns({"_k": F.row_number().over(of_day)} | ({"_r": F.sum("net").over(up_to)} if running else {})).join(days, _KEY)
    df = df.withColumn("seq", F.col("_rows") + F.col("_k"))
    return df.withColumn("running", F.coalesce(F.col("_sum") + F.col("_r"), "_sum", "_r")) if running else df


def recent_extremes(rows: DataFrame, frame: int, most: int) -> DataFrame:
    """Adds ``recent_max`` and ``recent_min``, the extremes of net in the ``frame`` rows of the customer up to each row.

    Rows are cut into blocks of ``frame``. A frame is the end of one block, from its own first row on, and the beginning of
    the next: it takes the running extremes of its last row's block, and of its first row's block from behind. Where no
    customer has more than a frame (``most`` is the largest number of rows), every customer is one block.
    """
    df = rows.withColumn("_block", F.floor((F.col("seq") - 1) / frame))
    ahead = W.partitionBy("customer_id", "_block").orderBy("seq")
    df = df.withColumns({"_high": F.max("net").over(ahead), "_low": F.min("net").over(ahead)})
    if most <= frame:
        return df.withColumnsRenamed({"_high": "recent_max", "_low": "recent_min"})
    behind = W.partitionBy("customer_id", "_block").orderBy(F.desc("seq"))
    many = rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > frame).select("customer_id")  # others are one block
    ends = rows.join(many, "customer_id", "left_semi").withColumn("_block", F.floor((F.col("seq") - 1) / frame))
    ends = ends.select("customer_id", (F.col("seq") + (frame - 1)).alias("seq"), F.max("net").over(behind).alias("_high_0"), F.min("net").over(behind).alias("_low_0"))
    met = df.join(ends, ["customer_id", "seq"], "left")
    return met.withColumns({"recent_max": F.greatest("_high", "_high_0"), "recent_min": F.least("_low", "_low_0")})


def _bucket(cuts: Column, value: Column) -> Column:
    """Number of ascending cuts below a value, in two steps."""
    step = math.isqrt(BUCKETS)
    heads = F.transform(F.sequence(F.lit(1), F.size(cuts), F.lit(step)), lambda i: F.element_at(cuts, i))
    block = F.greatest(F.size(F.filter(heads, lambda c: c < value)) - 1, F.lit(0))
    return block * step + F.size(F.filter(F.slice(cuts, block * step + 1, F.lit(step)), lambda c: c < value))


def value_ranks(rows: DataFrame, most: int) -> DataFrame:
    """Per customer and net amount: dense and percent rank, largest first, unknown amounts last.

    The amounts of a customer with very many different ones are cut at quantiles; counts of the buckets above are the
    offset of the ranks within one. None has more amounts than rows (``most``).
    """
    values = rows.groupBy("customer_id", "net").agg(F.count(F.lit(1)).alias("n"))
    sums = values.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_all"))
    values, parts = values.join(sums, "customer_id"), None
    if most > MOST_VALUES:
        many = sums.filter(F.col("_values") > MOST_VALUES).select("customer_id")
        quantiles = F.percentile_approx("net", [k / BUCKETS for k in range(1, BUCKETS)], 20 * BUCKETS)
        cuts = values.join(many, "customer_id", "left_semi").groupBy("customer_id").agg(F.array_distinct(quantiles).alias("_cuts"))
        place = F.when(F.col("_cuts").isNull(), F.lit(0)).when(F.col("net").isNull(), F.lit(-1)).otherwise(_bucket(F.col("_cuts"), F.col("net")))
        values = values.join(cuts, "customer_id", "left").withColumn("_bucket", place)
        parts = values.filter("_cuts is not null").groupBy("customer_id", "_bucket").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("m"))
        above = W.partitionBy("customer_id").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
        parts = parts.select("customer_id", "_bucket", F.sum("d").over(above).alias("d0"), F.sum("m").over(above).alias("m0"))
    else:
        values = values.withColumn("_bucket", F.lit(0))
    here = W.partitionBy("customer_id", "_bucket").orderBy(F.desc_nulls_last("net"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranked = values.withColumns({"d": F.row_number().over(here), "m": zero(F.sum("n").over(here.rowsBetween(W.unboundedPreceding, -1)))})
    ranked = ranked.withColumns({"d0": F.lit(0), "m0": F.lit(0)}) if parts is None else ranked.join(parts, ["customer_id", "_bucket"], "left")
    pct = F.when(F.col("_all") > 1, (zero(F.col("m0")) + F.col("m")) / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    return ranked.select(F.col("customer_id").alias("_c"), F.col("net").alias("_n"), (zero(F.col("d0")) + F.col("d")).cast("int").alias("rank"), pct.alias("pct"))


def _figures(rows: DataFrame, most: int, frame: int, running: bool) -> DataFrame:
    """Rows with the figures of their customers' windows."""
    df = recent_extremes(numbered_rows(rows, running), frame, most)
    return df.join(value_ranks(rows, most), (F.col("customer_id") == F.col("_c")) & F.col("net").eqNullSafe(F.col("_n")))


def most_rows(orders: DataFrame) -> int:
    """Rows of the customer with the most of them."""
    return orders.groupBy("customer_id").count().agg(F.max("count")).first()[0] or 0


def sales_daily(orders: DataFrame, customers: DataFrame, segments: DataFrame, frame: int = FRAME_ROWS) -> DataFrame:
    """Per day, region and segment: net revenue, orders, customers and extremes of a customer's running figures.

    A row whose discount is not known has no net amount. Equal times share their running sum and equal amounts their
    rank. Every step splits a customer's rows by day, by block or by amount, so one with a large share of all orders is
    no single task; a customer has one region and segment, and ``order_date`` is the day of ``order_ts``. Orders without a
    customer count as one customer's in the running figures and as none in ``customers``; orders without a day are a group.
    """
    return _figures(_enriched(orders, customers, segments), most_rows(orders), frame, True).groupBy("order_date", "region", "segment").agg(
        F.sum("net").alias("revenue"), F.count(F.lit(1)).alias("orders"), F.countDistinct(F.nullif("customer_id", F.lit(""))).alias("customers"), F.max("running").alias("max_running"), F.max("recent_max").alias("max_recent"),
        F.min("recent_min").alias("min_recent"), F.max("seq").cast("int").alias("max_seq"), F.max("rank").alias("ticket_levels"), F.avg("pct").alias("avg_pct"),
    )


def sales_daily_light(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Per day and region: revenue, orders, customers."""
    return orders.join(customers, "customer_id", "left").groupBy("order_date", "region").agg(F.sum("amount").alias("revenue"), F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_id").alias("customers"))


def sales_daily_heavy(orders: DataFrame, customers: DataFrame, segments: DataFrame, frame: int = FRAME_ROWS) -> DataFrame:
    """The daily figures by segment with a sequence, a sliding maximum and a rank a customer; what it does not show is not made."""
    return _figures(_enriched(orders, customers, segments), most_rows(orders), frame, False).groupBy("order_date", "region", "segment").agg(
        F.sum("net").alias("revenue"), F.count(F.lit(1)).alias("orders"), F.countDistinct(F.nullif("customer_id", F.lit(""))).alias("customers"), F.max("seq").cast("int").alias("max_seq"), F.max("recent_max").alias("max_recent"), F.max("rank").alias("ticket_levels"),
    )


def revenue_by(daily: DataFrame, column: str) -> DataFrame:
    """Dashboard sums of revenue by one column of a daily table."""
    return daily.groupBy(column).agg(F.sum("revenue").alias("revenue"))
