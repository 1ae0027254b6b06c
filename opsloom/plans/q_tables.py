"""Queries that read back what they wrote: appends, versions, snapshots, availability, durable upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.plans.fixtures import table
from opsloom.registry import query
from opsloom.sources import tables as T
from opsloom.sources import upserts as U
from opsloom.sources.scratch import new_folder


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CAST(NULL AS int) AS version FROM customer")
def appended_aligned(spark, sf_dir):
    """Two appends with a column too many and one too few, and an empty one."""
    path, c = new_folder(spark), table(spark, sf_dir, "customer")
    schema = spark.createDataFrame([], "k long, name string, version int").schema
    T.append_aligned(c.filter("c_custkey % 2 = 0").selectExpr("c_custkey k", "c_name name", "c_acctbal odd"), path, schema)
    T.append_aligned(c.filter("c_custkey % 2 = 1").selectExpr("cast(c_custkey as string) k"), path, schema)
    T.append_aligned(c.limit(0).selectExpr("c_custkey k"), path, schema)
    return T.read_or_empty(spark, path, schema)


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey % 3 = 0")
def newest_version(spark, sf_dir):
    """The last finished version of a read model; a writer that stopped half-way left a folder without its mark."""
    path, o = new_folder(spark), table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_totalprice price")
    T.replace(o, path, "001")
    T.replace(o.filter("k % 3 = 0"), path, "002")
    unfinished = f"{T.replace(o.filter('k % 5 = 0'), path, '003')}/_SUCCESS"
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(unfinished)
    of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, False)
    return T.newest(spark, path, o.schema)


@query("SELECT event_id FROM events")
def absent_table(spark, sf_dir):
    """A table that is not there has no rows, and its schema: nothing is known yet, so every event is new."""
    seen = T.read_or_empty(spark, f"{new_folder(spark)}/none", "event_id bigint")
    return table(spark, sf_dir, "events").join(seen, "event_id", "left_anti").select("event_id")


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier")
def restored_snapshot(spark, sf_dir):
    """A snapshot is taken once; what was changed after it is gone when it is restored."""
    path, s = new_folder(spark), table(spark, sf_dir, "supplier").selectExpr("s_suppkey k", "s_name name")
    s.write.parquet(f"{path}/t")
    T.snapshot(spark, f"{path}/t", f"{path}/b")
    s.selectExpr("k + 1000000 k", "'broken' name").write.mode("append").parquet(f"{path}/t")
    T.snapshot(spark, f"{path}/t", f"{path}/b")
    T.restore(spark, f"{path}/b", f"{path}/t")
    return spark.read.parquet(f"{path}/t")


@query("""SELECT o_custkey AS k, max(o_orderkey) AS last_order, max_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1""")
def durable_upserts(spark, sf_dir):
    """Orders in three batches, the second of them twice: of each customer the newest one stays."""
    path, o = new_folder(spark), table(spark, sf_dir, "orders").selectExpr("o_custkey k", "o_orderkey last_order", "o_orderpriority v")
    for batch in (0, 1, 1, 2):
        U.upsert(o.filter(F.col("last_order") % 3 == batch), path, "k", "last_order", batch, buckets=16)
    return U.current(spark, path, o.schema)
