"""Upserts into Parquet that survive a killed writer and a batch that comes twice.

A table is cut into buckets by its key. A batch rewrites the buckets that it touches, beside the old ones, and then
publishes one numbered pointer file that names the folder of every bucket and the last batch of every writer. A reader takes
the newest pointer; what no pointer names was never finished and is not read. Two writers that race for the same
number cannot both publish.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
POINTERS = "_pointers"


def _files(spark: SparkSession, path: str):
    """File system and path class of a path."""
    context = spark.sparkContext
    of = context._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(context._jsc.hadoopConfiguration()), of


def pointer(spark: SparkSession, path: str) -> dict:
    """The newest pointer: number, buckets (bucket -> folder), last (writer -> batch); number 0 of a table that is not there."""
    system, of = _files(spark, path)
    folder = of(f"{path}/{POINTERS}")
    if not system.exists(folder):
        return {"number": 0, "buckets": {}, "last": {}}
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    newest = max((n for n in names if n.endswith(".json")), default=None)
    if newest is None:
        return {"number": 0, "buckets": {}, "last": {}}
    return json.loads(spark.read.text(f"{path}/{POINTERS}/{newest}", wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, found: dict) -> None:
    """Make a pointer the newest one; an error if another writer was first."""
    system, of = _files(spark, path)
    name = f"{path}/{POINTERS}/{found['number']:012d}.json"
    draft = of(f"{path}/{POINTERS}/.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    if system.exists(of(name)) or not system.rename(draft, of(name)):
        system.delete(draft, False)
        raise RuntimeError(f"another writer has published {name}")


def current(spark: SparkSession, path: str, schema: T.StructType | str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the newest pointer (of some buckets); none of a table that is not there."""
    named = pointer(spark, path)["buckets"]
    folders = [f"{path}/{f}" for b, f in named.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, path: str, key: str, order: str, batch_id: int, writer: str = "batch", insert_only: bool = False, buckets: int = BUCKETS) -> bool:
    """Put a batch into the table; False if this writer's batch is in it already.

    Of the rows of a key the one with the largest ``order`` stays, a newer batch before an older one on ties; with
    ``insert_only`` the row that is there stays. A null key is a key.
    """
    spark, found = batch.sparkSession, pointer(batch.sparkSession, path)
    if batch_id <= found["last"].get(writer, -1):
        return False
    bucket = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most the buckets
    rest = [c for c in batch.columns if c not in (key, order)]
    old = current(spark, path, batch.schema, touched).withColumn("_new", F.lit(insert_only))
    both = old.unionByName(batch.withColumn("_new", F.lit(not insert_only)))
    # of equal rows any one will do, of others the order decides, and the side on ties
    rank = F.struct(F.lit(0) if not insert_only else F.col("_new").cast("int"), F.col(order), F.col("_new"), F.to_json(F.struct(*rest)) if rest else F.lit(""))
    best = both.groupBy(key).agg(F.max_by(F.struct(order, *rest), rank).alias("_r")).select(key, "_r.*").select(*batch.columns)
    folder = f"data/{batch_id}-{uuid.uuid4().hex}"
    best.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    named = found["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
    publish(spark, path, {"number": found["number"] + 1, "buckets": named, "last": found["last"] | {writer: batch_id}})
    return True


def stream_into(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, writer: str = "stream", buckets: int = BUCKETS) -> None:
    """Drain a stream into the table, batch by batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, key, order, batch_id, writer, buckets=buckets)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def swept(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest pointers and the folders that none of those names; how many folders went."""
    system, of = _files(spark, path)
    names = sorted(s.getPath().getName() for s in system.listStatus(of(f"{path}/{POINTERS}")) if s.getPath().getName().endswith(".json"))
    used = set()
    for n in names[-keep:]:
        used |= {f.split("/")[1] for f in json.loads(spark.read.text(f"{path}/{POINTERS}/{n}", wholetext=True).first()[0])["buckets"].values()}
    for n in names[:-keep]:
        system.delete(of(f"{path}/{POINTERS}/{n}"), False)
    gone = [s.getPath() for s in system.listStatus(of(f"{path}/data")) if s.getPath().getName() not in used]
    for p in gone:
        system.delete(p, True)
    return len(gone)
