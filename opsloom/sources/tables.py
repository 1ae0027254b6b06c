"""Reading and writing tables: aligned appends, versioned replacement, snapshots, availability, JSON profiles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE_SCHEMA = "run_id string, git_sha string, profiled_at string, key string, left_rows bigint, right_rows bigint, distinct_keys bigint, max_key_rows bigint, median_key_rows bigint, skew_ratio double, top_key_share double, hot_key string, physical_plan string, plan_operators array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at a path; any other fault than a path that is not there is an error."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order: missing ones null, unknown ones dropped, types cast."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_aligned(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append to a Parquet table; nothing to append writes nothing."""
    if not df.isEmpty():
        aligned(df, schema).write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, version: str) -> str:
    """Write a read model as a new version beside the old ones and return its path; readers take the newest (``newest``)."""
    out = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(out)
    return out


def newest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of the version that ``replace`` finished last (versions in order of their names); none where there is none.

    A version without the mark of a finished write is passed over.
    """
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = of(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(folder)] if system.exists(folder) else []
    done = sorted(p.getName() for p in found if p.getName().startswith("version=") and system.exists(of(p, "_SUCCESS")))
    return read_or_empty(spark, f"{path.rstrip('/')}/{done[-1]}" if done else f"{path.rstrip('/')}/none", schema)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or no rows of its schema when it is not there."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return aligned(spark.read.parquet(path), schema) if exists(spark, path) else spark.createDataFrame([], schema)


def source_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(source, available): which tables can be read; one that cannot means "not evaluated", not an error."""
    return spark.createDataFrame([(name, exists(spark, path)) for name, path in sorted(paths.items())], "source string, available boolean")


def snapshot(spark: SparkSession, path: str, backup: str) -> None:
    """Copy a table once; an existing copy is kept."""
    if not exists(spark, backup):
        spark.read.parquet(path).write.parquet(backup)


def restore(spark: SparkSession, backup: str, path: str) -> None:
    spark.read.parquet(backup).write.mode("overwrite").parquet(path)


def run_profiles(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON profiles with the file they came from and the time they were read."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PROFILE_SCHEMA).json(path).select("*", F.col("_metadata.file_path").alias("source_ref"), F.current_timestamp().alias("ingested_at"))
