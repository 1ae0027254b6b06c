"""Shared helpers: table reading, scratch tables, text expressions and the word class."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is these six ASCII characters; a word is a maximal run of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set as Spark's reader sees it (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session of one machine and process (master ``local``) may do without and gets a temporary folder, once a
    session. On a cluster an unset folder is an error, as rows written to local disks would be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="spark-scratch-"))
    return root.rstrip("/")


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a narrow intermediate table to the shared scratch folder and read it back.

    This cuts lineage (a lost executor re-reads the files instead of recomputing), and the columnar files
    are far smaller than what a row checkpoint would store. The folder goes when ``discard`` says so, at the latest when
    the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    folder, system = _folder(spark, path)
    system.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _folder(spark: SparkSession, path: str):
    """A folder and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more; whatever was derived from them is itself written."""
    for df in tables:
        folder, system = _folder(df.sparkSession, df.scratch_path)
        system.delete(folder, True)


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Bounds the Arrow batches that go to Python by bytes (10,000 long texts would be one batch otherwise).

    A session that has a smaller bound keeps it; a text that is larger than the bound makes a batch of its own.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).removesuffix("b")
    if now.isdigit() and int(now) > most:
        conf.set(key, str(most))
    return df


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, SPACE_RUN, -1), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(text, F.lit(WORD_RUN)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
