"""Shared scratch tables and skew-safe joins for the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Bytes that go to a Python worker at once, about.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session sets none and runs on this machine alone (tests) a temporary folder is made, once for each application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="wirelake-"))


def bounded_batches(spark: SparkSession) -> None:
    """Has the session hand rows to Python workers in batches of about ``BATCH_BYTES``, or of what it is set to if that is less.

    By default a batch may hold 64 MB of texts, of which a task has several copies: in the JVM, as Arrow and as strings in the worker, and of what comes back. Workers stay for
    later tasks and keep what they once took. What rows come out does not depend on batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


class Scratch:
    """Parquet tables of one run in the shared folder.

    A table is committed before it is read, so losing executors afterwards costs nothing but a reread, and lineage is cut. ``drop`` frees those that later
    steps no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished steps: it does so once the driver has collected their plans, which may otherwise take long."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_values(df: DataFrame, key: str, floor: int = 64, share: int = 2000) -> DataFrame:
    """Non-null values of ``key`` that at least max(floor, rows/share) rows hold, as a local DataFrame.

    At most ``share`` values can exist, whatever the input; that bound makes it safe to broadcast them.
    """
    spark = df.sparkSession
    rows = df.count()
    least = max(floor, rows // share)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least)
    return spark.createDataFrame([(r[0],) for r in counts.select(key).collect()], df.select(key).schema)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Joins ``left`` to ``right``, which has at most one row a key, when a few keys may hold most rows of ``left``.

    Rows of hot keys meet a broadcast copy of the at most 2000 matching right rows and stay where they are; the rest is shuffled, no key of it being large.
    """
    hot = hot_values(left, key) if hot is None else hot
    few = F.broadcast(hot)
    return left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how).unionByName(left.join(few, key, "left_anti").join(right, key, how))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
