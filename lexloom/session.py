"""Session helpers: table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is missing (tests, a laptop) a local folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: the folder's owner cleans up
        pass


_MADE: list[str] = []


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables made so far; DataFrames that read them can't be used any more. For long sessions."""
    while _MADE:
        _remove(spark, _MADE.pop())


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage; the table outlives any executor and goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom/{os.getpid()}-{uuid.uuid4().hex[:12]}/{name}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    if not _MADE:
        atexit.register(release, spark)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, key: str, count: int, most: int) -> DataFrame:
    """At most ``most`` of ``count`` rows, by a hash of the key; all if there are no more."""
    if count <= most:
        return rows
    slots = 1 << 30
    # a little less than asked for, so that the limit is seldom reached
    return rows.where(F.pmod(F.xxhash64(key), F.lit(slots)) < int(0.95 * slots * most / count)).limit(most)
