"""Choosing and combining documents: seeded samples, caps, unions, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: str, seed: int = 42) -> Column:
    """A fixed shuffled order: the MD5 of the seed and the key."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows if there are at most ``n``, else ``n`` of them in the seeded order."""
    return rows.orderBy(seeded_order(key, seed), key).limit(n)


def shuffle_take(rows: DataFrame, key: str, text_col: str, cap: int = 2000, min_chars: int = 80, seed: int = 42) -> DataFrame:
    """The first ``cap`` rows of long enough text in the seeded order."""
    return sample(rows.where(F.length(F.btrim(F.col(text_col))) >= min_chars), key, cap, seed)


def cap_chunks(chunks: DataFrame, order: list[Column], cap: int = 1000) -> DataFrame:
    return chunks.orderBy(*order).limit(cap)


def union_sources(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def count_by_type(chunks: DataFrame, type_col: str = "doc_type") -> DataFrame:
    return chunks.groupBy(F.coalesce(type_col, F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"))


def summary(chunks: DataFrame, by: str) -> DataFrame:
    """Rows per value and, with a null value and ``total`` 1, of all."""
    return chunks.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).cast("int").alias("total"))


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of the smallest ``order`` for each key; null keys count as one key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``existing``."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def running_index(rows: DataFrame, order: str, name: str) -> DataFrame:
    """A dense 0-based index over the whole table.

    The rows are range-partitioned, counted by partition and numbered within each, so that no task
    sees more than a share of them.
    """
    from ..session import materialize

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(rows.repartitionByRange(n, F.col(order)).withColumn("_part", F.spark_partition_id()), "indexed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.join(F.broadcast(shifts), "_part").withColumn(name, place + F.col("_shift")).drop("_part", "_shift")


def ingest_batches(rows: DataFrame, order: str, size: int = 16) -> DataFrame:
    return running_index(rows, order, "_index").withColumn("batch_no", F.floor(F.col("_index") / size)).drop("_index")


def progress(batches: DataFrame, size: int = 16, batch: str = "batch_no", seconds: float | None = None) -> DataFrame:
    """(batch_no, n_batches, added, total, pct, eta_s) of numbered rows: what is done after each batch.

    ``seconds`` is what a batch takes; without it ``eta_s`` is null.
    """
    count = batches.count()
    out = batches.select(F.col(batch).alias("batch_no")).distinct().withColumn("total", F.lit(count).cast("long"))
    added = F.least((F.col("batch_no") + 1) * size, F.col("total"))
    n = F.ceil(F.col("total") / size)
    eta = F.lit(seconds).cast("double") * (F.col("batch_no") + 1) / F.greatest(added, F.lit(1)) * (F.col("total") - added)
    return out.select("batch_no", n.alias("n_batches"), added.alias("added"), "total", F.round(100.0 * added / F.col("total"), 1).alias("pct"), eta.alias("eta_s"))
