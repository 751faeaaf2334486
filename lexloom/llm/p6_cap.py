"""Capping the rows of each dominant contributor.

Only contributors above the cap are ranked: at most 1 / share of them exist. Their rows are cut
into slices of the ranking order (range partitioning by contributor, quality and id), ranked
within each slice and shifted by the number of rows in the slices before it, so that a contributor
with a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def over_cap(rows: DataFrame, scores: DataFrame, contributor: tuple[str, ...] = ("source", "doc_type"), id_col: str = "ingest_pos", quality_col: str = "quality", share: str | None = "0.03", max_rows: int | None = None, slices: int | None = None) -> DataFrame:
    """(id, rank, cap) of the rows beyond the cap of their contributor; the others are kept.

    The cap is floor(share x rows of the table), or ``max_rows``, or the lesser if both are given.
    Rows rank by quality, highest first; null, NaN and missing qualities come last; ties go to the
    smaller id. A null in the first contributor column exempts a row; in the others null is a value
    of its own. Of repeated scores the highest counts. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    names = [f"by_{i}" for i in range(len(contributor))]
    keys = rows.select(F.col(id_col).alias("id"), *(F.col(c).alias(n) for c, n in zip(contributor, names)))
    total = keys.count()
    caps = [x for x in (max_rows, share and Fraction(share) * total // 1) if x is not None]
    if not caps:
        raise ValueError("give share, max_rows or both")
    cap = int(min(caps))
    full = keys.where(F.col("by_0").isNotNull()).groupBy(*names).count().where(F.col("count") > cap).select(F.xxhash64(*names, *(F.col(n).isNull() for n in names)).alias("who"), *names)
    # with a share, fewer than 1 / share contributors can be above the cap
    small = share is not None and cap == int(Fraction(share) * total // 1)
    on = [keys["by_0"] == full["by_0"], *(keys[n].eqNullSafe(full[n]) for n in names[1:])]
    ranked = keys.join(F.broadcast(full) if small else full, on).select("id", "who")
    best = scores.select(F.col(id_col).alias("id"), F.nanvl(F.col(quality_col).cast("double"), F.lit(None).cast("double")).alias("quality")).groupBy("id").agg(F.max("quality").alias("quality"))
    ranked = ranked.join(best, "id", "left")
    order = [F.col("quality").desc_nulls_last(), F.col("id").asc_nulls_last()]
    n = slices or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = materialize(ranked.repartitionByRange(n, F.col("who"), *order).withColumn("slice", F.spark_partition_id()), "sliced")
    before = Window.partitionBy("who").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sliced.groupBy("who", "slice").count().select("who", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    # range partitions are contiguous, so there are fewer slices than n + contributors
    placed = sliced.join(F.broadcast(shifts) if small else shifts, ["who", "slice"])
    rank = F.row_number().over(Window.partitionBy("who", "slice").orderBy(*order)) + F.col("shift")
    return placed.select("id", rank.alias("rank"), F.lit(cap).cast("long").alias("cap")).where("rank > cap")
