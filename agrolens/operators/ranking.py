"""Skew-safe row numbering within groups.

``row_number() OVER (PARTITION BY region ORDER BY key)`` sends a whole region
to one task.  Here the rows are range-partitioned on ``(group, key)`` —
Spark samples the boundaries, so a hot group is split across many tasks —
sorted within partitions, and numbered with the position inside the
partition.  A tiny per-(partition, group) count table (<= partitions + groups
rows) turns local positions into group-wide ranks.  The numbered table is
written once (parquet in the shared folder) so both passes see the same
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolens.session import ensure_checkpoint_dir, materialize


def rank_within(df: DataFrame, group_cols: list[str], order_col: str, out: str = "rn",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number of each row within its group, ordered
    by ``order_col`` (must be unique within a group), plus ``<out>_n`` = the
    group size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_cols) + [order_col]
    numbered = (df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id()))
    # both passes must see the same partitioning: materialise once
    numbered = materialize(numbered, "ranked")
    part = numbered.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    # without groups this window has one row per partition
    w = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    part = part.withColumn("_offset", F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    wn = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    part = part.withColumn(f"{out}_n", F.sum("_cnt").over(wn))
    # a row per (partition, group): written, so Spark knows its size and broadcasts it only where it is small
    part = materialize(part.select("_pid", *group_cols, "_first", "_offset", f"{out}_n"), "rank-offsets")
    j = numbered.join(part, on=["_pid", *group_cols])
    rank = F.coalesce(F.col("_offset"), F.lit(0)) + (F.col("_pos") - F.col("_first")) + 1
    return j.withColumn(out, rank.cast("long")).drop("_pid", "_pos", "_first", "_offset")


def every_nth(df: DataFrame, group_cols: list[str], order_col: str, target_per_group: int) -> DataFrame:
    """Every n-th row per group by key order, step = max(1, n // target)."""
    r = rank_within(df, group_cols, order_col)
    step = F.greatest(F.lit(1), F.floor(F.col("rn_n") / F.lit(target_per_group)))
    return r.where(((F.col("rn") - 1) % step) == 0).drop("rn_n")


def first_and_middle(df: DataFrame, group_cols: list[str], order_col: str) -> DataFrame:
    """First row and the row at 0-based position n // 2 of each group."""
    r = rank_within(df, group_cols, order_col)
    mid = F.floor(F.col("rn_n") / 2) + 1
    return (r.where((F.col("rn") == 1) | (F.col("rn") == mid))
            .withColumn("position", F.when(F.col("rn") == 1, F.lit("first")).otherwise(F.lit("middle")))
            .drop("rn_n"))


def surrogate_index(df: DataFrame, order_col: str, out: str = "index") -> DataFrame:
    """0..n-1 in key order, without a single-partition window."""
    r = rank_within(df, [], order_col, out="_rn")
    return r.withColumn(out, F.col("_rn") - 1).drop("_rn", "_rn_n")
