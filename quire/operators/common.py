"""Shared DataFrame building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

def ordered_rank(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                 out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """``row_number()`` within ``group_cols`` ordered by ``order_cols``,
    without putting a whole group into one task.

    ``row_number().over(partitionBy(g))`` sends every row of a group to one
    task: a group holding a third of the data would then sort a third of the
    data alone. Here the rows are range-partitioned on (group, order), so a
    hot group spans many partitions; each partition is sorted, rows of one
    group are contiguous in it, and ``monotonically_increasing_id`` gives
    their position. A small table of per-(partition, group) counts turns
    local positions into global ranks. ``order_cols`` must end in a unique
    key so that the order (and so the result) is deterministic.
    """
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    if num_partitions is None:
        num_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # materialised once: range bounds come from sampling, and the two uses
    # below (counts and join-back) must see the very same partitions
    x = cut(df.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    stats = x.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_mid").alias("_min_mid"))
    w = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    offsets = stats.withColumn(
        "_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most (#groups + #partitions) rows; no hint: AQE broadcasts it at
    # runtime when small, else shuffle-joins it
    offsets = offsets.select("_pid", *group_cols, "_before", "_min_mid")
    joined = x.join(offsets, ["_pid", *group_cols], "inner") if group_cols else \
        x.join(offsets, ["_pid"], "inner")
    return (joined.withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_min_mid") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_before", "_min_mid"))


def salted_top_k(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int,
                 unique_col: str, out: str = "rank", salt_buckets: int = 64) -> DataFrame:
    """Top-k rows per group with a two-phase (salted) window, so a hot group
    is cut down in parallel before one task sees at most ``salt_buckets * k``
    of its rows. ``order_cols`` must end in the unique column ``unique_col``,
    which also picks the salt (deterministic, so task retries agree)."""
    salt = F.xxhash64(F.col(unique_col))
    first = (df.withColumn("_salt", F.pmod(salt, F.lit(salt_buckets)))
             .withColumn("_r1", F.row_number().over(
                 Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)))
             .filter(F.col("_r1") <= k).drop("_r1", "_salt"))
    return (first.withColumn(out, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order_cols)))
            .filter(F.col(out) <= k))
