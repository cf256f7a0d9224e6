"""Positions in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogq.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_position(df: DataFrame, order: Sequence[str], position: str) -> DataFrame:
    """Add the dense 0-based position of each row in ascending order (NULLs first).

    Rows are range-partitioned and sorted; the position inside a partition comes with
    the sort, and only one row per partition is needed to turn it into a global one.
    A random second key splits runs of equal rows over several partitions. The sorted
    rows are written once: a second evaluation could draw other range bounds.
    """
    ranged = (
        df.withColumn("_tie", F.rand(11))
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    rows = materialize(ranged, "ranged")
    rows = rows.withColumn("_part", F.shiftright("_row", _ROW_BITS)).withColumn(
        "_row", F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per shuffle partition, whatever the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_row") + F.col("_offset"))
        .drop("_part", "_row", "_offset")
    )


def with_running_total(
    df: DataFrame, group: str, order: str, weight: str, total: str
) -> DataFrame:
    """Add, per group, the running sum of weight up to and including each row.

    (group, order) must be unique. Groups may be of any size: the running sum is
    taken inside range partitions and completed with the totals of earlier ones.
    """
    ranged = df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id())
    rows = materialize(ranged, "running")
    sums = rows.groupBy(group, "_part").agg(F.sum(weight).alias("_sum"))
    # At most one row per group and shuffle partition.
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn(total, F.sum(weight).over(inside))
        .join(offsets, [group, "_part"])
        .withColumn(total, F.col(total) + F.col("_offset"))
        .drop("_part", "_offset")
    )
