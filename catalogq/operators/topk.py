"""First rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _cut(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every partition."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return df.sortWithinPartitions(*order).withColumn("_row", row).where(F.col("_row") < n).drop("_row")


def _task_bucket() -> Column:
    """A bucket of tasks: about the square root of their number, of buckets as of tasks in the largest.

    Bucket b holds the tasks b * b to (b + 1) * (b + 1) - 1, so nobody needs to know how many there are.
    """
    return F.floor(F.sqrt(F.spark_partition_id())).cast("int")


def _bucket_cut(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every group within each bucket of tasks."""
    ranked = df.withColumn("_bucket", _task_bucket()).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order))
    )
    return ranked.where(F.col("_rank") <= n).drop("_rank", "_bucket")


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows under an order, in two levels, so that no task gets n rows from every other one.

    Each task keeps n rows; buckets of tasks keep n of theirs; the last step takes n from the
    buckets. The plan is the same for every n.
    """
    return _bucket_cut(_cut(df, order, n), [], order, n).orderBy(*order).limit(n)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every group; each task passes on one row of a group at most."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first k rows of every group, under a total order, with their rank if asked for.

    Two levels, whatever k is: groups are first cut in buckets of tasks, so a hot group, or
    one met by every task, is reduced before its rows come together.
    """
    name = rank or "_rank"
    cut = _bucket_cut(df, group, order, k)
    ranked = cut.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    first = ranked.where(F.col(name) <= k)
    return first.withColumn(name, F.col(name).cast("bigint")) if rank else first.drop(name)
