"""Ranked rows with a directory: any page of a long result at the cost of a page."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.session import new_folder


@dataclass(frozen=True)
class Ranked:
    """Rows in ranges of an order, and how many rows each range has.

    rows: the rows with their range (_part), of which a filter on ranges reads only those files.
    ends: the number of rows up to the end of each range; one number per range.
    """

    rows: DataFrame
    order: tuple[str, ...]
    descending: tuple[bool, ...]
    parts: tuple[int, ...]
    ends: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def ranges(self, offset: int, size: int) -> tuple[int, int]:
        """The first range that holds rows of a page, and the one after the last."""
        last = min(offset + size, self.total)
        if size < 1 or offset >= last:
            return 0, 0
        return bisect_right(self.ends, offset), bisect_right(self.ends, last - 1) + 1

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows offset to offset + size - 1 in order; reads the ranges that hold them, most often one or two."""
        first, stop = self.ranges(offset, size)
        before = self.ends[first - 1] if first else 0
        chosen = self.rows.where(F.col("_part").isin(*self.parts[first:stop])) if stop > first else self.rows.where("false")
        order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in zip(self.order, self.descending)]
        shown = [c for c in chosen.columns if c not in (*self.order, "_part")]
        return chosen.orderBy(*order).offset(offset - before).limit(size).select(*shown)


def ranked(df: DataFrame, order: Sequence[tuple[Column, bool]], label: str = "ranked") -> Ranked:
    """Put the rows in order once; order lists (key, descending), missing keys last if descending, else first.

    The keys together should be unique: rows with equal keys share a range. One shuffle of the
    rows by sampled ranges, and one row per range comes to the driver.
    """
    spark = df.sparkSession
    names = tuple(f"_o{i}" for i in range(len(order)))
    keyed = df.select(*[key.alias(n) for (key, _), n in zip(order, names)], "*")
    sides = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, (_, down) in zip(names, order)]
    path = new_folder(spark, label)
    parts = keyed.repartitionByRange(*sides).withColumn("_part", F.spark_partition_id())
    parts.write.partitionBy("_part").parquet(path)
    rows = spark.read.schema(parts.schema).parquet(path)
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    found = tuple(sorted(sizes))
    return Ranked(rows, names, tuple(down for _, down in order), found, tuple(accumulate(sizes[p] for p in found)))
