"""A table layout in which a lookup on any of several columns skips most of the table.

Each column is cut into ranges of about equal size, and the ranges' numbers, bit by bit in turn,
make one place along a curve. Rows that lie close on it are close in every column, so after a
range partitioning by it each file and row group holds a narrow stretch of all of them, and their
minimum and maximum tell a reader what to skip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6  # 2^BITS ranges of each column
SAMPLE_ROWS = 20_000  # rows whose values set the ranges; twice as many come to the driver at most
LONGEST_BOUND = 64  # characters of a text that set a range


def _value(df: DataFrame, name: str) -> Column:
    text = df.schema[name].dataType.simpleString() == "string"
    return F.substring(F.col(name), 1, LONGEST_BOUND) if text else F.col(name)


def boundaries(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list]:
    """Up to 2^bits - 1 rising values per column that cut a sample of it into equal parts.

    Frequent values take several parts, of which one boundary is left. The ranges only steer where rows lie.
    """
    total = df.count()
    part = min(1.0, SAMPLE_ROWS / total) if total else 1.0
    sample = df.select(*[_value(df, c).alias(c) for c in columns])
    rows = (sample.sample(part, seed=7) if part < 1 else sample).limit(2 * SAMPLE_ROWS).collect()
    found = {}
    for c in columns:
        # Texts in the order of their bytes, as Spark compares them.
        values = sorted((r[c] for r in rows if r[c] is not None), key=lambda v: v.encode() if isinstance(v, str) else v)
        cuts = [values[i * len(values) >> bits] for i in range(1, 1 << bits)] if values else []
        found[c] = list(dict.fromkeys(cuts))
    return found


def range_number(value: Column, bounds: Sequence, bits: int = BITS) -> Column:
    """How many of the boundaries are not above the value, by bisection; 0 for NULL."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])

    def further(known: Column, step: Column) -> Column:
        above = (known + step <= len(bounds)) & (F.get(listed, known + step - 1) <= value)
        return known + F.when(above, step).otherwise(0)

    return F.aggregate(steps, F.lit(0), further)


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """One number from several: the highest bit of each, then the next ones."""
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for i, number in enumerate(numbers):
            one = F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("long")
            place = place + F.shiftleft(one, bit * len(numbers) + len(numbers) - 1 - i)
    return place


def clustered(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> DataFrame:
    """The rows partitioned and sorted along the curve of the columns; df is read several times."""
    bounds = boundaries(df, columns, bits)
    names = [f"_range{i}" for i in range(len(columns))]
    numbered = df.withColumns({n: range_number(F.col(c), bounds[c], bits) for n, c in zip(names, columns)})
    placed = numbered.withColumn("_place", interleaved([F.col(n) for n in names], bits)).drop(*names)
    order = ["_place", *columns]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")
