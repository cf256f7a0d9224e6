"""The first rows of a table in its own order, found without sorting the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from catalogq.operators.topk import first_n


def literal(value, kind: DataType) -> Column:
    """A value read from a row, as a literal of the column's type."""
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def not_after(df: DataFrame, order: Sequence[str], last) -> Column:
    """Rows up to a position. On one plain order column the condition reaches the scan."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if len(order) == 1:
        column = F.col(order[0])
        return column.isNull() | (column <= literal(last[order[0]], kinds[order[0]]))
    return F.struct(*order) <= F.struct(*[literal(last[c], kinds[c]).alias(c) for c in order])


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> tuple[DataFrame, bool]:
    """The first n rows (with rows that tie with the last one), and whether that is all of them.

    One pass over the order columns finds the last position; each task keeps n positions.
    """
    last = last_of_first(df.select(F.struct(*[F.col(c) for c in order]).alias("position")), n)
    return (df, True) if last is None else (df.where(not_after(df, order, last)), False)


def last_of_first(positions: DataFrame, n: int):
    """The position of the n-th row of (position); None if there are fewer rows."""
    first = first_n(positions, [F.col("position")], n)
    last = first.agg(F.max("position").alias("last"), F.count("*").alias("rows")).first()
    return last["last"] if last["rows"] >= n else None
