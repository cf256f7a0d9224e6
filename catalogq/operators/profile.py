"""Column profiles of a table whose cells are read as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.text import bool_word, is_decimal, ratio, trimmed, with_match_key
from catalogq.operators.head import first_rows
from catalogq.operators.topk import top_per_group

# Fixed value: non-empty cells per column that type and length figures are taken from.
SAMPLE_CELLS = 500
# Rows looked at first, as a multiple of the cells wanted.
HEAD_ROWS_PER_CELL = 4
HEAD_ROWS = HEAD_ROWS_PER_CELL * SAMPLE_CELLS


def header_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, column): the header as rows."""
    rows = [(i, name) for i, name in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string")


def quoted(name: str) -> str:
    """A column name inside an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def cells(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """(kept columns, column, value): one row per cell."""
    names = F.array(*[F.lit(c) for c in columns])
    values = F.expr("array(" + ", ".join(f"CAST({quoted(c)} AS STRING)" for c in columns) + ")")
    return df.select(*keep, F.inline(F.arrays_zip(names.alias("column"), values.alias("value"))))


def profile_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, non-empty cells, distinct values and uniqueness per column.

    Equal values are counted before the shuffle, and long values are shuffled as
    digests, so neither a hot value nor wide text makes a heavy partition.
    """
    keys = with_match_key(cells(df, columns), F.col("value"), "key")
    values = keys.groupBy("column", "key").agg(F.count("*").alias("n"))
    counted = values.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("non_empty_count"),
        F.count("key").alias("unique_non_empty_count"),
    )
    full, distinct = F.col("non_empty_count"), F.col("unique_non_empty_count")
    return (
        header_table(df, columns)
        .join(counted, "column", "left")
        .na.fill(0, ["row_count", "non_empty_count", "unique_non_empty_count"])
        .select(
            "position",
            "column",
            "row_count",
            "non_empty_count",
            (F.col("row_count") - full).alias("null_count"),
            "unique_non_empty_count",
            ((full > 0) & (full == distinct)).alias("is_unique"),
            ratio(distinct, full).alias("uniqueness_ratio"),
        )
    )


def _first_cells(df: DataFrame, columns: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """(column, number, truth, bytes) of the first `size` non-empty cells of each column."""
    text = F.col("text")
    filled = (
        cells(df, columns, [F.struct(*order).alias("_ord")])
        .select("_ord", "column", trimmed(F.col("value")).alias("text"))
        .where("text <> ''")
        .select(
            "_ord",
            "column",
            is_decimal(text).cast("double").alias("number"),
            bool_word(text).isNotNull().cast("double").alias("truth"),
            F.octet_length(text).cast("double").alias("bytes"),
        )
    )
    return top_per_group(filled, ["column"], [F.col("_ord")], size)


def profile_sample(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], size: int = SAMPLE_CELLS,
    head: tuple[DataFrame, bool] | None = None,
) -> DataFrame:
    """Number and boolean shares and byte lengths over the first non-empty cells of each column.

    The first rows of the table hold the sample of every well-filled column, so only
    columns that are sparse at the start are looked for in the whole table. A caller that
    has fetched the first rows (HEAD_ROWS_PER_CELL * size of them, with the order columns) gives
    them as head, with whether they are the whole table.
    """
    head, whole = head or first_rows(df, order, HEAD_ROWS_PER_CELL * size)
    first = _first_cells(head, columns, order, size)
    if not whole:
        found = {r["column"]: r["n"] for r in first.groupBy("column").agg(F.count("*").alias("n")).collect()}
        sparse = [c for c in columns if found.get(c, 0) < size]
        if sparse:
            dense = first.where(~F.col("column").isin(*sparse))
            first = dense.unionByName(_first_cells(df, sparse, order, size))
    sampled = first.groupBy("column").agg(
        F.avg("number").alias("numeric_ratio"),
        F.avg("truth").alias("bool_ratio"),
        F.avg("bytes").alias("avg_len_sample"),
        F.max("bytes").alias("max_len_sample"),
    )
    figures = ["numeric_ratio", "bool_ratio", "avg_len_sample", "max_len_sample"]
    return (
        header_table(df, columns)
        .join(sampled, "column", "left")
        .na.fill(0.0, figures)
        .select("position", "column", *figures)
    )


def unique_columns(counts: DataFrame) -> DataFrame:
    """Of a table of counts, the columns whose non-empty values never repeat, in header order."""
    return counts.where("is_unique").select("position", "column").orderBy("position")
