"""One-to-one row alignment on a key: the first row of a key wins on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.text import is_empty, ratio, with_match_key
from catalogq.operators.profile import quoted
from catalogq.operators.topk import first_per_group


def text_columns(columns: Sequence[str], prefix: str) -> list[Column]:
    """The columns as text, named '<prefix>:<column>'."""
    return [F.expr(f"CAST({quoted(c)} AS STRING) AS {quoted(f'{prefix}:{c}')}") for c in columns]


def keyed(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], prefix: str, kept: Sequence[str] = (),
    filled: bool = False,
) -> DataFrame:
    """(_key, <prefix>_ord, prefixed columns, kept ones); _key is NULL where the key cell is empty, or with filled no such rows."""
    rows = df.select(
        *kept,
        F.col(quoted(key)).cast("string").alias("_cell"),
        *([F.struct(*order).alias(f"{prefix}_ord")] if order else []),
        *text_columns(columns, prefix),
    )
    return with_match_key(rows, F.col("_cell"), "_key", filled).drop("_cell")


def first_per_key(rows: DataFrame, prefix: str) -> DataFrame:
    """Of rows with filled keys the first of each key; repeated keys are cut before the shuffle."""
    cells = sorted(c for c in rows.columns if c.startswith(f"{prefix}:"))
    # Rows with the same place are told apart by their cells, so every evaluation takes the same one.
    order = [F.col(f"{prefix}_ord"), *([F.xxhash64(*[F.col(f"`{c}`") for c in cells])] if cells else [])]
    return first_per_group(rows, ["_key"], order)


def align_rows(
    reference: DataFrame, candidate: DataFrame, reference_key: str, candidate_key: str,
    reference_order: Sequence[str], candidate_order: Sequence[str],
    reference_columns: Sequence[str] = (), candidate_columns: Sequence[str] = (), unique: bool = False,
) -> DataFrame:
    """(_key, ref_ord, cand_ord, 'ref:…' and 'cand:…' columns): one row per aligned pair.

    The partitioning that finds the first row of a key also serves the join, so each
    side is shuffled once. Where the caller has counted that no key repeats (`unique`),
    the wide rows aren't sorted to find it.
    """

    def rows(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], prefix: str) -> DataFrame:
        found = keyed(df, key, order, columns, prefix, filled=True)
        return found if unique else first_per_key(found, prefix)

    left = rows(reference, reference_key, reference_order, reference_columns, "ref")
    right = rows(candidate, candidate_key, candidate_order, candidate_columns, "cand")
    return left.join(right, "_key")


def alignment_counts(
    reference: DataFrame, candidate: DataFrame, reference_key: str, candidate_key: str
) -> DataFrame:
    """One row: matched rows, duplicates, misses and coverage of both sides.

    Rows are counted per key before the join, so a key held by many rows is one row.
    """

    def per_key(df: DataFrame, key: str, name: str) -> DataFrame:
        return keyed(df, key, [], [], "any").groupBy("_key").agg(F.count("*").alias(name))

    # NULL keys (empty cells) never join; they stay on their own side.
    both = per_key(reference, reference_key, "nr").join(per_key(candidate, candidate_key, "nc"), "_key", "full")
    known, matched = F.col("_key").isNotNull(), F.col("nr").isNotNull() & F.col("nc").isNotNull()

    def total(value, condition=None):
        return F.coalesce(F.sum(value if condition is None else F.when(condition, value)), F.lit(0))

    sums = both.agg(
        total(F.col("nr")).alias("reference_rows"),
        total(F.col("nc")).alias("candidate_rows"),
        total(F.lit(1), matched).alias("matched_rows"),
        total(F.col("nr") - 1, known).alias("duplicate_reference_keys"),
        total(F.col("nc") - 1, matched).alias("duplicate_candidate_matches"),
        total(F.col("nc"), ~matched).alias("missing_candidate_keys"),
    )
    rows, cand_rows, hits = F.col("reference_rows"), F.col("candidate_rows"), F.col("matched_rows")
    complete = (
        (F.col("duplicate_reference_keys") == 0)
        & (F.col("duplicate_candidate_matches") == 0)
        & (F.col("missing_candidate_keys") == 0)
        & (hits == rows)
        & (hits == cand_rows)
    )
    return sums.select(
        complete.alias("complete"),
        "*",
        ratio(hits, rows).alias("coverage_reference"),
        ratio(hits, cand_rows).alias("coverage_candidate"),
    )


def unmatched_rows(
    rows: DataFrame, other: DataFrame, key: str, other_key: str
) -> DataFrame:
    """Rows whose key is empty or absent from the other table.

    The other side is reduced to distinct keys; rows with an empty key bypass the join.
    """
    cell = F.col(quoted(key)).cast("string")
    known = keyed(other, other_key, [], [], "any", filled=True).select("_key").distinct()
    absent = with_match_key(rows, cell, "_key", filled=True).join(known, "_key", "left_anti").drop("_key")
    return absent.unionByName(rows.where(is_empty(cell)))
