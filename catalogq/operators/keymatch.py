"""Which column of one table identifies the rows of the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.similarity import header_tokens, token_similarity
from catalogq.functions.text import ratio, round_half_away, with_match_key
from catalogq.operators.profile import cells
from catalogq.session import materialize

# Fixed value: key candidates listed in a report.
LISTED_CANDIDATES = 10
SET_BITS = 12


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, key): the non-empty values of each column once."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, key string")
    return with_match_key(cells(df, columns), F.col("value"), "key", filled=True).select("column", "key").distinct()


def value_sketch(key: Column) -> Column:
    """A mergeable sketch of the set of values; up to 2^SET_BITS values it is the set itself."""
    return F.theta_sketch_agg(key, SET_BITS)


def may_share(left: DataFrame, right: DataFrame) -> list[tuple]:
    """Pairs of columns of (column, values) that may share a value; the others are proven to share none.

    Sketches of whole sets that do not meet are the proof, so a small overlap of large sets is
    never lost: such pairs are left to the exact join. Both tables have one row per column.
    """
    whole = lambda x: F.theta_sketch_estimate(x) <= 1 << SET_BITS
    others = [r["column"] for r in right.select("column").collect()]
    if not others:
        return []
    # One row per column on either side: the right ones become a list beside each left one.
    listed = right.agg(F.collect_list(F.struct("column", "values")).alias("others"))
    each = left.withColumn("_all", F.lit(1)).join(listed.withColumn("_all", F.lit(1)), "_all")
    met = each.select(F.col("column").alias("a"), F.col("values").alias("mine"), F.explode("others").alias("o"))
    apart = whole(F.col("mine")) & whole(F.col("o.values")) & (
        F.theta_sketch_estimate(F.theta_intersection(F.col("mine"), F.col("o.values"))) == 0
    )
    return [(r["a"], r["b"]) for r in met.where(~apart).select("a", F.col("o.column").alias("b")).collect()]


def possible_pairs(
    reference: DataFrame, reference_columns: Sequence[str], candidate: DataFrame, candidate_columns: Sequence[str]
) -> list[tuple[str, str]]:
    """Pairs of columns that may share a value, by one pass over each table that shuffles one sketch per column and task."""

    def sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        keys = with_match_key(cells(df, columns), F.col("value"), "key", filled=True)
        return keys.groupBy("column").agg(value_sketch(F.col("key")).alias("values"))

    sides = ((reference, reference_columns, "left"), (candidate, candidate_columns, "right"))
    return may_share(*[materialize(sketches(df, columns), f"sets-{name}") for df, columns, name in sides])


def key_overlap(
    reference: DataFrame, reference_columns: Sequence[str], candidate: DataFrame, candidate_columns: Sequence[str]
) -> DataFrame:
    """(reference_column, candidate_column, intersection_count) for pairs that share values.

    Columns that sketches prove to share nothing with the other table are not shuffled. For the
    others, one join on the value serves all pairs of columns. A side holds a value at most
    once per column, so no value can produce more rows than there are column pairs.
    """
    pairs = possible_pairs(reference, reference_columns, candidate, candidate_columns)
    some = lambda columns, side: [c for c in columns if any(p[side] == c for p in pairs)]
    left = distinct_values(reference, some(reference_columns, 0)).withColumnRenamed("column", "reference_column")
    right = distinct_values(candidate, some(candidate_columns, 1)).withColumnRenamed("column", "candidate_column")
    return (
        left.join(right, "key")
        .groupBy("reference_column", "candidate_column")
        .agg(F.count("*").alias("intersection_count"))
    )


def key_candidates(overlap: DataFrame, reference_counts: DataFrame, candidate_counts: DataFrame) -> DataFrame:
    """Scored column pairs, best first: complete set matches, then coverage, name and support."""
    figures = ("position", "row_count", "non_empty_count", "unique_non_empty_count")

    def named(counts: DataFrame, side: str) -> DataFrame:
        return counts.select(
            F.col("column").alias(f"{side}_column"),
            header_tokens(F.col("column")).alias(f"{side}_tokens"),
            *[F.col(f).alias(f"{side}_{f}") for f in figures],
        )

    joined = overlap.join(named(reference_counts, "reference"), "reference_column").join(
        named(candidate_counts, "candidate"), "candidate_column"
    )
    shared = F.col("intersection_count")
    ref_distinct, cand_distinct = F.col("reference_unique_non_empty_count"), F.col("candidate_unique_non_empty_count")
    ref_rows, cand_rows = F.col("reference_row_count"), F.col("candidate_row_count")
    complete = (ref_rows == cand_rows) & (shared == ref_distinct) & (shared == cand_distinct)
    support = F.least(ratio(ref_distinct, ref_rows), ratio(cand_distinct, cand_rows))
    scored = joined.withColumns(
        {
            "complete_set_match": complete,
            "_cand": ratio(shared, cand_distinct),
            "_ref": ratio(shared, ref_distinct),
            "_head": token_similarity(F.col("reference_tokens"), F.col("candidate_tokens")),
            "_support": support,
        }
    ).withColumn(
        "score",
        F.when(F.col("complete_set_match"), 10.0).otherwise(0.0)
        + F.col("_cand") * 2.0
        + F.col("_ref")
        + F.col("_head")
        + F.col("_support") * 3.0,
    )
    return scored.orderBy(
        F.col("score").desc(),
        F.col("reference_non_empty_count").desc(),
        "reference_position",
        "candidate_position",
    ).select(
        "reference_column",
        "candidate_column",
        "complete_set_match",
        "intersection_count",
        round_half_away(F.col("_cand"), 6).alias("candidate_key_coverage"),
        round_half_away(F.col("_ref"), 6).alias("reference_key_coverage"),
        round_half_away(F.col("_head"), 6).alias("header_similarity"),
        F.col("reference_non_empty_count").alias("reference_non_empty"),
        F.col("candidate_non_empty_count").alias("candidate_non_empty"),
        "score",
    )


def rank_keys(
    reference: DataFrame, candidate: DataFrame, reference_counts: DataFrame, candidate_counts: DataFrame,
    reference_unique: Sequence[str], candidate_unique: Sequence[str],
) -> DataFrame:
    """The best key candidates among the columns known to be unique."""
    overlap = key_overlap(reference, reference_unique, candidate, candidate_unique)
    return key_candidates(overlap, reference_counts, candidate_counts).limit(LISTED_CANDIDATES)
