"""Similarity of mapped columns over all aligned rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.similarity import with_cell_similarity

CellSimilarity = Callable[[Column, Column], Column]


def column_scores(
    aligned: DataFrame, mapping: Sequence[tuple[str, str]], cell_similarity: CellSimilarity | None = None
) -> DataFrame:
    """(reference_column, candidate_column, similarity, row_count_scored) per mapped pair.

    All pairs are scored in one pass: a row becomes one row per pair of cells, the mean
    is taken before the shuffle, and identical cells cost one comparison.
    """
    pairs = [
        F.struct(
            F.lit(ref).alias("reference_column"),
            F.lit(cand).alias("candidate_column"),
            F.col(f"`ref:{ref}`").alias("_a"),
            F.col(f"`cand:{cand}`").alias("_b"),
        )
        for ref, cand in mapping
    ]
    cells = aligned.select(F.inline(F.array(*pairs)))
    if cell_similarity is None:
        scored = with_cell_similarity(cells, "_a", "_b", "_similarity")
    else:
        scored = cells.withColumn("_similarity", cell_similarity(F.col("_a"), F.col("_b")))
    return scored.groupBy("reference_column", "candidate_column").agg(
        F.avg("_similarity").alias("similarity"), F.count("*").alias("row_count_scored")
    )


def dataset_score(scores: DataFrame, reference_columns: Sequence[str], coverage_reference: float) -> DataFrame:
    """One row: mean over all reference columns (an unmapped one counts 0) and its product with coverage."""
    total = float(len(reference_columns)) or 1.0
    similarity = F.coalesce(F.sum("similarity"), F.lit(0.0)) / F.lit(total)
    return scores.agg(
        similarity.alias("dataset_similarity_equal_weighted"),
        F.count("*").alias("mapped_reference_columns"),
    ).select(
        "dataset_similarity_equal_weighted",
        (F.col("dataset_similarity_equal_weighted") * F.lit(coverage_reference)).alias("overall_score_with_coverage"),
        "mapped_reference_columns",
        F.lit(len(reference_columns)).cast("long").alias("reference_columns_total"),
    )
