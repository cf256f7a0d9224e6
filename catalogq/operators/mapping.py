"""Which candidate column holds which reference column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.functions.similarity import header_tokens, token_similarity, type_compatibility
from catalogq.functions.text import canonical, round_half_away
from catalogq.operators.align import align_rows, first_per_key, keyed
from catalogq.operators.profile import quoted
from catalogq.operators.topk import first_n
from catalogq.session import materialize

# Weights of the confidence, acceptance bounds, list length, default sample.
HEADER_WEIGHT, TYPE_WEIGHT, SAMPLE_WEIGHT = 0.35, 0.10, 0.55
EQUAL_WEIGHT, PRESENCE_WEIGHT = 0.85, 0.15
MIN_CONFIDENCE, MIN_SAMPLE_SIMILARITY = 0.55, 0.85
LISTED_PAIRS = 50
DEFAULT_SAMPLE = 256


def sample_rows(
    reference: DataFrame, candidate: DataFrame, reference_key: str, candidate_key: str,
    reference_order: Sequence[str], candidate_order: Sequence[str],
    reference_columns: Sequence[str], candidate_columns: Sequence[str], size: int,
) -> DataFrame:
    """The first `size` aligned rows in reference order, with the cells of both sides (0: all).

    The sample is chosen by narrow keys first, rows with the same place in the order by
    their key; then one row per chosen key is fetched from each side. So there are never
    more rows than asked for, also if the order isn't unique.
    """
    whole = align_rows(
        reference, candidate, reference_key, candidate_key, reference_order, candidate_order,
        reference_columns, candidate_columns,
    )
    if size <= 0:
        return whole
    places = keyed(reference, reference_key, reference_order, [], "ref", filled=True)
    places = places.groupBy("_key").agg(F.min("ref_ord").alias("ref_ord"))
    known = keyed(candidate, candidate_key, [], [], "cand", filled=True).select("_key").distinct()
    matched = places.join(known, "_key", "left_semi")
    chosen = materialize(first_n(matched, [F.col("ref_ord"), F.col("_key")], size).select("_key"), "sample")

    def side(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], prefix: str) -> DataFrame:
        rows = keyed(df, key, order, columns, prefix, filled=True).join(chosen, "_key", "left_semi")
        return first_per_key(rows, prefix)

    left = side(reference, reference_key, reference_order, reference_columns, "ref")
    right = side(candidate, candidate_key, candidate_order, candidate_columns, "cand")
    return left.join(right, "_key")


def first_matches(reference: DataFrame, candidate: DataFrame, size: int) -> DataFrame:
    """(_key) of the first `size` rows of (place, key) whose key the other table has; keys are unique on both sides."""
    known = candidate.where("key is not null").select("key")
    matched = reference.where("key is not null").join(known, "key", "left_semi")
    return materialize(first_n(matched, [F.col("place"), F.col("key")], size).select(F.col("key").alias("_key")), "sample")


def picked_rows(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], prefix: str, chosen: DataFrame, head: Column | None
) -> DataFrame:
    """The chosen rows (_chosen) and the rows of the head (_head) with their cells, in one pass, written.

    head says which rows lie at the start of the table, None: all. The chosen keys are few and
    written, so Spark knows their size when it plans the join.
    """
    marked = df.withColumn("_head", F.lit(True) if head is None else F.coalesce(head, F.lit(False)))
    rows = keyed(marked, key, order, columns, prefix, ["_head"])
    found = rows.join(chosen.withColumn("_chosen", F.lit(True)), "_key", "left").withColumn(
        "_chosen", F.coalesce("_chosen", F.lit(False))
    )
    return materialize(found.where("_chosen or _head"), f"picked-{prefix}")


def sample_similarity(
    sample: DataFrame, reference_columns: Sequence[str], candidate_columns: Sequence[str]
) -> DataFrame:
    """(reference_position, candidate_position, sample_similarity) for every pair of columns.

    Each row is compared with itself only: its reference cells against its candidate
    cells. The shares are summed before the shuffle, which carries one row per pair of
    columns and task.
    """
    # One normalising expression per side; one per column would not compile.
    left = F.transform(F.array(*[F.col(quoted(f"ref:{c}")) for c in reference_columns]), lambda v: canonical(v))
    right = F.transform(F.array(*[F.col(quoted(f"cand:{c}")) for c in candidate_columns]), lambda v: canonical(v))
    cells = sample.select(left.alias("left"), right.alias("right"))
    # Rows of one column are counted by the candidate columns' verdicts, R per row instead of R x C.
    equal = F.transform("right", lambda b: (F.col("a") == b).cast("long"))
    same = F.transform("right", lambda b: ((F.col("a") == "") == (b == "")).cast("long"))
    wide = cells.select(F.posexplode("left").alias("reference_position", "a"), "right").select(
        "reference_position", equal.alias("equal"), same.alias("same")
    )
    sums = wide.groupBy("reference_position").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(F.col("equal")[i]) for i in range(len(candidate_columns))]).alias("equal"),
        F.array(*[F.sum(F.col("same")[i]) for i in range(len(candidate_columns))]).alias("same"),
    )
    counted = sums.select(
        "reference_position", "n", F.posexplode(F.arrays_zip("equal", "same")).alias("candidate_position", "_sums")
    ).select("reference_position", "candidate_position", "n", "_sums.equal", "_sums.same")
    return counted.select(
        "reference_position",
        "candidate_position",
        (
            F.lit(EQUAL_WEIGHT) * (F.col("equal") / F.col("n"))
            + F.lit(PRESENCE_WEIGHT) * (F.col("same") / F.col("n"))
        ).alias("sample_similarity"),
    )


def mapping_pairs(similarity: DataFrame, reference_kinds: DataFrame, candidate_kinds: DataFrame) -> DataFrame:
    """Every pair of columns with its figures, best first. Kinds come from profile_sample."""

    def named(kinds: DataFrame, side: str) -> DataFrame:
        return kinds.select(
            F.col("position").alias(f"{side}_position"),
            F.col("column").alias(f"{side}_column"),
            header_tokens(F.col("column")).alias(f"{side}_tokens"),
            F.col("numeric_ratio").alias(f"{side}_numeric"),
            F.col("bool_ratio").alias(f"{side}_bool"),
        )

    joined = similarity.join(named(reference_kinds, "reference"), "reference_position").join(
        named(candidate_kinds, "candidate"), "candidate_position"
    )
    staged = joined.withColumns(
        {
            "_head": token_similarity(F.col("reference_tokens"), F.col("candidate_tokens")),
            "_type": type_compatibility(
                F.col("reference_numeric"), F.col("reference_bool"), F.col("candidate_numeric"), F.col("candidate_bool")
            ),
        }
    )
    confidence = (
        F.lit(HEADER_WEIGHT) * F.col("_head")
        + F.lit(TYPE_WEIGHT) * F.col("_type")
        + F.lit(SAMPLE_WEIGHT) * F.col("sample_similarity")
    )
    return staged.select(
        "reference_position",
        "candidate_position",
        "reference_column",
        "candidate_column",
        round_half_away(F.col("_head"), 6).alias("header_similarity"),
        round_half_away(F.col("_type"), 6).alias("type_compatibility"),
        round_half_away(F.col("sample_similarity"), 6).alias("sample_similarity"),
        round_half_away(confidence, 6).alias("mapping_confidence"),
    ).orderBy(
        F.col("mapping_confidence").desc(),
        F.col("sample_similarity").desc(),
        F.col("header_similarity").desc(),
        "reference_position",
        "candidate_position",
    )


def assign_columns(ranked: Sequence[dict]) -> list[dict]:
    """One-to-one assignment, best pair first. The input is metadata: one entry per pair of columns."""
    taken_ref: set[str] = set()
    taken_cand: set[str] = set()
    accepted = []
    for pair in ranked:
        good = pair["mapping_confidence"] >= MIN_CONFIDENCE or pair["sample_similarity"] >= MIN_SAMPLE_SIMILARITY
        if good and pair["reference_column"] not in taken_ref and pair["candidate_column"] not in taken_cand:
            accepted.append(pair)
            taken_ref.add(pair["reference_column"])
            taken_cand.add(pair["candidate_column"])
    return accepted
