"""Comparison of a candidate table with a reference table."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.operators.align import align_rows
from catalogq.operators.head import last_of_first, not_after
from catalogq.operators.keymatch import LISTED_CANDIDATES, key_candidates
from catalogq.operators.keytable import KeyFigures, KeyTable, exactly_unique, key_figures, key_table, repeated_early
from catalogq.operators.mapping import (
    DEFAULT_SAMPLE,
    LISTED_PAIRS,
    assign_columns,
    first_matches,
    mapping_pairs,
    picked_rows,
    sample_similarity,
)
from catalogq.operators.profile import HEAD_ROWS, profile_sample
from catalogq.operators.scoring import CellSimilarity, column_scores

OK, PARTIAL, NO_KEY = "ok", "partial_key_match", "no_complete_key_match"

REPORT_SCHEMA = """
status string,
config struct<reference_csv string, candidate_csv string, sample_size_mapping bigint,
  column_weighting map<string,string>, missing_reference_column_score double,
  extra_candidate_columns_penalize boolean>,
reference_profile struct<row_count bigint, column_count bigint, unique_columns array<string>>,
candidate_profile struct<row_count bigint, column_count bigint>,
row_alignment struct<complete boolean, reference_key string, candidate_key string, matched_rows bigint,
  reference_rows bigint, candidate_rows bigint, coverage_reference double, coverage_candidate double,
  duplicate_reference_keys bigint, duplicate_candidate_matches bigint, missing_candidate_keys bigint>,
key_match struct<found_usable_match boolean, found_complete_match boolean, match_mode string,
  reference_column string, candidate_column string, reason string,
  candidates array<struct<reference_column string, candidate_column string, complete_set_match boolean,
    intersection_count bigint, candidate_key_coverage double, reference_key_coverage double,
    header_similarity double, reference_non_empty bigint, candidate_non_empty bigint, score double>>>,
column_mapping struct<
  mapping map<string, struct<reference_column string, candidate_column string, header_similarity double,
    type_compatibility double, sample_similarity double, mapping_confidence double>>,
  reference_unmatched array<string>, candidate_unmatched array<string>, mapping_confidence_avg double,
  pair_candidates_top array<struct<reference_column string, candidate_column string, header_similarity double,
    type_compatibility double, sample_similarity double, mapping_confidence double>>>,
scores struct<dataset_similarity_equal_weighted double, overall_score_with_coverage double,
  mapped_reference_columns bigint, reference_columns_total bigint,
  per_reference_column array<struct<reference_column string, candidate_column string, similarity double,
    matched boolean, reason string, mapping_confidence double, row_count_scored bigint,
    header_similarity double, sample_similarity double>>>,
summary struct<status string, dataset_similarity_equal_weighted double, coverage_reference double,
  coverage_candidate double, overall_score_with_coverage double, matched_rows bigint, reference_rows bigint,
  candidate_rows bigint, mapped_reference_columns bigint, reference_columns_total bigint, key_match_mode string,
  key_reference_column string, key_candidate_column string>
"""


@dataclass(frozen=True)
class Table:
    """A table to compare: its rows, the columns that count, and the columns that order its rows."""

    df: DataFrame
    order: Sequence[str]
    columns: Sequence[str] = ()
    path: str = ""

    @property
    def headers(self) -> list[str]:
        return list(self.columns) or [c for c in self.df.columns if c not in self.order]


def _pair_fields(pair: dict) -> dict:
    return {k: v for k, v in pair.items() if not k.endswith("_position")}


def _key_match(candidates: list[dict]) -> dict:
    if not candidates:
        return {
            "found_usable_match": False,
            "found_complete_match": False,
            "reason": "no_exact_or_partial_unique_key_match",
            "candidates": [],
        }
    best = candidates[0]
    complete = best["complete_set_match"]
    return {
        "found_usable_match": True,
        "found_complete_match": complete,
        "match_mode": "complete" if complete else "partial",
        "reference_column": best["reference_column"],
        "candidate_column": best["candidate_column"],
        "reason": "exact_unique_key_set_match" if complete else "partial_unique_key_overlap_match",
        "candidates": candidates,
    }


def _report(ref: Table, cand: Table, status: str, sample_size: int, counts: dict, keys: dict,
            alignment: dict, mapping: dict, scores: dict) -> dict:
    return {
        "status": status,
        "config": {
            "reference_csv": ref.path,
            "candidate_csv": cand.path,
            "sample_size_mapping": sample_size,
            "column_weighting": {"columns": "equal"},
            "missing_reference_column_score": 0.0,
            "extra_candidate_columns_penalize": False,
        },
        "reference_profile": {
            "row_count": alignment["reference_rows"],
            "column_count": len(ref.headers),
            "unique_columns": counts["reference_unique"],
        },
        "candidate_profile": {"row_count": alignment["candidate_rows"], "column_count": len(cand.headers)},
        "row_alignment": alignment,
        "key_match": keys,
        "column_mapping": mapping,
        "scores": scores,
        "summary": {
            "status": status,
            "dataset_similarity_equal_weighted": scores["dataset_similarity_equal_weighted"],
            "coverage_reference": alignment["coverage_reference"],
            "coverage_candidate": alignment["coverage_candidate"],
            "overall_score_with_coverage": scores["overall_score_with_coverage"],
            "matched_rows": alignment["matched_rows"],
            "reference_rows": alignment["reference_rows"],
            "candidate_rows": alignment["candidate_rows"],
            "mapped_reference_columns": scores["mapped_reference_columns"],
            "reference_columns_total": scores["reference_columns_total"],
            "key_match_mode": keys.get("match_mode"),
            "key_reference_column": keys.get("reference_column"),
            "key_candidate_column": keys.get("candidate_column"),
        },
    }


def _zero_report(ref: Table, cand: Table, sample_size: int, counts: dict, keys: dict, alignment: dict) -> dict:
    """No usable key: every column scores 0."""
    mapping = {
        "mapping": {},
        "reference_unmatched": ref.headers,
        "candidate_unmatched": cand.headers,
        "mapping_confidence_avg": 0.0,
        "pair_candidates_top": [],
    }
    scores = {
        "dataset_similarity_equal_weighted": 0.0,
        "overall_score_with_coverage": 0.0,
        "mapped_reference_columns": 0,
        "reference_columns_total": len(ref.headers),
        "per_reference_column": [
            {"reference_column": c, "similarity": 0.0, "matched": False, "reason": NO_KEY} for c in ref.headers
        ],
    }
    return _report(ref, cand, NO_KEY, sample_size, counts, keys, alignment, mapping, scores)


def _both(*jobs: Callable[[], Any]) -> list:
    """The results of independent steps, usually one per side, that Spark works on at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def _candidate_keys(table: Table) -> KeyTable | None:
    """The key table of the columns that may be unique; None if there are none."""
    repeated = set(repeated_early(table.df, table.headers))
    columns = [c for c in table.headers if c not in repeated]
    return key_table(table.df, table.order, columns) if columns else None


def _small_counts(spark: SparkSession, headers: Sequence[str], figures: KeyFigures, side: int) -> DataFrame:
    rows, filled = figures.rows[side], figures.filled[side]
    schema = "position int, column string, row_count long, non_empty_count long, unique_non_empty_count long"
    unique = [(headers.index(c), c, rows, filled[c], filled[c]) for c in figures.unique[side]]
    return spark.createDataFrame(unique, schema)


def _find_keys(ref: Table, cand: Table) -> tuple[KeyTable | None, KeyTable | None, KeyFigures, list[dict]]:
    """The key tables of both sides, their figures, and the best pairs of columns that identify rows."""
    spark = ref.df.sparkSession
    left, right = _both(lambda: _candidate_keys(ref), lambda: _candidate_keys(cand))
    if left is None or right is None:
        counted = _both(*[lambda t=t: t.df.count() for t in (ref, cand)])
        nothing: tuple[dict, dict] = ({}, {})
        unique = tuple([c for c in (exactly_unique(k) if k else [])] for k in (left, right))
        return left, right, KeyFigures(tuple(counted), nothing, unique, {}), []
    figures = key_figures(left, right)
    if not figures.overlaps:
        return left, right, figures, []
    overlap = spark.createDataFrame(
        [(a, b, n) for (a, b), n in figures.overlaps.items()],
        "reference_column string, candidate_column string, intersection_count long",
    )
    counts = (_small_counts(spark, t.headers, figures, i) for i, t in enumerate((ref, cand)))
    ranked = key_candidates(overlap, *counts).limit(LISTED_CANDIDATES)
    return left, right, figures, [r.asDict() for r in ranked.collect()]


def _alignment(figures: KeyFigures, reference_key: str, candidate_key: str) -> dict:
    """Row alignment on a pair of unique columns: every shared value is one aligned pair."""
    matched = figures.overlaps[reference_key, candidate_key]
    ref_rows, cand_rows = figures.rows
    missing = cand_rows - matched
    return {
        "complete": missing == 0 and matched == ref_rows,
        "reference_rows": ref_rows,
        "candidate_rows": cand_rows,
        "matched_rows": matched,
        "duplicate_reference_keys": 0,
        "duplicate_candidate_matches": 0,
        "missing_candidate_keys": missing,
        "coverage_reference": matched / ref_rows if ref_rows else 0.0,
        "coverage_candidate": matched / cand_rows if cand_rows else 0.0,
        "reference_key": reference_key,
        "candidate_key": candidate_key,
    }


def _picked(table: Table, key: str, prefix: str, chosen: DataFrame, last) -> tuple[DataFrame, DataFrame]:
    """(the chosen rows, the profile of the columns), from one pass over the table.

    A further pass, over them alone, is made for columns with too few filled cells in the head.
    """
    head = None if last is None else not_after(table.df, table.order, last)
    rows = picked_rows(table.df, key, table.order, table.headers, prefix, chosen, head)
    order = [F.col(f"{prefix}_ord").getField(c).alias(c) for c in table.order]
    cells = [F.col(f"`{prefix}:{c}`").alias(c) for c in table.headers if c not in table.order]
    start = rows.where("_head").select(*order, *cells)
    kinds = profile_sample(table.df, table.headers, table.order, head=(start, last is None))
    return rows.where("_chosen").drop("_head", "_chosen"), kinds


def compare(
    reference: Table, candidate: Table, sample_size: int = DEFAULT_SAMPLE, cell_similarity: CellSimilarity | None = None
) -> dict:
    """Find the key, align the rows, map the columns and score them; the report as nested dicts.

    Each table is read three times, after a look at its first rows: for the key table of the
    columns that may be unique, from which uniqueness, overlaps, counts and the sample come; for
    the rows of the sample and of the head; and for the scores of the mapped columns. Only
    figures about columns reach the driver (one row per column or per pair of columns), and the
    bounded keys of the first rows; other rows and cells never do.
    """
    sample_size = max(sample_size, 0)
    ref, cand = reference, candidate
    left, right, figures, candidates = _find_keys(ref, cand)
    counts = {"reference_unique": figures.unique[0]}
    keys = _key_match(candidates)
    if not keys["found_usable_match"]:
        nothing = {
            "complete": False, "matched_rows": 0, "reference_rows": figures.rows[0], "candidate_rows": figures.rows[1],
            "coverage_reference": 0.0, "coverage_candidate": 0.0,
        }
        return _zero_report(ref, cand, sample_size, counts, keys, nothing)

    ref_key, cand_key = keys["reference_column"], keys["candidate_column"]
    alignment = _alignment(figures, ref_key, cand_key)
    sides = (ref.df, cand.df, ref_key, cand_key, ref.order, cand.order)
    # Key columns are unique, so every step takes the rows as they are.
    first_places = [lambda k=k: last_of_first(k.places(), HEAD_ROWS) for k in (left, right)]
    chosen, *lasts = _both(lambda: first_matches(left.of(ref_key), right.of(cand_key), sample_size or 1), *first_places)
    (ref_rows, ref_kinds), (cand_rows, cand_kinds) = _both(
        lambda: _picked(ref, ref_key, "ref", chosen, lasts[0]), lambda: _picked(cand, cand_key, "cand", chosen, lasts[1])
    )
    if sample_size:
        sample = ref_rows.join(cand_rows, "_key")
    else:
        sample = align_rows(*sides, ref.headers, cand.headers, unique=True)
    pairs = mapping_pairs(sample_similarity(sample, ref.headers, cand.headers), ref_kinds, cand_kinds)
    ranked_pairs = [_pair_fields(r.asDict()) for r in pairs.collect()]
    accepted = assign_columns(ranked_pairs)
    by_ref = {p["reference_column"]: p for p in accepted}
    used_cand = {p["candidate_column"] for p in accepted}
    mapping = {
        "mapping": by_ref,
        "reference_unmatched": [c for c in ref.headers if c not in by_ref],
        "candidate_unmatched": [c for c in cand.headers if c not in used_cand],
        "mapping_confidence_avg": (
            sum(p["mapping_confidence"] for p in accepted) / len(accepted) if accepted else 0.0
        ),
        "pair_candidates_top": ranked_pairs[:LISTED_PAIRS],
    }

    scored = {}
    if accepted:
        mapped = [(p["reference_column"], p["candidate_column"]) for p in accepted]
        aligned = align_rows(*sides, [m[0] for m in mapped], [m[1] for m in mapped], unique=True)
        scored = {r["reference_column"]: r for r in column_scores(aligned, mapped, cell_similarity).collect()}
    per_column = []
    for name in ref.headers:
        row, pair = scored.get(name), by_ref.get(name)
        if row is None:
            per_column.append({"reference_column": name, "similarity": 0.0, "matched": False})
            continue
        per_column.append(
            {
                "reference_column": name,
                "candidate_column": row["candidate_column"],
                "similarity": row["similarity"],
                "matched": True,
                "mapping_confidence": pair["mapping_confidence"],
                "row_count_scored": row["row_count_scored"],
                "header_similarity": pair["header_similarity"],
                "sample_similarity": pair["sample_similarity"],
            }
        )
    similarity = sum(c["similarity"] for c in per_column) / len(per_column) if per_column else 0.0
    scores = {
        "dataset_similarity_equal_weighted": similarity,
        "overall_score_with_coverage": similarity * alignment["coverage_reference"],
        "mapped_reference_columns": len(scored),
        "reference_columns_total": len(per_column),
        "per_reference_column": per_column,
    }
    status = OK if alignment["complete"] else PARTIAL
    return _report(ref, cand, status, sample_size, counts, keys, alignment, mapping, scores)


def report_frame(spark, report: dict) -> DataFrame:
    """The report as a one-row nested DataFrame."""
    rows = spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "report string")
    schema = " ".join(REPORT_SCHEMA.split())
    return rows.select(F.from_json("report", schema).alias("r")).select("r.*")


def summary_frame(spark, report: dict) -> DataFrame:
    return report_frame(spark, report).select("summary.*")


def report_rows(spark, report: dict) -> DataFrame:
    """The report in long form, (section, item, metric, value, text): one row per figure or name."""
    rows: list[tuple] = []

    def add(section: str, item: str, figures: dict) -> None:
        for metric, found in figures.items():
            if found is not None:
                word = isinstance(found, str)
                rows.append((section, item, metric, None if word else float(found), found if word else None))

    names = ("reference_column", "candidate_column")
    mapping, scores = report["column_mapping"], report["scores"]
    add("summary", "", report["summary"])
    for side in ("reference", "candidate"):
        add(f"{side}_profile", "", {k: v for k, v in report[f"{side}_profile"].items() if k != "unique_columns"})
        for column in mapping[f"{side}_unmatched"]:
            add(f"{side}_unmatched", column, {"unmatched": True})
    for column in report["reference_profile"]["unique_columns"]:
        add("reference_profile", column, {"unique": True})
    add("row_alignment", "", report["row_alignment"])
    for section, listed in (("key", report["key_match"]["candidates"]), ("pair", mapping["pair_candidates_top"])):
        for rank, pair in enumerate(listed, 1):
            add(section, "=".join(pair[n] for n in names), {"rank": rank, **{k: v for k, v in pair.items() if k not in names}})
    add("column_mapping", "", {"mapping_confidence_avg": mapping["mapping_confidence_avg"]})
    for column, pair in mapping["mapping"].items():
        add("column_mapping", column, {k: v for k, v in pair.items() if k != "reference_column"})
    for column in scores["per_reference_column"]:
        add("score", column["reference_column"], {k: v for k, v in column.items() if k != "reference_column"})
    add("scores", "", {k: v for k, v in scores.items() if k != "per_reference_column"})
    return spark.createDataFrame(rows, "section string, item string, metric string, value double, text string")


def write_report(spark, report: dict, path: str) -> None:
    """One JSON document with the whole report."""
    report_frame(spark, report).coalesce(1).write.mode("overwrite").json(path)
