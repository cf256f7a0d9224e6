"""End-to-end comparison of synthetic products, and row alignment alone."""

import fixtures
import pytest
from pyspark.sql import functions as F

from catalogq.operators import perturb
from catalogq.operators.align import align_rows, alignment_counts
from catalogq.operators.mapping import assign_columns
from catalogq.plans.compare import Table, compare, report_frame, write_report

EXACT = 1e-12


@pytest.fixture(scope="module")
def ref(spark):
    table = fixtures.reference(spark)
    return Table(table.df.cache(), table.order, table.columns, table.path)


@pytest.fixture(scope="module")
def cand(spark):
    table = fixtures.candidate(spark)
    return Table(table.df.cache(), table.order, path=table.path)


def figures(report):
    s = report["summary"]
    return (
        s["dataset_similarity_equal_weighted"], s["coverage_reference"], s["coverage_candidate"],
        s["overall_score_with_coverage"],
    )


def close(*values):
    return pytest.approx(values, abs=EXACT)


def test_renamed_and_shuffled_candidate_is_a_full_match(ref, cand):
    report = compare(ref, cand)
    assert report["status"] == "ok"
    assert figures(report) == close(1, 1, 1, 1)
    assert report["scores"]["mapped_reference_columns"] == 41
    assert report["key_match"]["reference_column"] == "gtin"
    assert report["key_match"]["candidate_column"] == "gtin_code"
    assert report["column_mapping"]["mapping"]["category_path"]["candidate_column"] == "category_tree"


def test_one_changed_character_is_seen_exactly(ref, cand):
    """One edit in a cell of n characters costs 1 / (n * columns * rows)."""
    target = cand.df.where("details_material <> ''").orderBy("gtin_code").first()
    key, text = target["gtin_code"], target["details_material"]
    df = perturb.set_cell(cand.df, F.col("gtin_code") == key, "details_material", F.lit("X" + text[1:]))
    report = compare(ref, fixtures.changed(cand, df))
    expected = 1 - 1 / (len(text) * 41 * 500)
    assert report["status"] == "ok"
    assert 0.9999 < expected < 1
    assert figures(report) == close(expected, 1, 1, expected)


def test_subset_keeps_similarity_and_lowers_coverage(spark, ref):
    report = compare(ref, fixtures.candidate(spark, sample=100))
    assert report["status"] == "partial_key_match"
    assert report["key_match"]["match_mode"] == "partial"
    assert figures(report) == close(1, 0.2, 1, 0.2)


def test_missing_row(ref, cand):
    key = cand.df.agg(F.min("gtin_code")).first()[0]
    report = compare(ref, fixtures.changed(cand, perturb.remove_rows(cand.df, F.col("gtin_code") == key)))
    assert report["status"] == "partial_key_match"
    assert figures(report) == close(1, 499 / 500, 1, 499 / 500)


def test_no_usable_key(ref, cand):
    df = perturb.drop_columns(cand.df, ["gtin_code", "dan_code"], [c for c in cand.headers])
    report = compare(ref, fixtures.changed(cand, df))
    assert report["status"] == "no_complete_key_match"
    assert not report["key_match"]["found_usable_match"]
    assert figures(report) == close(0, 0, 0, 0)
    assert report["scores"]["per_reference_column"][0]["reason"] == "no_complete_key_match"
    assert report["column_mapping"]["reference_unmatched"] == list(ref.columns)


def test_negative_sample_size_means_all_rows(ref, cand):
    report = compare(ref, cand, sample_size=-5)
    assert report["status"] == "ok"
    assert report["config"]["sample_size_mapping"] == 0
    assert report["scores"]["dataset_similarity_equal_weighted"] == pytest.approx(1, abs=EXACT)


def test_missing_column_scores_zero(ref, cand):
    report = compare(ref, fixtures.changed(cand, perturb.drop_columns(cand.df, ["rating_score"])))
    column = {c["reference_column"]: c for c in report["scores"]["per_reference_column"]}["rating_value"]
    assert report["status"] == "ok"
    assert report["scores"]["mapped_reference_columns"] == 40
    assert not column["matched"] and column["similarity"] == 0
    assert figures(report)[1:3] == close(1, 1)
    assert report["scores"]["dataset_similarity_equal_weighted"] == pytest.approx(40 / 41, abs=EXACT)


def test_extra_column_does_not_count(ref, cand):
    noisy = perturb.add_noise_column(cand.df, "extra_noise", F.pmod(F.xxhash64("gtin_code"), F.lit(1000)))
    report = compare(ref, fixtures.changed(cand, noisy))
    assert report["status"] == "ok"
    assert report["scores"]["dataset_similarity_equal_weighted"] == pytest.approx(1, abs=EXACT)
    assert "extra_noise" in report["column_mapping"]["candidate_unmatched"]


def test_longer_spelling_of_numbers_is_equal(ref, cand):
    padded = perturb.pad_numbers(cand.df, ["price_eur_amt", "rating_score"])
    report = compare(ref, fixtures.changed(cand, padded))
    assert report["status"] == "ok"
    assert report["scores"]["dataset_similarity_equal_weighted"] == pytest.approx(1, abs=EXACT)


def test_cell_empty_on_both_sides_is_equal(ref, cand):
    key = ref.df.agg(F.min("gtin")).first()[0]
    left = perturb.set_cell(ref.df, F.col("gtin") == key, "brand", F.lit(""))
    right = perturb.set_cell(cand.df, F.col("gtin_code") == key, "brand_name", F.lit("  "))
    report = compare(Table(left, ref.order, ref.columns), fixtures.changed(cand, right))
    assert report["status"] == "ok"
    assert report["scores"]["dataset_similarity_equal_weighted"] == pytest.approx(1, abs=EXACT)


def test_duplicate_candidate_key(ref, cand):
    key = cand.df.agg(F.min("gtin_code")).first()[0]
    df = perturb.duplicate_rows(cand.df, F.col("gtin_code") == key)
    counts = alignment_counts(ref.df, df, "gtin", "gtin_code").first()
    assert not counts["complete"]
    assert counts["duplicate_candidate_matches"] == 1
    assert counts["coverage_reference"] == 1 and counts["coverage_candidate"] < 1


def test_duplicate_reference_key(ref, cand):
    key = ref.df.agg(F.min("gtin")).first()[0]
    df = perturb.duplicate_rows(ref.df, F.col("gtin") == key)
    counts = alignment_counts(df, cand.df, "gtin", "gtin_code").first()
    assert not counts["complete"]
    assert counts["duplicate_reference_keys"] == 1
    assert counts["coverage_reference"] < 1 and counts["coverage_candidate"] == 1


def test_other_key_is_found_without_gtin(ref, cand):
    report = compare(ref, fixtures.changed(cand, perturb.drop_columns(cand.df, ["gtin_code"])))
    assert report["status"] == "ok"
    assert report["key_match"]["candidate_column"] == "dan_code"
    assert figures(report)[1:3] == close(1, 1)
    assert report["scores"]["mapped_reference_columns"] == 40
    assert report["scores"]["dataset_similarity_equal_weighted"] < 1


def test_published_figures_follow_from_one_edit_and_from_a_sample():
    """31,953 rows of 41 columns: one edit in 47 characters, and a sample of 100 rows."""
    assert 1 - 1 / 47 / 41 / 31953 == pytest.approx(0.9999999837592288, abs=1e-15)
    assert 100 / 31953 == pytest.approx(0.0031295965949989044, abs=1e-17)


def test_first_row_of_a_key_wins(spark):
    left = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (" ", 4), (None, 5)], "k string, n int")
    right = spark.createDataFrame([("A", 1), (" a ", 7), ("a", 6), ("b", 9), ("", 8)], "k string, n int")
    pairs = align_rows(left, right, "k", "k", ["n"], ["n"]).select("ref_ord.n", "cand_ord.n").collect()
    assert sorted(tuple(p) for p in pairs) == [(1, 6), (2, 9)]
    counts = alignment_counts(left, right, "k", "k").first()
    assert (counts["matched_rows"], counts["duplicate_reference_keys"]) == (2, 1)
    assert (counts["duplicate_candidate_matches"], counts["missing_candidate_keys"]) == (1, 2)


def test_assignment_takes_best_pairs_first_and_refuses_weak_ones():
    def pair(ref, cand, confidence, sample):
        return {"reference_column": ref, "candidate_column": cand, "mapping_confidence": confidence, "sample_similarity": sample}

    ranked = [
        pair("a", "x", 0.9, 0.9), pair("a", "y", 0.8, 0.9), pair("b", "x", 0.7, 0.9), pair("b", "y", 0.5, 0.9),
        pair("c", "z", 0.5, 0.5),
    ]
    assert [(p["reference_column"], p["candidate_column"]) for p in assign_columns(ranked)] == [("a", "x"), ("b", "y")]


def test_report_is_one_json_document(spark, ref, cand, tmp_path):
    report = compare(ref, cand)
    write_report(spark, report, str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report"))
    assert back.count() == 1
    assert back.first()["summary"]["status"] == "ok"
    frame = report_frame(spark, report).first()
    assert frame["key_match"]["candidates"][0]["complete_set_match"]
    assert len(frame["column_mapping"]["pair_candidates_top"]) == 50
    assert frame["column_mapping"]["mapping"]["gtin"]["candidate_column"] == "gtin_code"


def test_own_cell_similarity(ref, cand):
    report = compare(ref, cand, cell_similarity=lambda a, b: F.lit(0.5))
    assert report["scores"]["dataset_similarity_equal_weighted"] == pytest.approx(0.5, abs=EXACT)


def test_empty_tables(ref, cand):
    report = compare(Table(ref.df.where("false"), ref.order, ref.columns), cand)
    assert report["status"] == "no_complete_key_match"
    assert report["summary"]["reference_rows"] == 0 and report["summary"]["candidate_rows"] == 500


def test_sparse_columns_are_sampled_from_the_whole_table(spark):
    """A column that is empty in the first rows still gives its first 500 cells."""
    from catalogq.operators.profile import profile_sample

    late = F.when(F.col("id") >= 2_500, F.when(F.col("id") < 2_700, F.lit("yes")).otherwise(F.lit("abc")))
    df = spark.range(4_000).select("id", F.lit("7").alias("dense"), late.alias("late"), F.lit(" ").alias("never"))
    got = {r["column"]: tuple(r)[2:] for r in profile_sample(df.repartition(5), ["dense", "late", "never"], ["id"]).collect()}
    assert got == {"dense": (1.0, 0.0, 1.0, 1.0), "late": (0.0, 0.4, 3.0, 3.0), "never": (0.0, 0.0, 0.0, 0.0)}


@pytest.mark.parametrize("start", [0, 3_000])
def test_sample_is_the_first_aligned_rows(spark, start):
    """The same pairs whether the first reference rows hold enough of them or none."""
    from catalogq.operators.mapping import sample_rows

    left = spark.range(5_000).select("id", F.format_string("k%d", F.col("id")).alias("k"))
    right = left.where(F.col("id") >= start).select((-F.col("id")).alias("n"), F.upper("k").alias("u"), F.col("k").alias("k2"))
    rows = sample_rows(left, right, "k", "k2", ["id"], ["n"], ["k"], ["u"], 100).collect()
    assert sorted(r["ref_ord"]["id"] for r in rows) == list(range(start, start + 100))
    assert all(r["ref:k"].upper() == r["cand:u"] for r in rows)
