"""Key tables against counting by plain loops, and how often a comparison reads its tables."""

import random

import fixtures
import pytest
import scans
from pyspark.sql import functions as F

from catalogq.operators import keytable
from catalogq.operators.keymatch import key_overlap
from catalogq.operators.profile import profile_counts
from catalogq.plans.compare import compare
from catalogq.sources.tables import parquet_table


def table(spark, seed, rows=300):
    draw = random.Random(seed)
    made = []
    for i in range(rows):
        made.append(
            (
                f"K{i}", str(i) if i % 7 else f" {i}.0 ", draw.choice("abc"), None if i % 3 else f"{i} only", "x" * 90 + str(i),
                "", f"{min(i, rows - 2)}", draw.choice(["yes", "1", "TRUE"]), i,
            )
        )
    return spark.createDataFrame(made, "id string, num string, few string, gaps string, long string, void string, once string, flag string, place long")


COLUMNS = ["id", "num", "few", "gaps", "long", "void", "once", "flag"]


def test_figures_equal_the_exact_counts(spark):
    left, right = table(spark, 1), table(spark, 2, 200).withColumnRenamed("id", "ident")
    others = ["ident", *COLUMNS[1:]]
    a, b = keytable.key_table(left, ["place"], COLUMNS), keytable.key_table(right, ["place"], others)
    figures = keytable.key_figures(a, b)
    unique = []
    for side, (df, columns) in enumerate(((left, COLUMNS), (right, others))):
        counts = {r["column"]: r for r in profile_counts(df, columns).collect()}
        assert figures.rows[side] == df.count()
        assert figures.filled[side] == {c: counts[c]["non_empty_count"] for c in columns}
        unique.append([c for c in columns if counts[c]["is_unique"]])
        assert list(figures.unique[side]) == unique[side] == keytable.exactly_unique((a, b)[side])
        assert set(unique[side]) <= set(keytable.may_be_unique(df, columns))
    assert "once" not in unique[0] and "gaps" in unique[0] and "long" in unique[0]
    overlap = {tuple(r)[:2]: r[2] for r in key_overlap(left, unique[0], right, unique[1]).collect()}
    assert figures.overlaps == overlap


def test_early_repeats_are_proofs(spark):
    df = table(spark, 3)
    assert keytable.repeated_early(df, COLUMNS) == ["few", "once", "flag"]
    assert keytable.repeated_early(df.limit(2), ["id", "void"]) == []
    assert keytable.repeated_early(df.where("false"), COLUMNS) == [] == keytable.repeated_early(df, [])


def test_the_sketch_never_rules_out_a_unique_column(spark):
    df = spark.range(60_000).select(
        F.col("id"), F.when(F.col("id") > 0, F.col("id")).otherwise(1).alias("twice"), (F.col("id") % 30_000).alias("half")
    )
    assert keytable.may_be_unique(df, ["id", "twice", "half"]) == ["id", "twice"]
    assert keytable.exactly_unique(keytable.key_table(df, ["id"], ["id", "twice", "half"])) == ["id"]


def test_nothing_but_columns_that_may_be_unique_is_shuffled(spark):
    df = table(spark, 4)
    made = keytable.key_table(df, ["place"], [c for c in COLUMNS if c not in keytable.repeated_early(df, COLUMNS)])
    assert made.columns == ["id", "num", "gaps", "long", "void"]
    assert made.of("num").where("key = '7'").first()["place"]["place"] == 7
    assert made.places().count() == 300


@pytest.mark.parametrize("sample_size", [256, 10])
def test_a_comparison_reads_each_table_three_times(spark, tmp_path, sample_size):
    """The look at the first rows apart, which reads at most PROBE_ROWS of them."""
    sides = {"reference-table": fixtures.reference(spark), "candidate-table": fixtures.candidate(spark)}
    for name, side in sides.items():
        side.df.select(*side.headers, *[c for c in side.order if c not in side.headers]).repartition(3).write.parquet(str(tmp_path / name))
    tables = [parquet_table(spark, str(tmp_path / n), order=s.order, columns=s.headers) for n, s in sides.items()]
    since = scans.last_execution(spark)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # else the record cuts the path
    try:
        report = compare(*tables, sample_size)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert report["status"] == "ok" and report["summary"]["dataset_similarity_equal_weighted"] == pytest.approx(1)
    for name, made in zip(sides, tables):
        rows, read = made.df.count(), scans.rows_read(spark, name, since)
        assert 3 * rows <= read <= 3 * rows + min(rows, keytable.PROBE_ROWS)
