"""The clean table's layout, ranked pages and batch search: right rows, and how much is read for them."""

import random

import pytest
import scans
from pyspark.sql import functions as F

from catalogq.operators import catalogue, rankdir, topk
from catalogq.sources import layout, sinks


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    mixed = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    df = spark.range(60_000).select(
        F.format_string("40%011d", F.col("id") * 7919 % 60_013).alias("gtin"), mixed("d", 1 << 40).alias("dan"),
        F.format_string("brand %03d", mixed("b", 200)).alias("brand"),
        F.when(mixed("c", 300) > 0, F.format_string("é > %03d", mixed("c", 300))).alias("category_path"),
        F.format_string("name %s", mixed("n", 1000)).alias("name"), mixed("p", 1000).alias("rating_count"),
        F.lit(1.0).alias("rating_value"), F.lit(2.0).alias("price_eur"), F.lit("EUR").alias("currency"),
    )
    path = str(tmp_path_factory.mktemp("layout") / "clean-table")
    sinks.write_clean_table(df, path, row_group_bytes=16 << 10)
    return spark.read.parquet(path), df


@pytest.mark.parametrize("column", sinks.LOOKUP_COLUMNS)
def test_lookups_skip_most_of_the_table(spark, shop, column):
    table, made = shop
    row = made.where("category_path is not null").orderBy(F.xxhash64("gtin")).first()
    since = scans.last_execution(spark)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        found = catalogue.rows_with(table, column, row[column]).collect()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sorted(found) == sorted(made.where(F.col(column) == row[column]).select(*table.columns).collect())
    assert scans.rows_read(spark, "clean-table", since) < (60_000 * 0.1 if column in sinks.ID_COLUMNS else 60_000 * 0.5)


def test_the_clean_table_keeps_all_rows(shop):
    table, made = shop
    assert table.exceptAll(made).count() == 0 == made.exceptAll(table).count()


def test_range_numbers_equal_counting(spark):
    draw = random.Random(1)
    for values in ([draw.randrange(50) for _ in range(200)], [draw.choice("aé漢zB") * draw.randrange(3) for _ in range(200)], [None] * 5):
        kind = "long" if isinstance(values[0], int) else "string"
        df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
        bounds = layout.boundaries(df, ["v"], 4)["v"]
        key = (lambda v: v.encode()) if kind == "string" else (lambda v: v)
        assert [key(b) for b in bounds] == sorted({key(b) for b in bounds}) and len(bounds) < 16
        got = df.select("v", layout.range_number(F.col("v"), bounds, 4).alias("n")).collect()
        assert all(r["n"] == sum(r["v"] is not None and key(b) <= key(r["v"]) for b in bounds) for r in got)


def test_bits_in_turn(spark):
    df = spark.createDataFrame([(0b101, 0b011)], "a int, b int")
    assert df.select(layout.interleaved([F.col("a"), F.col("b")], 3).alias("z")).first()["z"] == 0b10_01_11


def test_empty_table_and_other_columns(spark, tmp_path):
    df = spark.createDataFrame([], "gtin string, brand string")
    sinks.write_clean_table(df, str(tmp_path / "empty"))
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "empty")).count() == 0
    sinks.write_clean_table(spark.range(3), str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 3


def test_a_deep_page_reads_two_ranges(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"), (F.col("id") % 10).alias("few"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = rankdir.ranked(df, [(F.col("few"), True), (F.col("k"), False)], "deep-pages")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(((r["few"], r["k"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert made.total == 100_000 and len(made.parts) == 8
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        for page in (0, 1, 4_999, 9_999, 10_000):
            since = scans.last_execution(spark)
            got = [(r["few"], r["k"]) for r in made.page(page * 10, 10).collect()]
            assert got == rows[page * 10 : page * 10 + 10]
            assert len(range(*made.ranges(page * 10, 10))) <= 2
            assert scans.rows_read(spark, "deep-pages", since) <= 2 * 100_000 / 4
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    edge = made.ends[2] - 3
    assert [(r["few"], r["k"]) for r in made.page(edge, 10).collect()] == rows[edge : edge + 10]
    assert made.page(5, 0).collect() == [] == rankdir.ranked(df.where("false"), [(F.col("k"), False)]).page(0, 5).collect()


def test_deep_search_pages_equal_near_ones(shop, monkeypatch):
    _, made = shop
    near = catalogue.search(made, "name 1", page=3, page_size=20)
    monkeypatch.setattr(catalogue, "NEAR_ROWS", 30)
    deep = catalogue.search(made, "name 1", page=3, page_size=20)
    assert deep.total == near.total > 60 and [tuple(r) for r in deep.items.collect()] == [tuple(r) for r in near.items.collect()]


def test_common_pieces_bring_no_rows(spark):
    """The piece "pro" stands in every name: queries that begin with it probe with rarer ones."""
    rows = [(f"g{i:05}", f"product {i:05} " + ("rare" if i % 500 == 0 else "usual"), "b", "c") for i in range(5_000)]
    shop = spark.createDataFrame([(*r, 1.0, "EUR", 1.0, 1) for r in rows], "gtin string, name string, brand string, "
                                 "category_path string, price_eur double, currency string, rating_value double, rating_count int")  # fmt: skip
    asked = ["product 00017", "product 04999", "00500 rare", "produkt", "product 9999", " rare"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    pairs = catalogue.candidate_pairs(shop, queries)
    hits = catalogue.query_hits(shop, queries)
    want = {(r[0], q.strip()) for q in asked for r in rows if q.strip() in r[1]}
    assert {(r["gtin"], r["query"]) for r in hits.collect()} == want and hits.count() == len(want)
    assert pairs.count() <= 20 * len(want)


def test_hits_with_repeated_and_null_ids(spark):
    rows = [("a", "red box"), ("a", "blue box"), (None, "red hat"), ("a", "red box")]
    shop = spark.createDataFrame([(*r, "", "", 1.0, "EUR", 1.0, 1) for r in rows], "gtin string, name string, brand string, "
                                 "category_path string, price_eur double, currency string, rating_value double, rating_count int")  # fmt: skip
    hits = catalogue.query_hits(shop, spark.createDataFrame([("red",), ("BOX",), ("xyz",), ("re",), (None,)], "query string"))
    assert sorted((str(r["gtin"]), r["name"], r["query"]) for r in hits.collect()) == sorted(
        [("a", "red box", "red")] * 2 + [("None", "red hat", "red"), ("a", "blue box", "BOX")] + [("a", "red box", "BOX")] * 2
    )


def test_many_tasks_and_few_shuffle_partitions(spark):
    rows = spark.range(0, 60_000, 1, 1_500).select((F.col("id") * 7919 % 60_000).alias("x"), (F.col("id") % 2).alias("g"))
    buckets = rows.groupBy(topk._task_bucket().alias("b")).agg(F.count_distinct(F.spark_partition_id()).alias("tasks")).collect()
    assert len(buckets) == 39 and max(r["tasks"] for r in buckets) <= 77
    assert [r["x"] for r in topk.first_n(rows, [F.col("x")], 50).collect()] == list(range(50))
    top = topk.top_per_group(rows, ["g"], [F.col("x").desc()], 3, "rank").collect()
    want = {(g, i + 1): x for g in (0, 1) for i, x in enumerate(sorted((v * 7919 % 60_000 for v in range(g, 60_000, 2)), reverse=True)[:3])}
    assert {(r["g"], r["rank"]): r["x"] for r in top} == want
