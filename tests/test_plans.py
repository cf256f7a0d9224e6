"""The physical plans are the ones meant for large inputs."""

import re

import pytest
from pyspark.sql import functions as F

from catalogq.workloads import QUERIES
from catalogq.operators import align, catalogue, profile
from catalogq.plans import reference
from catalogq.workloads.registry import table
from catalogq.workloads.views import products


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_of_all_rows_and_no_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoop|EvalPython|InPandas|PythonUDF", text)


def test_lookup_reaches_the_scan(spark, sf_dir):
    text = plan(catalogue.find_by_id(table(spark, sf_dir, "customer"), "c_custkey", "7"))
    assert "EqualTo(c_custkey,7)" in text


def test_feeds_read_the_catalogue_once_and_cut_groups_before_the_shuffle(spark, sf_dir):
    path = f"{sf_dir}/part.parquet"
    part = spark.read.parquet(path).select(
        F.col("p_partkey").alias("gtin"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price_eur"), F.lit("EUR").alias("currency"), F.col("p_type").alias("category_path"),
        F.col("p_size").alias("rating_value"), F.col("p_size").alias("rating_count"),
        *[F.lit(True).alias(c) for c in ("product_is_pharmacy", "has_eyecatchers", "has_pills")],
    )
    text = plan(catalogue.section_feeds(part))
    assert text.count("FileScan") == 1
    assert text.index("WindowGroupLimit [section_position") < text.index("Exchange") < text.rindex("WindowGroupLimit [section_position")


def test_similar_items_are_joined_by_size(spark, sf_dir):
    text = plan(catalogue.similar_items(products(spark, sf_dir)))
    assert text.count("BroadcastHashJoin [_category_path") == text.count("BroadcastHashJoin [_brand") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalogue.similar_items(products(spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"SortMergeJoin \[_(?:category_path|brand)#", text)) == 2


def test_first_rows_come_together_in_two_levels(spark):
    from catalogq.operators.topk import first_n

    rows = spark.range(0, 5000, 1, 20).select((F.col("id") * 7919 % 5000).alias("x"))
    for n in (3, 4000):
        first = first_n(rows, [F.col("x")], n)
        assert len(re.findall("Exchange hashpartitioning", plan(first))) == 1
        assert [r["x"] for r in first.collect()] == list(range(n))


def test_alignment_shuffles_each_side_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
        text = plan(align.align_rows(orders, events, "o_custkey", "user_id", ["o_orderkey"], ["event_id"], ["o_totalprice"], ["value"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in text
    assert text.count(", Partial") == 2
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_profile_reads_only_its_columns(spark, sf_dir):
    text = plan(profile.profile_counts(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey"]))
    assert "ReadSchema: struct<c_name:string,c_nationkey:int>" in text
    assert "partial_count" in text


def test_dedupe_cuts_products_before_the_shuffle(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("gtin"), F.col("ts").alias(reference.SCRAPED_AT), F.col("event_id").alias("dan"),
        F.col("event_id").alias("_ord"),
    )
    assert re.search(r"WindowGroupLimit \[_product.*Partial", plan(reference.dedupe_latest(events)))


def test_search_page_is_a_top_k(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gtin"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price_eur"), F.lit("EUR").alias("currency"), F.col("p_type").alias("category_path"),
        F.col("p_size").alias("rating_value"), F.col("p_size").alias("rating_count"),
    )
    text = plan(catalogue.search_items(part, "red", page=2))
    assert "TakeOrderedAndProject" in text and re.findall(r"Exchange \w+\(?\w*", text) == ["Exchange hashpartitioning(_bucket"]
