"""The shared views as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.workloads import sql
from catalogq.workloads.registry import table


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("rating_count"), (F.avg("l_quantity") / 10).alias("rating_value")
    )
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return part.join(figures, part.p_partkey == figures.l_partkey, "left").select(
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("gtin"),
        F.col("p_partkey").alias("dan"),
        F.col("p_name").alias("name"),
        F.when(size % 17 == 0, " ").otherwise(F.col("p_brand")).alias("brand"),
        (F.col("p_retailprice") / 200).alias("price_eur"),
        F.lit("EUR").alias("currency"),
        F.when(size % 13 != 0, F.col("p_type")).alias("category_path"),
        F.when(size % 19 != 0, F.col("rating_value")).alias("rating_value"),
        "rating_count",
        (size % 10 == 0).alias("product_is_pharmacy"),
        (size % 7 == 0).alias("has_eyecatchers"),
        (size % 11 == 0).alias("has_pills"),
    )


def candidate(spark: SparkSession, sf_dir: str, made_from: DataFrame | None = None) -> DataFrame:
    """The candidate table; made_from: the products where they are written already."""
    dan, name, price = F.col("dan"), F.col("name"), F.col("price_eur")
    return (products(spark, sf_dir) if made_from is None else made_from).select(
        F.col("gtin").alias("gtin_code"),
        dan.alias("dan_code"),
        F.when(dan % 5 == 0, F.concat(name, F.lit("x"))).when(dan % 7 == 0, F.upper(name)).otherwise(name)
        .alias("product_name"),
        F.when(dan % 11 == 0, "").otherwise(F.col("brand")).alias("brand_name"),
        F.when(dan % 3 == 0, price + 0.5).otherwise(price).alias("price_eur_amt"),
        F.col("currency").alias("currency_code"),
        F.col("category_path").alias("category_tree"),
        F.col("rating_value").alias("rating_score"),
        F.col("rating_count").alias("reviews_count"),
        F.when(F.col("product_is_pharmacy"), "yes").otherwise("no").alias("is_pharmacy_product"),
    )


def odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with one cell in many spellings."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.expr(sql.ODD_CELL).alias("cell")
    )
