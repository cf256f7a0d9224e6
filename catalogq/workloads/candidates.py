"""Queries that make candidate tables: shuffle, rename, sample, perturb, and file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.functions import display
from catalogq.operators import perturb
from catalogq.operators.rowindex import with_position
from catalogq.session import new_folder
from catalogq.sources import sinks, tables
from catalogq.workloads import sql
from catalogq.workloads.registry import query, table
from catalogq.workloads.views import products

RENAMED = {
    "gtin": "gtin_code",
    "dan": "dan_code",
    "name": "product_name",
    "brand": "brand_name",
    "price_eur": "price_eur_amt",
    "currency": "currency_code",
    "category_path": "category_tree",
    "rating_value": "rating_score",
    "rating_count": "reviews_count",
    "product_is_pharmacy": "is_pharmacy_product",
    "has_eyecatchers": "is_highlights",
    "has_pills": "is_badges",
}


@query(
    "make_candidate",
    f"SELECT {', '.join(f'{old} AS {new}' for old, new in RENAMED.items())}, "
    f"row_number() OVER (ORDER BY sha256('42:' || gtin), gtin) - 1 AS place FROM ({sql.PRODUCTS})",
)
def make_candidate(spark: SparkSession, d: str) -> DataFrame:
    made, _ = perturb.make_candidate(products(spark, d), list(RENAMED), ["gtin"])
    return with_position(made, ["_ord"], "place").drop("_ord")


@query(
    "make_candidate_sample",
    f"SELECT {', '.join(f'{old} AS {new}' for old, new in RENAMED.items())} FROM ({sql.PRODUCTS}) "
    f"ORDER BY sha256('7:' || gtin), gtin LIMIT 100",
)
def make_candidate_sample(spark: SparkSession, d: str) -> DataFrame:
    made, _ = perturb.make_candidate(products(spark, d), list(RENAMED), ["gtin"], seed=7, sample_rows=100)
    return made.drop("_ord")


# Header names spelled from the data, so that the renaming runs over a whole table.
@query(
    "rename_headers",
    " UNION ALL ".join(
        f"SELECT '{old}' AS old_name, '{new}' AS new_name, count({old}) AS filled FROM ({sql.PRODUCTS})"
        for old, new in RENAMED.items()
    )
    + f" UNION ALL SELECT 'is_pills', 'is_badges_2', count(has_pills) FROM ({sql.PRODUCTS})",
)
def rename_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = products(spark, d).withColumn("is_pills", F.col("has_pills"))
    names = perturb.renamed_headers(rows.columns)
    renamed = rows.withColumnsRenamed(names)
    counts = renamed.agg(*[F.count(c).alias(c) for c in renamed.columns])
    entries = [
        F.struct(F.lit(old).alias("old_name"), F.lit(new).alias("new_name"), F.col(new).alias("filled"))
        for old, new in names.items()
    ]
    return counts.select(F.inline(F.array(*entries)))


@query("perturb_drop", "SELECT p_partkey, p_name, '' AS p_brand, '' AS p_type, p_retailprice FROM part")
def perturb_drop(spark: SparkSession, d: str) -> DataFrame:
    return perturb.drop_columns(table(spark, d, "part"), ["p_size"], ["p_brand", "p_type", "p_size"])


@query("perturb_noise", "SELECT o_orderkey, 'noise_' || lpad(CAST(o_orderkey AS VARCHAR), "
       "CAST(greatest(3, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS extra_noise FROM orders")
def perturb_noise(spark: SparkSession, d: str) -> DataFrame:
    return perturb.add_noise_column(table(spark, d, "orders").select("o_orderkey"), "extra_noise", F.col("o_orderkey"))


@query(
    "perturb_numbers",
    "SELECT o_orderkey, CASE WHEN contains(CAST(o_totalprice AS VARCHAR), '.') THEN CAST(o_totalprice AS VARCHAR) || '00' "
    "ELSE CAST(o_totalprice AS VARCHAR) || '.0' END AS o_totalprice, CAST(o_custkey AS VARCHAR) || '.0' AS o_custkey FROM orders",
)
def perturb_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return perturb.pad_numbers(rows, ["o_totalprice", "o_custkey"])


@query("perturb_duplicate", "SELECT o_orderkey, o_custkey FROM orders UNION ALL "
       "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def perturb_duplicate(spark: SparkSession, d: str) -> DataFrame:
    doubled = perturb.duplicate_rows(
        table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
        F.col("o_orderpriority") == "1-URGENT",
    )
    return doubled.drop("o_orderpriority")


@query("perturb_remove", "SELECT * FROM supplier WHERE s_nationkey <> 7")
def perturb_remove(spark: SparkSession, d: str) -> DataFrame:
    return perturb.remove_rows(table(spark, d, "supplier"), F.col("s_nationkey") == 7)


@query("perturb_set_cell", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'changed' ELSE c_name END AS c_name, "
       "c_mktsegment FROM customer")
def perturb_set_cell(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return perturb.set_cell(rows, F.col("c_mktsegment") == "BUILDING", "c_name", F.lit("changed"))


@query("csv_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), "
       "chr(13), chr(10)) AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "csv")
    sinks.write_csv(table(spark, d, "documents"), path)
    return tables.read_csv(spark, path, newlines=True).drop("_ord")


# Line items as a CSV file shows them: floats with a point, booleans as words, missing as nothing.
@query(
    "csv_cells",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS quantity, "
    "CASE WHEN l_linenumber = 2 THEN '' ELSE CAST(l_extendedprice AS VARCHAR) END AS price_eur, "
    "CASE WHEN l_linenumber = 1 THEN '' WHEN l_discount > 0.05 THEN 'True' ELSE 'False' END AS discounted FROM lineitem",
)
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_quantity").alias("quantity"),
        F.when(line != 2, F.col("l_extendedprice")).alias("price_eur"),
        F.when(line != 1, F.col("l_discount") > 0.05).alias("discounted"),
    )
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[sinks.csv_cell(rows, c) for c in ("quantity", "price_eur", "discounted")],
    )


@query("clean_table_roundtrip", f"SELECT * FROM ({sql.PRODUCTS})")
def clean_table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "table")
    sinks.write_clean_table(products(spark, d), path)
    return tables.read_table(spark, path, "gtin")


# Prices from 1e-12 to 1e30: the digits name the same double without exponent, and prices up to 2^63 are rounded exactly.
SCALES = (1e-15, 1e-8, 1e-3, 1e5, 1e12, 1e18, 1e25)
_SCALED = "l_extendedprice * CASE l_linenumber " + " ".join(
    f"WHEN {i} THEN CAST('{x!r}' AS DOUBLE)" for i, x in enumerate(SCALES, 1)
) + " END"


@query(
    "csv_extreme_numbers",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_SCALED} AS price, true AS plain, "
    f"CASE WHEN l_linenumber <= 5 THEN printf('%.2f', {_SCALED}) END AS shown FROM lineitem",
)
def csv_extreme_numbers(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    scale = F.get(F.array(*[F.lit(x) for x in SCALES]), (line - 1).cast("int"))
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_extendedprice").cast("double") * scale).alias("price")
    )
    text = sinks.csv_cell(rows.withColumnRenamed("price", "price_eur"), "price_eur")
    written = rows.withColumnRenamed("price", "price_eur").select("*", text.alias("_text"))
    return written.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("_text").cast("double").alias("price"),
        F.rlike("_text", F.lit(r"^(0|[1-9]\d*)\.(0|\d*[1-9])$")).alias("plain"),
        F.when(line <= 5, display.fixed_point(F.col("price_eur"), 2)).alias("shown"),
    )
