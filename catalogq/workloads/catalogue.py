"""Queries over the product catalogue: feeds, similar items, search, shards, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.functions import display
from catalogq.operators import catalogue as ops
from catalogq.plans import pages
from catalogq.workloads import sql
from catalogq.workloads.registry import query, table
from catalogq.workloads.views import products

BASE_URL = "https://shop.example"
ITEM_SQL = (
    "coalesce(gtin, '') AS gtin, coalesce(name, '') AS name, coalesce(brand, '') AS brand, "
    "coalesce(price_eur, 0.0) AS price_eur, coalesce(currency, '') AS currency, "
    "coalesce(category_path, '') AS category_path, coalesce(rating_value, 0.0) AS rating_value, "
    "coalesce(rating_count, 0) AS rating_count"
)
BY_VALUE = "rating_value DESC NULLS LAST, rating_count DESC NULLS LAST, price_eur ASC, gtin ASC"
BY_COUNT = "rating_count DESC NULLS LAST, rating_value DESC NULLS LAST, price_eur ASC, gtin ASC"
SECTION_SQL = (
    (0, "price_eur IS NOT NULL AND rating_count >= 20", BY_VALUE),
    (1, "price_eur IS NOT NULL AND rating_count >= 1", BY_COUNT),
    (2, "price_eur IS NOT NULL AND price_eur <= 5 AND rating_count >= 5", BY_VALUE),
    (3, "price_eur IS NOT NULL AND product_is_pharmacy", BY_VALUE),
    (4, "price_eur IS NOT NULL AND (has_eyecatchers OR has_pills)", BY_COUNT),
)
FEEDS_SQL = f"WITH products AS ({sql.PRODUCTS}) " + " UNION ALL ".join(
    f"SELECT {i} AS section_position, '{ops.SECTIONS[i][0]}' AS section_id, '{ops.SECTIONS[i][1]}' AS title, "
    f"'{ops.SECTIONS[i][2]}' AS description, rank, {ITEM_SQL}, '/product/' || gtin AS product_path, "
    f"'/api/product/' || gtin AS api_path FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank "
    f"FROM products WHERE {where}) WHERE rank <= 12"
    for i, where, order in SECTION_SQL
)


@query("section_feeds", FEEDS_SQL)
def section_feeds(spark: SparkSession, d: str) -> DataFrame:
    return ops.section_feeds(products(spark, d))


@query(
    "section_counts",
    f"SELECT section_id, title, count(*) AS item_count FROM ({FEEDS_SQL}) GROUP BY 1, 2",
)
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.home_payload(ops.section_feeds(products(spark, d))).select("section_id", "title", "item_count")


# Every product against every other of its category or brand: what the short lists must equal.
SIMILAR_SQL = f"""WITH products AS ({sql.PRODUCTS}),
 driver AS (SELECT gtin AS id, nullif(trim(category_path), '') AS c, nullif(trim(brand), '') AS b FROM products),
 pairs AS (SELECT d.id, coalesce(p.category_path = d.c, false) AS same_category, p.*
  FROM driver d JOIN products p ON (p.category_path = d.c OR p.brand = d.b) AND p.gtin <> d.id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY same_category DESC,
  rating_value DESC NULLS LAST, rating_count DESC NULLS LAST, gtin) AS rank FROM pairs)
 SELECT id, rank, {ITEM_SQL} FROM ranked WHERE rank <= 8"""


@query("similar_items", SIMILAR_SQL)
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    return ops.similar_items(products(spark, d))


def _search_sql(needle: str, source: str) -> str:
    """Matches of a needle with their rank, from `source` that holds product columns."""
    hit = " OR ".join(f"contains(lower(coalesce({f}, '')), {needle})" for f in ops.SEARCH_FIELDS)
    prefix = ", ".join(
        f"CASE WHEN starts_with(lower(coalesce({f}, '')), {needle}) THEN 0 ELSE 1 END" for f in ops.SEARCH_FIELDS
    )
    return hit, f"{prefix}, rating_count DESC NULLS LAST, rating_value DESC NULLS LAST, name, gtin"


SHOWN_SQL = ITEM_SQL.replace("coalesce(gtin, '') AS gtin", "gtin AS id") + ", '/product/' || gtin AS product_path"
_HIT, _ORDER = _search_sql("'red'", "products")


@query(
    "search_page",
    f"WITH products AS ({sql.PRODUCTS}) SELECT {SHOWN_SQL} FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank "
    f"FROM products WHERE {_HIT}) WHERE rank > 10 AND rank <= 20",
)
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return ops.search(products(spark, d), " ReD ", page=2).items


# A page near the end of a long result, read from the ranges that hold it.
_DEEP, _DEEP_ORDER = _search_sql("'brand'", "products")


@query(
    "search_deep_page",
    f"WITH products AS ({sql.PRODUCTS}), ranked AS (SELECT *, row_number() OVER (ORDER BY {_DEEP_ORDER}) AS rank, "
    f"count(*) OVER () AS total FROM products WHERE {_DEEP}) SELECT {SHOWN_SQL} FROM ranked "
    f"WHERE rank > 7 * CAST(floor(total * 0.9 / 7) AS BIGINT) AND rank <= 7 * CAST(floor(total * 0.9 / 7) AS BIGINT) + 7",
)
def search_deep_page(spark: SparkSession, d: str) -> DataFrame:
    matches = ops.ranked_matches(products(spark, d), "Brand")
    return ops.ranked_page(matches, int(matches.total * 0.9 / 7) + 1, 7)


@query(
    "search_totals",
    f"WITH products AS ({sql.PRODUCTS}) SELECT count(*) AS total FROM products WHERE {_HIT}",
)
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return ops.search_matches(products(spark, d), "RED").agg(F.count("*").alias("total"))


# Queries taken from the data: every product name's second word, brand and type, some without hits, some too short.
QUERY_LIST = (
    "SELECT DISTINCT q AS query FROM (SELECT regexp_extract(p_name, '[a-z]+$') AS q FROM part "
    "UNION ALL SELECT p_brand FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL "
    "SELECT substr(p_type, 2, 3) FROM part UNION ALL SELECT p_name || '?' FROM part UNION ALL SELECT substr(p_type, 1, 2) FROM part)"
)
_HIT_Q, _ORDER_Q = _search_sql("lower(query)", "products")


def _many_sql(page: int) -> str:
    columns = SHOWN_SQL
    return f"""WITH products AS ({sql.PRODUCTS}), queries AS ({QUERY_LIST}),
 hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_ORDER_Q}) AS rank FROM queries JOIN products ON {_HIT_Q}
  WHERE length(query) >= 3),
 totals AS (SELECT query, count(*) AS total FROM hits GROUP BY query),
 shown AS (SELECT query, rank, {columns} FROM hits WHERE rank > {10 * (page - 1)} AND rank <= {10 * page})
 SELECT q.query, coalesce(total, 0) AS total, CAST(ceil(coalesce(total, 0) / 10.0) AS BIGINT) AS total_pages,
  shown.* EXCLUDE (query) FROM queries q LEFT JOIN totals USING (query) LEFT JOIN shown USING (query)"""


def _many(spark: SparkSession, d: str, page: int) -> DataFrame:
    part = table(spark, d, "part")
    texts = F.array(
        F.regexp_extract("p_name", "[a-z]+$", 0), F.col("p_brand"), F.lower("p_type"), F.substring("p_type", 2, 3),
        F.concat("p_name", F.lit("?")), F.substring("p_type", 1, 2),
    )
    return ops.search_many(products(spark, d), part.select(F.explode(texts).alias("query")).distinct(), page)


@query("search_many", _many_sql(1))
def search_many(spark: SparkSession, d: str) -> DataFrame:
    return _many(spark, d, 1)


@query("search_many_page", _many_sql(3))
def search_many_page(spark: SparkSession, d: str) -> DataFrame:
    return _many(spark, d, 3)


@query("point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ops.find_by_id(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", "77")


@query(
    "lookup_many",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def lookup_many(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return ops.find_by_ids(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", wanted)


# Customers of which some carry no usable id.
IDS = "SELECT CASE WHEN c_custkey % 9 = 0 THEN '  ' WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS id FROM customer"


def _named(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(key % 9 == 0, "  ").when(key % 10 != 0, F.col("c_name")).alias("id")
    )


@query("id_count", f"SELECT count(*) AS ids FROM ({IDS}) WHERE id IS NOT NULL AND trim(id) <> ''")
def id_count(spark: SparkSession, d: str) -> DataFrame:
    return ops.non_empty_ids(_named(spark, d), "id").agg(F.count("*").alias("ids"))


@query(
    "id_shards",
    f"SELECT CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) + 1 AS BIGINT) AS shard, id, "
    f"'{BASE_URL}/product/' || id AS loc FROM ({IDS}) WHERE id IS NOT NULL AND trim(id) <> ''",
)
def id_shards(spark: SparkSession, d: str) -> DataFrame:
    return ops.id_shards(_named(spark, d), BASE_URL, "id", chunk=100)


@query(
    "id_shards_orders",
    f"SELECT CAST(floor((row_number() OVER (ORDER BY o_custkey) - 1) / 10000) + 1 AS BIGINT) AS shard, "
    f"CAST(o_custkey AS VARCHAR) AS id, '{BASE_URL}/product/' || CAST(o_custkey AS VARCHAR) AS loc FROM orders",
)
def id_shards_orders(spark: SparkSession, d: str) -> DataFrame:
    return ops.id_shards(table(spark, d, "orders"), BASE_URL, "o_custkey")


@query(
    "shard_index",
    f"SELECT shard, '{BASE_URL}/sitemaps/products-' || CAST(shard AS VARCHAR) || '.xml' AS loc, '2024-01-31' AS lastmod "
    f"FROM (SELECT unnest(range(1, CAST(greatest(ceil(count(*) / 100.0), 1) AS BIGINT) + 1)) AS shard "
    f"FROM ({IDS}) WHERE id IS NOT NULL AND trim(id) <> '')",
)
def shard_index(spark: SparkSession, d: str) -> DataFrame:
    return ops.shard_index(_named(spark, d), BASE_URL, "id", chunk=100, lastmod="2024-01-31")


RATED = "rating_value > 0"
SUMMARY_SQL = (
    "CASE WHEN rating_value > 0 AND rating_count > 0 THEN printf('★ %.1f (%d)', rating_value, rating_count) "
    "WHEN rating_value > 0 THEN printf('★ %.1f', rating_value) "
    "WHEN rating_count > 0 THEN printf('%d reviews', rating_count) ELSE 'New' END"
)
STARS_SQL = (
    "CASE WHEN rating_value > 0 THEN repeat('★', CAST(floor(least(rating_value, 5.0) + 0.5) AS INT)) || "
    "repeat('☆', 5 - CAST(floor(least(rating_value, 5.0) + 0.5) AS INT)) || "
    "printf(' %.1f', least(rating_value, 5.0)) END"
)


# Ratings of every line item, many of them on a decimal tie, some missing.
RATINGS = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) / 10 + l_tax / 10 END AS rating_value, "
    "CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN 0 ELSE l_suppkey END AS rating_count FROM lineitem"
)


@query(
    "rating_text",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {SUMMARY_SQL} AS summary, {STARS_SQL} AS stars, "
    f"CASE WHEN rating_count > 0 THEN printf('%d ratings', rating_count) "
    f"WHEN rating_value > 0 THEN 'Customer reviews available' END AS note FROM ({RATINGS})",
)
def rating_text(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(line != 3, F.col("l_quantity") / 10 + F.col("l_tax") / 10).alias("rating_value"),
        F.when(line == 4, None).when(line == 5, 0).otherwise(F.col("l_suppkey")).alias("rating_count"),
    )
    value, count = F.col("rating_value"), F.col("rating_count")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        display.rating_summary(value, count).alias("summary"),
        display.rating_stars(value).alias("stars"),
        display.rating_note(value, count).alias("note"),
    )


@query(
    "price_text",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Price unavailable' ELSE printf('%.2f %s', o_totalprice, "
    "CASE WHEN o_orderpriority = '5-LOW' THEN 'EUR' ELSE 'USD' END) END AS price FROM orders",
)
def price_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        display.price_text(
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" ")).otherwise(F.lit("USD")),
        ).alias("price"),
    )


def _detailed(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("dan"),
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("desc_material"),
        F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("unit_quantity"),
    )
    return products(spark, d).join(part, "dan")


DETAILED = f"""SELECT pr.*, nullif(p_type, 'PROMO') AS desc_material,
 CASE WHEN p_size % 3 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END AS unit_quantity
 FROM ({sql.PRODUCTS}) pr JOIN part ON dan = p_partkey"""
DETAIL_FIELDS = {
    "desc_material": "Description Material",
    "has_eyecatchers": "Has Eyecatchers",
    "has_pills": "Has Pills",
    "product_is_pharmacy": "Product Is Pharmacy",
    "unit_quantity": "Unit Quantity",
}
DETAILS_SQL = " UNION ALL ".join(
    f"SELECT gtin AS id, '{label}' AS label, CAST({name} AS VARCHAR) AS value FROM ({DETAILED}) "
    f"WHERE trim(coalesce(CAST({name} AS VARCHAR), '')) <> ''"
    for name, label in DETAIL_FIELDS.items()
)


@query("detail_rows", DETAILS_SQL)
def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    return pages.detail_rows(_detailed(spark, d))


@query(
    "product_payload",
    f"""WITH s AS (SELECT id, count(*) AS n, string_agg(gtin, ',' ORDER BY rank) AS similar_ids FROM ({SIMILAR_SQL}) GROUP BY id),
 e AS (SELECT id, count(*) AS n, string_agg(label || '=' || value, ';' ORDER BY label) AS details FROM ({DETAILS_SQL}) GROUP BY id)
 SELECT gtin AS id, '/product/' || gtin AS product_path, name,
  coalesce(nullif(trim(brand), ''), 'Unknown brand') AS brand, coalesce(category_path, '') AS category,
  printf('%.2f %s', price_eur, currency) AS price_text, {SUMMARY_SQL} AS rating_summary,
  coalesce(s.n, 0) AS similar_count, coalesce(similar_ids, '') AS similar_ids,
  coalesce(e.n, 0) AS detail_count, coalesce(details, '') AS details
 FROM ({sql.PRODUCTS}) p LEFT JOIN s ON s.id = gtin LEFT JOIN e ON e.id = gtin""",
)
def product_payload(spark: SparkSession, d: str) -> DataFrame:
    pages_ = pages.product_payloads(_detailed(spark, d))
    shown = F.transform("details", lambda x: F.concat(x["label"], F.lit("="), x["value"]))
    return pages_.select(
        "id", "product_path", "name", "brand", "category", "price_text", "rating_summary",
        F.size("similar").cast("bigint").alias("similar_count"),
        F.array_join(F.transform("similar", lambda x: x["gtin"]), ",").alias("similar_ids"),
        F.size("details").cast("bigint").alias("detail_count"),
        F.array_join(shown, ";").alias("details"),
    )


# The JSON document of a product, read back: the fields that product_payload doesn't show.
@query(
    "product_payload_json",
    f"""SELECT gtin AS id, CAST(price_eur AS VARCHAR) AS price, '' AS image, '' AS description, {STARS_SQL} AS rating_stars,
 CASE WHEN rating_count > 0 THEN printf('%d ratings', rating_count) WHEN rating_value > 0 THEN 'Customer reviews available' END
  AS rating_note FROM ({sql.PRODUCTS})""",
)
def product_payload_json(spark: SparkSession, d: str) -> DataFrame:
    from catalogq.sources.sinks import json_payload

    payload = json_payload(pages.product_payloads(_detailed(spark, d)))
    fields = ("id", "price", "image", "description", "rating_stars", "rating_note")
    return payload.select(*[F.get_json_object("payload", f"$.{f}").alias(f) for f in fields])
