"""Catalogue queries against brute force on small tables with ties, gaps and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from catalogq.functions.text import WHITESPACE
from catalogq.operators import catalogue, topk
from catalogq.operators.rowindex import with_position, with_running_total
from catalogq.plans import pages
from catalogq.workloads.views import products

SCHEMA = (
    "gtin string, name string, brand string, price_eur double, currency string, category_path string, "
    "rating_value double, rating_count long, product_is_pharmacy boolean, has_eyecatchers boolean, has_pills boolean"
)


def items(n=300, seed=5):
    """A third of all rows in one category and a third in one brand."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        brand = rng.choice(["Hot", "Hot", "B1", "B2", " B1 ", "", None, f"u{i}"])
        category = rng.choice(["Big", "Big", "Cé", "D", None, "  ", f"c{i}"])
        rows.append((
            f"{i:04d}", rng.choice(["Red Bolt", "red nut", "Ärmel rot", "BOLT", "50% off", "a_b"]), brand,
            rng.choice([None, 1.0, 4.99, 20.0]), rng.choice(["EUR", None]), category,
            rng.choice([None, 1.5, 4.0, 4.5]), rng.choice([None, 0, 1, 5, 30]), rng.choice([True, False, None]),
            rng.choice([True, False, None]), rng.choice([True, False, None]),
        ))
    return rows


@pytest.fixture(scope="module")
def rows():
    return items()


@pytest.fixture(scope="module")
def shop(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7).cache()


def down(value):
    return (value is None, -(value or 0))


@pytest.fixture(params=["10m", "-1"])
def join_by_size(spark, request):
    """Once with joins that may broadcast, once with shuffled ones only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_similar_items_equal_brute_force(shop, rows, join_by_size):
    expected = {}
    for r in rows:
        brand, category = (r[2] or "").strip(WHITESPACE), (r[5] or "").strip(WHITESPACE)
        pool = [o for o in rows if o[0] != r[0] and ((category and o[5] == category) or (brand and o[2] == brand))]
        pool.sort(key=lambda o: (0 if category and o[5] == category else 1, down(o[6]), down(o[7]), o[0]))
        for rank, o in enumerate(pool[:8], 1):
            expected[r[0], rank] = o[0]
    got = {(r["id"], r["rank"]): r["gtin"] for r in catalogue.similar_items(shop).collect()}
    assert got == expected


def test_sections_equal_brute_force(shop, rows):
    def section(keep, lead):
        chosen = [r for r in rows if r[3] is not None and keep(r)]
        first, second = (6, 7) if lead == "value" else (7, 6)
        return [r[0] for r in sorted(chosen, key=lambda r: (down(r[first]), down(r[second]), r[3], r[0]))[:12]]

    expected = {
        "top-rated": section(lambda r: (r[7] or 0) >= 20, "value"),
        "most-reviewed": section(lambda r: (r[7] or 0) >= 1, "count"),
        "budget-finds": section(lambda r: r[3] <= 5 and (r[7] or 0) >= 5, "value"),
        "pharmacy-picks": section(lambda r: r[8], "value"),
        "featured-badges": section(lambda r: r[9] or r[10], "count"),
    }
    got = {}
    for r in catalogue.section_feeds(shop).orderBy("section_position", "rank").collect():
        got.setdefault(r["section_id"], []).append(r["gtin"])
    assert got == expected


def test_empty_section_is_left_out(shop):
    cheap = shop.where("price_eur > 5 or price_eur is null")
    payload = catalogue.home_payload(catalogue.section_feeds(cheap)).collect()
    assert "budget-finds" not in {r["section_id"] for r in payload}
    assert all(r["item_count"] == len(r["items"]) for r in payload)


def ranked(rows, query):
    lower = lambda v: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v or "")
    needle, hits = lower(query.strip()), []
    for r in rows:
        fields = [lower(r[1]), lower(r[2]), lower(r[5])]
        if any(needle in f for f in fields):
            key = [0 if f.startswith(needle) else 1 for f in fields]
            hits.append((*key, down(r[7]), down(r[6]), r[1] or "", r[0]))
    return [h[-1] for h in sorted(hits)]


@pytest.mark.parametrize("query", ["red", "BOLT", "0% o", "a_b", "ärm", " ärmel r ", "hot", "nothing"])
def test_search_equals_brute_force(shop, rows, query):
    expected = ranked(rows, query)
    page = catalogue.search(shop, query, page=2)
    assert page.total == len(expected)
    assert page.total_pages == -(-len(expected) // 10)
    assert [r["id"] for r in page.items.collect()] == expected[10:20]
    assert page.has_prev and page.prev_page == 1 and page.has_next == (len(expected) > 20)


def test_search_refuses_short_queries_and_bad_pages(shop):
    for query, page in (("ab", 1), ("  a ", 1), ("abc", 0)):
        with pytest.raises(ValueError):
            catalogue.search(shop, query, page)
    with pytest.raises(ValueError):
        catalogue.search_matches(shop.select("gtin"), "abc")


def test_many_searches_equal_single_ones(spark, shop, rows, join_by_size):
    queries = ["red", "BOLT", "a_b", "nothing", "xy", "big", "hot"]
    df = spark.createDataFrame([(q,) for q in queries + ["red"]], "query string")
    got = {}
    for r in catalogue.search_many(shop, df, page=2, page_size=7).orderBy("query", "rank").collect():
        got.setdefault((r["query"], r["total"], r["total_pages"]), []).append(r["id"])
    expected = {}
    for q in queries:
        ids = ranked(rows, q) if len(q) >= 3 else []
        expected[q, len(ids), -(-len(ids) // 7)] = ids[7:14] or [None]
    assert got == expected


def test_top_rows_beyond_the_engine_limit(spark):
    """Past the limit up to which Spark cuts groups early, salted groups are cut instead."""
    df = spark.range(6_000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").alias("v"))
    got = topk.top_per_group(df, ["g"], [F.col("v").desc()], 1_500, "rank")
    assert got.groupBy("g").count().collect() and got.count() == 3_000
    assert got.where("g and rank = 1500").first()["v"] == 5997 - 3 * 1499


def test_positions_with_a_hot_value(spark):
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("v"))
    rows = with_position(df, ["v"], "p").orderBy("p").collect()
    assert [r["p"] for r in rows] == list(range(9_000))
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)


def test_running_totals(spark):
    df = spark.range(1_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.lit(2).alias("w"))
    rows = with_running_total(df, "g", "o", "w", "t").collect()
    assert all(r["t"] == 2 * (r["o"] // 2 + 1) for r in rows)


def test_shards(spark):
    df = spark.createDataFrame([("b",), (" a ",), ("c",), ("",), ("  ",), (None,), ("d",), ("e",)], "gtin string")
    shards = catalogue.id_shards(df, "http://x", chunk=2)
    got = sorted((r["shard"], r["id"]) for r in shards.collect())
    assert got == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e")]
    assert shards.where("id = 'a'").first()["loc"] == "http://x/product/a"
    index = catalogue.shard_index(df, "http://x", chunk=2, lastmod="2024-01-01").orderBy("shard").collect()
    assert [r["loc"] for r in index] == [f"http://x/sitemaps/products-{i}.xml" for i in (1, 2, 3)]
    assert catalogue.shard_index(df.where("false"), "http://x").count() == 1
    assert catalogue.shard_size(0) == 10_000 and catalogue.shard_size(99_999) == 50_000


def test_lookup_casts_the_id(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert catalogue.find_by_id(customer, "c_custkey", "7").first()["c_custkey"] == 7
    assert catalogue.find_by_id(customer, "c_custkey", "x").count() == 0


def test_pages_show_fallbacks(spark, shop):
    page = {r["id"]: r for r in pages.product_payloads(shop).collect()}
    for r in shop.collect():
        shown = page[r["gtin"]]
        assert shown["brand"] == (r["brand"] if (r["brand"] or "").strip() else "Unknown brand")
        if r["price_eur"] is None:
            assert shown["price_text"] == "Price unavailable"
        else:
            assert shown["price_text"] == f"{r['price_eur']:.2f} EUR"
        value, count = r["rating_value"] or 0, r["rating_count"] or 0
        expected = f"★ {value:.1f}" + (f" ({count})" if count else "") if value else f"{count} reviews" if count else "New"
        assert shown["rating_summary"] == expected
        stars = None if not value else "★" * int(value + 0.5) + "☆" * (5 - int(value + 0.5)) + f" {value:.1f}"
        assert shown["rating_stars"] == stars
        assert len(shown["similar"]) <= 8
    assert len(page) == 300


def test_product_view_is_whole(spark, sf_dir):
    assert products(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_search_for_many_queries_bounds_the_rows_of_a_task(spark, monkeypatch):
    """Tasks follow the rows of the catalogue; rows with the same id, or without one, meet as before."""
    from catalogq.operators import catalogue as ops

    monkeypatch.setattr(ops, "SEARCH_ROWS", 10)
    items = spark.createDataFrame([(None if i % 50 == 0 else f"g{i // 2}", f"item {i}", 1) for i in range(200)], "gtin string, name string, rating_count long")
    asked = spark.createDataFrame([("item",), ("item 19",), ("nothing",)], "query string")
    found = ops.query_hits(items, asked)
    rows = found.select("query", "gtin", "name").collect()
    assert sorted((r["query"], r["gtin"] or "", r["name"]) for r in rows) == sorted(
        (q, "" if i % 50 == 0 else f"g{i // 2}", f"item {i}") for q in ("item", "item 19") for i in range(200) if q in f"item {i}"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ops.query_hits(items, asked).rdd.getNumPartitions() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
