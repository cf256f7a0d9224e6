"""Queries of the reference build: parse, flatten, reconcile, dedupe, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.functions import ingest, variants
from catalogq.plans import quality, reference
from catalogq.session import materialize, new_folder
from catalogq.sources import sinks, tables
from catalogq.workloads import sql
from catalogq.workloads.registry import ORACLES, query, table
from catalogq.workloads.views import products

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_SQL = ", ".join(LINE)
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
# A price of every line item in the spellings of shops; the last ones are not prices.
PRICE_TEXT = f"""CASE CAST(l_partkey % 8 AS INT)
 WHEN 0 THEN concat(CAST({CENTS} // 100 AS STRING), ',', lpad(CAST({CENTS} % 100 AS STRING), 2, '0'), ' €')
 WHEN 1 THEN concat('EUR ', CAST({CENTS} // 100 AS STRING), '.', lpad(CAST({CENTS} % 100 AS STRING), 2, '0'))
 WHEN 2 THEN concat('1.', lpad(CAST({CENTS} // 100 % 1000 AS STRING), 3, '0'), ',50 EUR')
 WHEN 3 THEN concat('ab ', CAST(CAST(l_quantity AS INT) AS STRING), ' Stück')
 WHEN 4 THEN concat('ca. ', CAST(CAST(l_quantity AS INT) AS STRING), ',5')
 WHEN 5 THEN concat('1.2.', CAST(CAST(l_quantity AS INT) AS STRING))
 WHEN 6 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING), '.25')
 ELSE 'auf Anfrage' END"""


def _spark_text(text: str) -> Column:
    return F.expr(text.replace("//", "div"))


@query(
    "parse_eur",
    f"""SELECT {LINE_SQL}, CASE CAST(l_partkey % 8 AS INT)
 WHEN 0 THEN {CENTS} / 100.0 WHEN 1 THEN {CENTS} / 100.0
 WHEN 2 THEN 1000 + {CENTS} // 100 % 1000 + 0.5 WHEN 3 THEN l_quantity
 WHEN 6 THEN -l_quantity - 0.25 END AS price FROM lineitem""",
)
def parse_eur(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "lineitem").select(*LINE, _spark_text(PRICE_TEXT).alias("text"))
    return text.select(*LINE, ingest.euro_amount(F.col("text")).alias("price"))


@query(
    "parse_unit_info",
    f"""SELECT {LINE_SQL}, l_partkey % 3 <> 2 AS found,
 CASE WHEN l_partkey % 3 <> 2 THEN l_quantity + 0.5 END AS unit_quantity,
 CASE WHEN l_partkey % 3 = 0 THEN 'l' WHEN l_partkey % 3 = 1 THEN 'kg' END AS unit_quantity_unit,
 CASE WHEN l_partkey % 3 <> 2 THEN CAST(100 AS DOUBLE) END AS unit_price_per_quantity,
 CASE WHEN l_partkey % 3 = 0 THEN 'ml' WHEN l_partkey % 3 = 1 THEN 'g' END AS unit_price_per_unit,
 CASE WHEN l_partkey % 3 <> 2 THEN CAST(l_suppkey + 0.25 AS DOUBLE) END AS unit_price_eur,
 CASE WHEN l_partkey % 3 = 2 THEN 'neu' ELSE concat('neu | ', CAST(CAST(l_quantity AS INT) AS VARCHAR), ',5 ',
  CASE WHEN l_partkey % 3 = 0 THEN 'l' ELSE 'kg' END, ' (', CAST(l_suppkey AS VARCHAR), ',25 € je 100 ',
  CASE WHEN l_partkey % 3 = 0 THEN 'ml' ELSE 'g' END, ')') END AS unit_info_raw FROM lineitem""",
)
def parse_unit_info(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_partkey") % 3
    note = F.concat(
        F.col("l_quantity").cast("int").cast("string"), F.lit(",5 "), F.when(kind == 0, "l").otherwise("kg"), F.lit(" ("),
        F.col("l_suppkey").cast("string"), F.lit(",25 € je 100 "), F.when(kind == 0, "ml").otherwise("g"), F.lit(")"),
    )
    texts = F.array_compact(F.array(F.lit("neu"), F.when(kind != 2, note)))
    rows = table(spark, d, "lineitem").select(*LINE, texts.alias("texts"))
    found = rows.select(*LINE, *[c.alias(n) for n, c in ingest.unit_info(F.col("texts")).items()])
    return found.withColumn("found", F.col("unit_quantity").isNotNull())


@query(
    "parse_dates_de",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def parse_dates_de(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("seit 31.02.2024")).otherwise(
        F.concat(F.lit("Preis seit "), day, F.lit(" stabil, zuvor 01.01.1990"))
    )
    return table(spark, d, "orders").select("o_orderkey", ingest.german_date(text).alias("day"))


@query(
    "parse_ints",
    """SELECT o_orderkey, o_custkey AS points, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey
 WHEN o_orderkey % 3 = 1 THEN -o_custkey END AS number, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE)
 WHEN o_orderkey % 3 = 1 THEN -o_custkey - 0.75 END AS float_number FROM orders""",
)
def parse_ints(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 3
    number = F.when(kind == 0, key).when(kind == 1, F.concat(F.lit("-"), key, F.lit(".75"))).otherwise(
        F.concat(key, F.lit(".5f"))
    )
    note = F.concat(F.lit("bis zu "), key, F.lit(" Punkte, davon 3 extra"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        ingest.first_integer(note).alias("points"),
        ingest.to_long(number).alias("number"),
        ingest.to_double(number).alias("float_number"),
    )


@query(
    "gtin_digits",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE replace(c_name, 'Customer#', '') || '40' END AS gtin FROM customer",
)
def gtin_digits(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, "ohne").otherwise(F.concat(F.col("c_name"), F.lit("-4 0")))
    return table(spark, d, "customer").select("c_custkey", ingest.digits(raw).alias("gtin"))


@query(
    "join_texts",
    """SELECT o_orderkey, concat_ws(' | ', o_orderstatus, CASE WHEN o_orderpriority <> o_orderstatus THEN o_orderpriority END)
 AS joined FROM orders""",
)
def join_texts(spark: SparkSession, d: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    padded = F.concat(F.lit(" "), status, F.lit(" "))
    texts = F.array(status, F.lit("  "), F.lit(None).cast("string"), padded, priority, status)
    return table(spark, d, "orders").select("o_orderkey", ingest.join_texts(texts, " | ").alias("joined"))


def _lit(text: str) -> Column:
    return F.lit(text)


# --- description groups and content blocks -----------------------------------------------------


def _group_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per order: a document with description groups of every block kind.

    A line is far larger than the order it comes from, so the lines are spread out.
    """
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    block = F.struct(
        F.array(status, F.lit(" "), status, F.lit("text")).alias("texts"),
        F.array(priority).alias("bulletpoints"),
        F.array(F.struct(F.lit("more").alias("linkText"), F.concat(F.lit("/o/"), key.cast("string")).alias("href")))
        .alias("links"),
        F.array(
            F.struct(status.alias("title"), priority.alias("description")),
            F.struct(F.lit(None).cast("string").alias("title"), F.lit("alone").alias("description")),
        ).alias("descriptionList"),
        F.array(F.array(status, F.lit(None), F.lit("b")), F.array().cast("array<string>"), F.array(priority, F.lit("z"), F.lit("")))
        .alias("table"),
    )
    plain = F.struct(
        F.array(F.concat(F.lit("nr "), key.cast("string"))).alias("texts"),
        F.lit(None).cast("array<string>").alias("bulletpoints"),
        F.lit(None).cast("array<struct<linkText:string,href:string>>").alias("links"),
        F.lit(None).cast("array<struct<title:string,description:string>>").alias("descriptionList"),
        F.lit(None).cast("array<array<string>>").alias("table"),
    )
    group = lambda header, content: F.struct(header.alias("header"), F.array(content).alias("contentBlock"))
    groups = F.array(
        group(_lit("Material"), block),
        group(_lit("Zutaten"), plain),
        group(_lit("Sonstiges"), plain),
        group(F.when(key % 2 == 0, _lit("Zutaten")).otherwise(_lit(" ")), block),
    )
    text = F.to_json(F.struct(F.struct(groups.alias("descriptionGroups")).alias("product")))
    orders = _spread(spark, table(spark, d, "orders"))
    return orders.select(text.alias("value"), F.col("o_orderkey").alias("_ord"))


def _spread(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as the session's shuffles have: the documents made from them are far larger."""
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


BLOCK_SQL = (
    "concat_ws(chr(10), o_orderstatus, 'text', o_orderpriority, 'more', '/o/' || o_orderkey, "
    "o_orderstatus || ': ' || o_orderpriority, 'alone', "
    "o_orderstatus || ' /  / b || ' || o_orderpriority || ' / z / ')"
)


@query(
    "content_blocks",
    f"SELECT o_orderkey, trim({BLOCK_SQL}) AS body FROM orders",
)
def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.parse_lines(_group_lines(spark, d))
    first = F.get(variants.items(F.col("doc"), "$.product.descriptionGroups", variants.GROUP), F.lit(0))
    return docs.select(F.col("_ord").alias("o_orderkey"), variants.group_text(first).alias("body"))


@query(
    "desc_groups",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Material,Zutaten,Sonstiges,Zutaten' ELSE 'Material,Zutaten,Sonstiges' END AS headers,
 trim({BLOCK_SQL}) AS desc_material, CASE WHEN o_orderkey % 2 = 0 THEN trim({BLOCK_SQL}) ELSE 'nr ' || o_orderkey END AS desc_zutaten
 FROM orders""",
)
def desc_groups(spark: SparkSession, d: str) -> DataFrame:
    flat = reference.flatten_products(tables.parse_lines(_group_lines(spark, d)))
    return flat.select(
        F.col("_ord").alias("o_orderkey"), F.array_join("_headers", ",").alias("headers"), "desc_material", "desc_zutaten"
    )


# --- JSON Lines --------------------------------------------------------------------------------

# Events as lines: their JSON, and in place of some of them blanks, fragments and non-objects.
EVENT_LINE = """CASE CAST(event_id % 9 AS INT) WHEN 0 THEN substr(props, 1, 4) WHEN 1 THEN '   ' WHEN 2 THEN 'null'
 WHEN 3 THEN concat('[', CAST(user_id AS STRING), ']') ELSE props END"""


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.expr(EVENT_LINE).alias("value"), F.col("event_id").alias("_ord"))


@query(
    "jsonl_bad_rows",
    f"""SELECT count(*) AS source_rows, count(*) FILTER (NOT (json_valid(line) AND (line = 'null' OR line LIKE '{{%'))) AS invalid_rows
 FROM (SELECT {EVENT_LINE} AS line FROM events) WHERE trim(line) <> ''""",
)
def jsonl_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.line_counts(tables.parse_lines(_event_lines(spark, d)))


@query(
    "jsonl_flatten",
    f"""SELECT event_id, CAST(line ->> '$.k' AS BIGINT) AS k, line ->> '$.k' AS k_text FROM
 (SELECT event_id, {EVENT_LINE} AS line FROM events) WHERE json_valid(line) AND (line = 'null' OR line LIKE '{{%')""",
)
def jsonl_flatten(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.parse_lines(_event_lines(spark, d)).where("valid")
    doc = F.col("doc")
    return docs.select(
        F.col("_ord").alias("event_id"), variants.whole(doc, "$.k").alias("k"), variants.text(doc, "$.k").alias("k_text")
    )


@query(
    "jsonl_limit",
    f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM
 (SELECT event_id, {EVENT_LINE} AS line FROM events) WHERE json_valid(line) AND (line = 'null' OR line LIKE '{{%')) WHERE n <= 50""",
)
def jsonl_limit(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.limit_valid(tables.parse_lines(_event_lines(spark, d)), 50)
    return docs.where("valid").select(F.col("_ord").alias("event_id"))


@query(
    "jsonl_file",
    """SELECT 'l' || event_id AS slug, value AS rating_value FROM events""",
)
def jsonl_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "jsonl")
    rating = F.struct(F.struct(F.col("value").alias("ratingValue")).alias("rating"))
    docs = F.struct(F.concat(F.lit("l"), F.col("event_id")).alias("slug"), rating.alias("product"))
    table(spark, d, "events").select(F.to_json(docs).alias("value")).write.text(path)
    return reference.flatten_products(tables.parse_lines(tables.read_lines(spark, path))).select("slug", "rating_value")


@query(
    "json_flags",
    """SELECT p_partkey, p_size % 2 = 0 AS has_variants, p_size % 3 = 0 AS has_videos, p_size % 5 <> 0 AS has_pills,
 CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type || ' | ' || p_brand END AS pills,
 CASE WHEN p_size % 4 = 0 THEN true WHEN p_size % 4 = 1 THEN false END AS product_is_pharmacy FROM part""",
)
def json_flags(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    value = F.concat(
        F.lit('{"product":{"variants":'), F.when(size % 2 == 0, '{"a":1}').otherwise("[1]"),
        F.lit(',"videos":'), F.when(size % 3 == 0, "[0]").otherwise("[]"),
        F.lit(',"pills":'), F.when(size % 5 == 0, '[" ",{"x":"y"}]').otherwise(
            F.concat(F.lit('[{"text":"'), F.col("p_type"), F.lit('","label":" "},"'), F.col("p_brand"), F.lit('"]'))
        ),
        F.lit(',"isPharmacy":'), F.when(size % 4 == 0, "true").when(size % 4 == 1, "false").otherwise('"true"'),
        F.lit("}}"),
    )
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("_ord"), value.alias("value"))
    flat = reference.flatten_products(tables.parse_lines(lines))
    return flat.select(
        F.col("_ord").alias("p_partkey"), "has_variants", "has_videos", "has_pills", "pills", "product_is_pharmacy"
    )


# --- reconcile ---------------------------------------------------------------------------------

# The columns reconcile() reads, taken from parts and their line items, with gaps.
FACTS = """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand, p_name AS brand_product_name,
 CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS STRING) END AS gtin,
 CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey + p_size % 2 AS STRING) END AS product_gtin,
 CASE WHEN p_size % 4 = 0 THEN p_partkey END AS dan, CASE WHEN p_size % 7 <> 0 THEN p_partkey + p_size % 2 END AS product_dan,
 p_size % 2 = 0 AS available_raw, CASE WHEN p_size % 3 = 1 THEN p_retailprice END AS price_eur_top,
 CASE WHEN p_size % 4 <> 1 THEN p_retailprice + p_size / 8 END AS gross_price_current_eur,
 CASE WHEN p_size % 5 <> 2 THEN p_retailprice - 0.5 END AS metadata_price_eur, p_retailprice + 1 AS seo_price_eur,
 CASE WHEN p_size % 6 = 0 THEN ' ' WHEN p_size % 6 < 4 THEN p_type END AS seo_category,
 concat(p_type, ' > ', p_brand) AS breadcrumbs_path,
 CASE WHEN p_size % 8 = 0 THEN 'USD' END AS metadata_currency, CASE WHEN p_size % 9 = 0 THEN 'CHF' END AS seo_price_currency
 FROM part"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    body = FACTS[len("SELECT "):FACTS.rindex("FROM part")].replace("p_size / 8", "CAST(p_size AS DOUBLE) / 8")
    return table(spark, d, "part").selectExpr(*_split_select(body))


def _split_select(body: str) -> list[str]:
    """The items of a select list, split at commas outside parentheses."""
    items, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(body[start:i])
            start = i + 1
    return [x.strip() for x in [*items, body[start:]]]


@query(
    "reconcile_fill",
    f"""SELECT p_partkey, coalesce(brand, brand_product_name) AS brand, coalesce(gtin, product_gtin) AS gtin,
 coalesce(dan, product_dan) AS dan, available_raw AS available_norm,
 coalesce(price_eur_top, gross_price_current_eur, metadata_price_eur, seo_price_eur) AS price_eur,
 coalesce(nullif(trim(seo_category), ''), breadcrumbs_path) AS category_path,
 coalesce(metadata_currency, seo_price_currency, 'EUR') AS currency FROM ({FACTS})""",
)
def reconcile_fill(spark: SparkSession, d: str) -> DataFrame:
    return reference.reconcile(_facts(spark, d)).select(
        "p_partkey", "brand", "gtin", "dan", "available_norm", "price_eur", "category_path", "currency"
    )


@query(
    "price_diffs",
    f"""SELECT p_partkey, round(price_eur_top - gross_price_current_eur, 4) AS price_diff_top_vs_gross,
 round(price_eur_top - metadata_price_eur, 4) AS price_diff_top_vs_meta,
 round(gross_price_current_eur - metadata_price_eur, 4) AS price_diff_gross_vs_meta FROM ({FACTS})""",
)
def price_diffs(spark: SparkSession, d: str) -> DataFrame:
    return reference.reconcile(_facts(spark, d)).select(
        "p_partkey", "price_diff_top_vs_gross", "price_diff_top_vs_meta", "price_diff_gross_vs_meta"
    )


@query(
    "nullable_equal",
    f"""SELECT p_partkey, coalesce(gtin, product_gtin) = product_gtin AS gtin_matches_nested,
 coalesce(dan, product_dan) = product_dan AS dan_matches_nested FROM ({FACTS})""",
)
def nullable_equal(spark: SparkSession, d: str) -> DataFrame:
    return reference.reconcile(_facts(spark, d)).select("p_partkey", "gtin_matches_nested", "dan_matches_nested")


# Events as scrapes of the product user_id; a third lack the product, some the time or the number.
SCRAPES = """SELECT CASE WHEN user_id % 3 <> 0 THEN CAST(user_id AS STRING) END AS gtin,
 CASE WHEN event_id % 11 <> 0 THEN ts END AS scraped, CASE WHEN event_id % 13 <> 0 THEN event_id % 50 END AS dan, event_id FROM events"""


def _scrapes(spark: SparkSession, d: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, d, "events").select(
        F.when(user % 3 != 0, user.cast("string")).alias("gtin"),
        F.when(event % 11 != 0, F.col("ts")).alias(reference.SCRAPED_AT),
        F.when(event % 13 != 0, event % 50).alias("dan"),
        event.alias("_ord"),
    )


DEDUPE_SQL = f"""SELECT gtin, event_id, dan FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(gtin, '')
 ORDER BY scraped DESC NULLS FIRST, dan DESC NULLS FIRST, event_id DESC) AS n FROM ({SCRAPES})) WHERE n = 1"""


@query("dedupe_keep_last", DEDUPE_SQL)
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    kept = reference.dedupe_latest(_scrapes(spark, d))
    return kept.select("gtin", F.col("_ord").alias("event_id"), "dan")


@query("dedupe_written", DEDUPE_SQL)
def dedupe_written(spark: SparkSession, d: str) -> DataFrame:
    kept = reference.dedupe_written(_scrapes(spark, d))
    return kept.select("gtin", F.col("_ord").alias("event_id"), "dan")


@query(
    "dedupe_count",
    f"SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM ({DEDUPE_SQL})) AS removed FROM events LIMIT 1",
)
def dedupe_count(spark: SparkSession, d: str) -> DataFrame:
    rows = _scrapes(spark, d)
    before = rows.agg(F.count("*").alias("n"))
    after = reference.dedupe_latest(rows).agg(F.count("*").alias("n"))
    return before.select("n").unionByName(after.select((-F.col("n")).alias("n"))).agg(F.sum("n").alias("removed"))


# --- profile -----------------------------------------------------------------------------------

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "profile_uniqueness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS unique_values, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows "
        f"FROM (SELECT {c}, count(*) AS n FROM orders GROUP BY 1)"
        for c in ORDER_COLUMNS
    ),
)
def profile_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return quality.uniqueness(table(spark, d, "orders"), ORDER_COLUMNS)


FACT_COLUMNS = (
    "brand", "gtin", "product_gtin", "dan", "product_dan", "available_raw", "price_eur_top", "gross_price_current_eur",
    "metadata_price_eur", "seo_price_eur", "seo_category", "breadcrumbs_path", "metadata_currency", "seo_price_currency",
)


@query(
    "profile_missing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' "
        f"THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct FROM ({FACTS})"
        for c in FACT_COLUMNS
    ),
)
def profile_missing(spark: SparkSession, d: str) -> DataFrame:
    shares = quality.most_missing(_facts(spark, d), FACT_COLUMNS)
    return shares.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "profile_ts_range",
    f"SELECT strftime(min(scraped), '%Y-%m-%d %H:%M:%S.%f') AS min_time, strftime(max(scraped), '%Y-%m-%d %H:%M:%S.%f') AS max_time "
    f"FROM ({SCRAPES})",
)
def profile_ts_range(spark: SparkSession, d: str) -> DataFrame:
    found = quality.time_range(_scrapes(spark, d), reference.SCRAPED_AT)
    return found.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("min_time", "max_time")])


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, CAST(min({c}) AS DOUBLE) AS min, CAST(median({c}) AS DOUBLE) AS median, "
        f"round(avg({c}), 7) AS mean, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
        for c in LINE_NUMBERS
    ),
)
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    summary = quality.numeric_summary(table(spark, d, "lineitem"), LINE_NUMBERS)
    return summary.withColumn("mean", F.round("mean", 7))


COUNTED = ("brand", "seo_category", "metadata_currency", "available_raw", "seo_price_currency")


@query(
    "profile_value_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", value, count, rank FROM (SELECT value, count(*) AS count, "
        f"row_number() OVER (ORDER BY count(*) DESC, value) AS rank FROM (SELECT CASE WHEN {c} IS NULL OR "
        f"trim(CAST({c} AS VARCHAR)) = '' THEN '<NA>' WHEN CAST({c} AS VARCHAR) = 'true' THEN 'True' "
        f"WHEN CAST({c} AS VARCHAR) = 'false' THEN 'False' ELSE CAST({c} AS VARCHAR) END AS value FROM ({FACTS})) GROUP BY 1) WHERE rank <= 20"
        for c in COUNTED
    ),
)
def profile_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.value_counts(_facts(spark, d), COUNTED)


@query(
    "profile_headers",
    "SELECT header, count(*) AS count FROM (SELECT unnest([o_orderstatus, o_orderpriority, o_orderstatus]) AS header FROM orders) GROUP BY 1",
)
def profile_headers(spark: SparkSession, d: str) -> DataFrame:
    headers = F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")
    return quality.header_counts(table(spark, d, "orders").select(headers.alias("_headers")))


@query(
    "profile_price",
    f"SELECT unnest(['top_vs_gross_abs_diff', 'top_vs_meta_abs_diff', 'gross_vs_meta_abs_diff']) AS pair, "
    f"unnest([count(*) FILTER (abs(price_eur_top - gross_price_current_eur) > 0.01), "
    f"count(*) FILTER (abs(price_eur_top - metadata_price_eur) > 0.01), "
    f"count(*) FILTER (abs(gross_price_current_eur - metadata_price_eur) > 0.01)]) AS rows FROM ({FACTS})",
)
def profile_price(spark: SparkSession, d: str) -> DataFrame:
    return quality.price_disagreements(_facts(spark, d))


# --- the whole build ---------------------------------------------------------------------------


def product_lines(spark: SparkSession, d: str) -> DataFrame:
    """Scraped JSON lines of every product: two scrapes, a third without a time for some, and broken lines.

    The lines are far larger than the rows they come from, so they are spread out.
    """
    dan, price = F.col("dan"), F.col("price_eur")
    cents = F.floor(price * 100)
    german = F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    null_text = F.lit(None).cast("string")

    def document(stamp: Column, name: Column) -> Column:
        current = F.struct(F.struct(german.alias("value")).alias("current"))
        product = F.struct(
            F.concat(F.lit("GTIN "), "gtin").alias("gtin"),
            F.col("product_is_pharmacy").alias("isPharmacy"),
            F.struct(F.col("brand").alias("name")).alias("brand"),
            F.struct(F.concat(F.lit("sub "), "name").alias("subheadline")).alias("title"),
            F.array("category_path", F.lit(" "), "name").alias("breadcrumbs"),
            F.struct(F.col("rating_count").alias("ratingCount"), F.col("rating_value").alias("ratingValue")).alias("rating"),
            F.struct(
                F.array(F.lit("Angebot"), F.concat(dan.cast("string"), F.lit(",5 l (3,90 € je 1 l)"))).alias("infos"),
                current.alias("price"),
            ).alias("price"),
            F.when(F.col("has_pills"), F.array(F.lit("pill"), F.lit("pill"))).alias("pills"),
            F.when(F.col("has_eyecatchers"), F.array(F.struct(F.lit("eye").alias("text"), F.lit("alt").alias("alt")))).alias("eyecatchers"),
            F.array(
                F.struct(
                    F.lit("Material").alias("header"),
                    F.array(F.struct(F.array("name", "brand").alias("texts"))).alias("contentBlock"),
                )
            ).alias("descriptionGroups"),
        )
        doc = F.struct(
            F.when(dan % 6 != 0, F.col("gtin")).alias("gtin"),
            dan.alias("dan"),
            name.alias("name"),
            F.when(dan % 4 == 0, null_text).otherwise(F.col("brand")).alias("brand"),
            F.when(dan % 3 == 0, F.floor(price)).alias("price"),
            stamp.alias("scraped_at_utc"),
            product.alias("product"),
        )
        return F.to_json(doc)

    older = document(F.lit("2024-01-01T10:00:00Z"), F.concat(F.lit("old "), "name"))
    newer = document(F.lit("2024-01-02T09:00:00.5+02:00"), F.col("name"))
    timeless = F.when(dan % 5 == 0, document(null_text, F.concat(F.lit("timeless "), "name")))
    broken = F.when(dan % 9 == 0, F.substring(newer, 1, 40))
    lines = F.array_compact(F.array(newer, older, timeless, broken, F.when(dan % 10 == 0, " "), F.when(dan % 12 == 0, "[1]")))
    spread = _spread(spark, products(spark, d))
    return spread.select("dan", F.posexplode(lines).alias("n", "value")).select(
        "value", F.struct("dan", "n").alias("_ord")
    )


CLEAN_SQL = f"""SELECT gtin, dan, CASE WHEN dan % 5 = 0 THEN 'timeless ' || name ELSE name END AS name,
 CASE WHEN trim(brand) = '' THEN NULL ELSE brand END AS brand, 'sub ' || name AS title_subheadline,
 CASE WHEN dan % 3 = 0 THEN floor(price_eur) ELSE floor(price_eur * 100) / 100 END AS price_eur, 'EUR' AS currency,
 CAST(dan + 0.5 AS DOUBLE) AS unit_quantity, 'l' AS unit_quantity_unit, CAST(3.9 AS DOUBLE) AS unit_price_eur,
 CAST(1 AS DOUBLE) AS unit_price_per_quantity, 'l' AS unit_price_per_unit,
 concat_ws(' > ', category_path, name) AS category_path, category_path AS breadcrumb_1, CAST(NULL AS VARCHAR) AS breadcrumb_2,
 name AS breadcrumb_3, concat_ws(' > ', category_path, name) AS breadcrumbs_path, product_is_pharmacy, rating_count, rating_value,
 false AS has_variants, false AS has_videos, false AS has_seals, has_pills, has_eyecatchers,
 CASE WHEN has_eyecatchers THEN 'eye | alt' END AS eyecatchers, CASE WHEN has_pills THEN 'pill' END AS pills,
 {', '.join(f"CAST(NULL AS VARCHAR) AS {c}" for c in reference.DESCRIPTION_COLUMNS.values() if c != 'desc_material')},
 concat_ws(chr(10), name, nullif(trim(brand), '')) AS desc_material FROM ({sql.PRODUCTS})"""


@query("build_reference", CLEAN_SQL)
def build_reference(spark: SparkSession, d: str) -> DataFrame:
    return reference.build_from_lines(product_lines(spark, d)).clean


@query("export_projection", CLEAN_SQL)
def export_projection(spark: SparkSession, d: str) -> DataFrame:
    flat = reference.reconcile(reference.flatten_products(tables.parse_lines(product_lines(spark, d))))
    return reference.export_rows(reference.dedupe_written(materialize(reference.for_export(flat), "products")))


@query(
    "build_counts",
    f"""SELECT 2 * count(*) + count(*) FILTER (dan % 5 = 0) + count(*) FILTER (dan % 9 = 0) + count(*) FILTER (dan % 12 = 0) AS source_rows,
 count(*) FILTER (dan % 9 = 0) + count(*) FILTER (dan % 12 = 0) AS invalid_rows, count(*) AS clean_rows, CAST(89 AS BIGINT) AS columns
 FROM ({sql.PRODUCTS})""",
)
def build_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.parse_lines(product_lines(spark, d))
    counts = tables.line_counts(docs).first()
    kept = reference.dedupe_latest(reference.reconcile(reference.flatten_products(docs)))
    width = len(reference.described_columns(kept))
    return quality.dataset_shape(kept, counts["source_rows"], counts["invalid_rows"], width)


# The built rows with the columns that the profile looks at; all other columns are empty in every document.
_FILLED_ALWAYS = (
    "breadcrumbs_count breadcrumbs_path category_path currency description_headers description_headers_count "
    "description_headers_json desc_material eyecatchers_count gross_price_infos gtin_matches_nested name product_gtin "
    "product_is_pharmacy title_subheadline unit_info_raw unit_price_eur unit_price_per_quantity unit_price_per_unit "
    "unit_quantity unit_quantity_unit price_eur"
).split()
_PROFILED = {
    "gtin": "gtin", "dan": "dan", "brand": "nullif(trim(brand), '')", "brand_product_name": "nullif(trim(brand), '')",
    "breadcrumb_1": "category_path", "breadcrumb_3": "name", "eyecatchers": "CASE WHEN has_eyecatchers THEN 'x' END",
    "pills": "CASE WHEN has_pills THEN 'x' END", "has_eyecatchers": "has_eyecatchers", "has_pills": "has_pills",
    "has_seals": "false", "has_variants": "false", "has_videos": "false", "rating_count": "rating_count", "rating_value": "rating_value",
    "price_eur_top": "CASE WHEN dan % 3 = 0 THEN floor(price_eur) END", "price_raw": "CASE WHEN dan % 3 = 0 THEN 'x' END",
    "price_diff_top_vs_gross": "CASE WHEN dan % 3 = 0 THEN 0 END", "gross_price_current_eur": "floor(price_eur * 100) / 100",
    "scraped_at_utc": "CASE WHEN dan % 5 <> 0 THEN '2024-01-02 07:00:00.5' END", **{c: "'x'" for c in _FILLED_ALWAYS},
}
_ADDED_COLUMNS = (
    "price_diff_top_vs_gross", "gtin_matches_nested", "available_norm", "unit_info_raw", "product_gtin", "gross_price_current_eur",
    "price_diff_top_vs_meta", "dan_matches_nested", "price_diff_gross_vs_meta", "price_eur_top",
)


def _profile_sql() -> str:
    columns = sorted({*reference.EXPORT_COLUMNS, *FLATTENED, *_ADDED_COLUMNS})
    shown = ", ".join(f"{_PROFILED.get(c, 'NULL::VARCHAR')} AS {c}" for c in columns)
    number = lambda section, item, metric, value, source: (
        f"SELECT '{section}' AS section, {item} AS item, '{metric}' AS metric, round(CAST({value} AS DOUBLE), 6) AS value, "
        f"CAST(NULL AS VARCHAR) AS text FROM {source}"
    )
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS col, avg(CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) = '' THEN 100.0 ELSE 0.0 END) AS pct FROM k"
        for c in columns
    )
    ties = ", ".join(f"'{c}'" for c in quality.MISSING_TIE_RANK)
    parts = [
        number("shape", "''", "source_rows", "2 * count(*) + count(*) FILTER (dan % 5 = 0) + count(*) FILTER (dan % 9 = 0) + count(*) FILTER (dan % 12 = 0)", "k"),
        number("shape", "''", "invalid_rows", "count(*) FILTER (dan % 9 = 0) + count(*) FILTER (dan % 12 = 0)", "k"),
        number("shape", "''", "clean_rows", "count(*)", "k"),
        number("shape", "''", "columns", str(len(columns)), "(SELECT 1)"),
        *[number("missing", "col", "missing_pct", "pct", f"({missing}) ORDER BY pct DESC, nullif(list_position([{ties}], col), 0) NULLS LAST, col LIMIT 20")],
        number("headers", "'Material'", "count", "2 * count(*) + count(*) FILTER (dan % 5 = 0)", "k"),
    ]
    for c in quality.KEY_COLUMNS:
        parts.append(number("uniqueness", f"'{c}'", "unique_values", f"count(DISTINCT {c})", "k"))
        parts.append(number("uniqueness", f"'{c}'", "duplicate_rows", f"coalesce(sum(n) FILTER (n > 1), 0)", f"(SELECT count({c}) AS n FROM k GROUP BY {c})"))
    for c in quality.NUMERIC_COLUMNS:
        for metric, value in (("count", f"count({c})"), ("min", f"min({c})"), ("median", f"median({c})"), ("mean", f"avg({c})"), ("max", f"max({c})")):
            parts.append(number("numeric", f"'{c}'", metric, value, f"(SELECT CAST({c} AS DOUBLE) AS {c} FROM k) HAVING count({c}) > 0"))
    for c in quality.COUNTED_COLUMNS:
        value = f"CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) = '' THEN '<NA>' WHEN CAST({c} AS VARCHAR) IN ('true', 'false') THEN upper(substr(CAST({c} AS VARCHAR), 1, 1)) || substr(CAST({c} AS VARCHAR), 2) ELSE CAST({c} AS VARCHAR) END"
        counted = f"(SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS place FROM (SELECT {value} AS v, count(*) AS n FROM k GROUP BY 1) QUALIFY place <= 20)"
        parts += [number("values", f"'{c}=' || v", metric, figure, counted) for metric, figure in (("count", "n"), ("rank", "place"))]
    for name, a, b in quality.PRICE_PAIRS:
        parts.append(number("prices", f"'{name}'", "rows", f"count(*) FILTER (abs(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) > 0.01)", "k"))
    for metric in ("min", "max"):
        parts.append(f"SELECT 'time', '', '{metric}_time', NULL, {metric}(scraped_at_utc) FROM k")
    return f"WITH k AS (SELECT {shown} FROM ({sql.PRODUCTS}))\n" + "\nUNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query("quality_profile")
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile; figures to six digits, times as text."""
    made = reference.build_from_lines(product_lines(spark, d)).profile
    time = F.col("section") == "time"
    return made.select(
        "section", "item", "metric",
        F.when(~time, F.round(F.col("value").cast("double"), 6)).alias("value"), F.when(time, F.col("value")).alias("text"),
    )


def _csv_sql(column: str) -> str:
    """The text of a clean column in a CSV file."""
    if column in ("product_is_pharmacy",) or column.startswith("has_"):
        return f"CASE WHEN {column} THEN 'True' WHEN NOT {column} THEN 'False' ELSE '' END AS {column}"
    if column in sinks.FLOAT_COLUMNS:
        return f"coalesce(CAST(CAST({column} AS DOUBLE) AS VARCHAR), '') AS {column}"
    return f"coalesce(CAST({column} AS VARCHAR), '') AS {column}"


@query("reference_csv", f"SELECT {', '.join(_csv_sql(c) for c in reference.EXPORT_COLUMNS)} FROM ({CLEAN_SQL})")
def reference_csv(spark: SparkSession, d: str) -> DataFrame:
    flat = reference.reconcile(reference.flatten_products(tables.parse_lines(product_lines(spark, d))))
    built = reference.export_rows(reference.dedupe_written(materialize(reference.for_export(flat), "products")))
    path = new_folder(spark, "reference")
    sinks.write_csv(built, path, reference.EXPORT_COLUMNS)
    return tables.read_csv(spark, path).drop("_ord")


# --- the flattened columns outside the export ------------------------------------------------------------

FLATTENED = {
    "slug": "'o' || o_orderkey",
    "product_url": "'https://shop.example/p/' || o_orderkey",
    "detail_api_url": "CASE WHEN o_custkey % 2 = 0 THEN '/api/' || o_orderkey END",
    "scraped_at_utc": "'2024-03-05T10:00:00Z'",
    "available_raw": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "price_raw": "o_custkey || ',99 €'",
    "product_dan": "CAST(o_custkey AS BIGINT)",
    "product_self_slug": "o_orderstatus || '-' || o_orderkey",
    "show_cbm_web": "o_orderkey % 2 = 0",
    "show_cbm_app": "o_orderkey % 2 = 1",
    "brand_product_name": "CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END",
    "title_headline": "'Head ' || o_orderpriority",
    "a11y_label": "o_orderstatus || ' label'",
    "metadata_canonical": "'/c/' || o_orderkey",
    "metadata_currency": "CASE WHEN o_custkey % 4 = 0 THEN 'CHF' ELSE 'EUR' END",
    "metadata_price_eur": "CAST(o_custkey + 0.25 AS DOUBLE)",
    "metadata_page_title": "'Page ' || o_orderkey",
    "metadata_is_pharmacy": "o_orderstatus = 'F'",
    "metadata_description": "CASE WHEN o_custkey % 5 <> 0 THEN 'About ' || o_orderkey END",
    "net_price_current_eur": "CAST(o_custkey + 0.5 AS DOUBLE)",
    "gross_not_increased_since": "strftime(o_orderdate, '%Y-%m-%d')",
    "net_not_increased_since": "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END",
    "payback_info": "(o_orderkey % 100) || ' °P sammeln'",
    "payback_points": "CAST(o_orderkey % 100 AS BIGINT)",
    "seo_brand": "o_orderpriority",
    "seo_category": "o_orderstatus || ' > ' || o_orderpriority",
    "seo_price_eur": "CAST(o_custkey + 0.75 AS DOUBLE)",
    "seo_price_currency": "'EUR'",
    "seo_sku": "'sku' || o_orderkey",
    "breadcrumbs_count": "CAST(4 AS BIGINT)",
    "breadcrumb_4": "o_orderstatus || ' leaf'",
    "breadcrumbs_path": "o_orderstatus || ' > ' || o_orderpriority || ' > ' || o_orderstatus || ' leaf'",
    "metadata_category_codes": "o_orderpriority || '|' || o_orderstatus",
    "gross_price_infos": "'a ' || o_orderkey || ' | b'",
    "net_price_infos": "'n'",
    "eyecatchers_count": "CAST(2 AS BIGINT)",
    "description_headers_count": "CAST(2 AS BIGINT)",
    "description_headers": "'Material | Sonstiges'",
    "description_headers_json": """'["Material","Sonstiges"]'""",
}


def _order_documents(spark: SparkSession, d: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    value = lambda x: F.struct(F.struct(x.alias("value")).alias("current"))
    since = lambda x: F.struct(x.alias("text"))
    group = lambda name: F.struct(F.lit(name).alias("header"), F.array(F.struct(F.array(priority).alias("texts"))).alias("contentBlock"))
    seo = F.struct(
        priority.alias("brand"), text(status, " > ", priority).alias("category"), text("EUR ", customer, ".75").alias("price"),
        F.lit("EUR").alias("priceCurrency"), text("sku", key).alias("sku"),
    )
    metadata = F.struct(
        text("/c/", key).alias("canonical"), F.when(customer % 4 == 0, "CHF").otherwise("EUR").alias("currency"),
        (customer + 0.25).cast("double").alias("price"), text("Page ", key).alias("pageTitle"),
        (status == "F").alias("isPharmacy"), F.when(customer % 5 != 0, text("About ", key)).alias("description"),
        F.array(priority, priority, status).alias("categoryCodes"),
    )
    gross = F.struct(
        since(text("Preis nicht erhöht seit ", day)).alias("notIncreasedSince"),
        text(key % 100, " °P sammeln").alias("paybackInfo"), F.array(text("a ", key), F.lit("b")).alias("infos"),
    )
    net = F.struct(
        value(text(customer, ",50 €")).alias("price"), F.array(F.lit(" "), F.lit("n")).alias("infos"),
        since(F.when(key % 2 == 0, text("seit ", day)).otherwise("seit 45.13.2024")).alias("notIncreasedSince"),
    )
    catcher = F.struct(F.lit("eye").alias("text"))
    product = F.struct(
        customer.alias("dan"), text(status, "-", key).alias("self"),
        (key % 2 == 0).alias("showConfidenceBuildingMeasuresWeb"), (key % 2 == 1).alias("showConfidenceBuildingMeasuresApp"),
        F.struct(F.when(customer % 7 != 0, priority).alias("name")).alias("brand"),
        F.struct(text("Head ", priority).alias("headline")).alias("title"), text(status, " label").alias("a11yLabel"),
        metadata.alias("metadata"), gross.alias("price"), net.alias("netPrice"),
        F.struct(seo.alias("structuredData")).alias("seoInformation"),
        F.array(status, priority, status, text(status, " leaf")).alias("breadcrumbs"),
        F.array(catcher, catcher).alias("eyecatchers"), F.array(group("Material"), group("Sonstiges")).alias("descriptionGroups"),
    )
    document = F.struct(
        text("o", key).alias("slug"), text("https://shop.example/p/", key).alias("product_url"),
        F.when(customer % 2 == 0, text("/api/", key)).alias("detail_api_url"), F.lit("2024-03-05T10:00:00Z").alias("scraped_at_utc"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("available"), text(customer, ",99 €").alias("price"),
        product.alias("product"),
    )
    return _spread(spark, table(spark, d, "orders")).select(F.to_json(document).alias("value"), key.alias("_ord"))


@query("flatten_all", f"SELECT {', '.join(f'{x} AS {c}' for c, x in FLATTENED.items())} FROM orders")
def flatten_all(spark: SparkSession, d: str) -> DataFrame:
    return reference.flatten_products(tables.parse_lines(_order_documents(spark, d))).select(*FLATTENED)


ORACLES["quality_profile"] = _profile_sql()  # its columns are listed above
