"""Reference build on hand-made lines with every edge the format has."""

import json

import pytest
from pyspark.sql import functions as F

from catalogq.plans import quality, reference
from catalogq.plans.reference import EXPORT_COLUMNS, build_from_lines, build_reference, flatten_products, reconcile
from catalogq.sources import sinks, tables

FULL = {
    "gtin": 4012345678901,
    "dan": "12.7",
    "name": " A b ",
    "price": "1.299,00 €",
    "available": True,
    "scraped_at_utc": "2024-01-01T00:00:00.5Z",
    "product": {
        "isPharmacy": "true",
        "brand": {"name": "Brand"},
        "title": {"headline": "H", "subheadline": " "},
        "breadcrumbs": ["x", None, "x", {"a": 1}, "y"],
        "rating": {"ratingCount": 7.9, "ratingValue": "4.5"},
        "variants": {},
        "videos": [],
        "seals": [0],
        "pills": ["p", {"text": "q", "label": " "}, "p"],
        "eyecatchers": [{"alt": "z"}, 5],
        "metadata": {"price": 1299, "currency": " ", "categoryCodes": ["1", 2, "1"]},
        "price": {
            "infos": ["neu", "0,5 l (3,90 € je 1 l)", "neu"],
            "price": {"current": {"value": 1298.5}},
            "notIncreasedSince": {"text": "seit 31.01.2024"},
            "paybackInfo": "12 Punkte",
        },
        "seoInformation": {"structuredData": {"category": "Cat", "price": "1e3", "sku": 5}},
        "descriptionGroups": [
            {
                "header": "Material",
                "contentBlock": [
                    {
                        "texts": ["t1", "t1", " "],
                        "links": [{"linkText": "l", "href": "h"}, 3],
                        "descriptionList": [{"title": "T", "description": "D"}, {"title": "T2"}, {"description": "D2"}, 1],
                        "table": [["a", None, "b"], [], ["c", ""], "no row"],
                    },
                    "no block",
                    {"bulletpoints": ["t2", "h"]},
                ],
            },
            {"header": "Other"},
            {"header": " "},
            "no group",
            {"header": "Zutaten", "contentBlock": [{"texts": ["first"]}]},
            {"header": "Zutaten"},
        ],
    },
}


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "_ord long, value string")


def flat(spark, *docs):
    return reconcile(flatten_products(tables.parse_lines(lines(spark, [json.dumps(d) for d in docs]))))


def test_full_product(spark):
    rows = flat(spark, FULL)
    assert len(reference.described_columns(rows)) == 89
    row = rows.first().asDict()
    expected = {
        "gtin": "4012345678901", "dan": 12, "name": "A b", "brand": "Brand", "price_eur_top": 1299.0, "price_eur": 1299.0,
        "available_norm": True, "product_is_pharmacy": None, "title_headline": "H", "title_subheadline": None,
        "breadcrumbs_count": 5, "breadcrumb_1": "x", "breadcrumb_2": None, "breadcrumb_3": "x", "breadcrumb_4": '{"a":1}',
        "breadcrumbs_path": 'x > {"a":1} > y', "rating_count": 7, "rating_value": 4.5, "has_variants": True,
        "has_videos": False, "has_seals": True, "has_pills": True, "pills": "p | q", "eyecatchers": "z | 5",
        "eyecatchers_count": 2, "metadata_price_eur": 1299.0, "metadata_currency": None, "currency": "EUR",
        "metadata_category_codes": "1|2", "gross_price_infos": "neu | 0,5 l (3,90 € je 1 l)", "unit_quantity": 0.5,
        "unit_quantity_unit": "l", "unit_price_per_quantity": 1.0, "unit_price_per_unit": "l", "unit_price_eur": 3.9,
        "gross_price_current_eur": 1298.5, "gross_not_increased_since": "2024-01-31", "payback_points": 12,
        "seo_category": "Cat", "category_path": "Cat", "seo_price_eur": 13.0, "seo_sku": "5",
        "price_diff_top_vs_gross": 0.5, "price_diff_top_vs_meta": 0.0, "price_diff_gross_vs_meta": -0.5,
        "gtin_matches_nested": None, "dan_matches_nested": None, "description_headers_count": 4,
        "description_headers": "Material | Other | Zutaten",
        "description_headers_json": '["Material","Other","Zutaten","Zutaten"]',
        "desc_material": "t1\nl\nh\nT: D\nT2\nD2\na /  / b || c /\nt2", "desc_zutaten": None, "desc_allergene": None,
    }
    assert {k: row[k] for k in expected} == expected


def test_number_and_text_prices(spark):
    docs = [{"price": p} for p in (12.5, 1e25, "1.0E25", True, [1], "1.234", "+5", None)]
    got = [r["price_eur_top"] for r in flat(spark, *docs).orderBy("_ord").collect()]
    assert got == [12.5, 1e25, 1.025, None, 1.0, 1.234, 5.0, None]


def test_line_kinds_are_counted(spark):
    texts = ['{"name":"a"}', "", "  ", "{broken", "null", "[1]", "3", '"x"', '{"a":1,"a":2}', " {} "]
    docs = tables.parse_lines(lines(spark, texts))
    assert tuple(tables.line_counts(docs).first()) == (8, 4)
    assert flatten_products(docs).count() == 4


def test_repeated_json_key_keeps_the_last(spark):
    doc = tables.parse_lines(lines(spark, ['{"name":"a","name":"b"}']))
    assert flatten_products(doc).first()["name"] == "b"


def test_limit_stops_after_valid_rows(spark):
    docs = tables.parse_lines(lines(spark, ["{bad", '{"a":1}', "[1]", '{"a":2}', "{bad", '{"a":3}']))
    assert tuple(tables.line_counts(tables.limit_valid(docs, 2)).first()) == (4, 2)
    assert tuple(tables.line_counts(tables.limit_valid(docs, 9)).first()) == (6, 3)
    assert tuple(tables.line_counts(tables.limit_valid(docs, 0)).first()) == (6, 3)


def scrape(gtin, time, dan, name):
    doc = {"gtin": gtin, "dan": dan, "name": name}
    if time:
        doc["scraped_at_utc"] = time
    return doc


def test_latest_row_wins_and_a_row_without_time_beats_all(spark):
    rows = flat(
        spark,
        scrape("1", "2024-01-02T00:00:00Z", 1, "new"), scrape("1", "2024-01-01T00:00:00Z", 9, "old"),
        scrape("2", "2024-01-02T00:00:00Z", 1, "timed"), scrape("2", None, 1, "timeless"),
        scrape("3", "2024-01-01T00:00:00Z", None, "no dan"), scrape("3", "2024-01-01T00:00:00Z", 5, "dan"),
        scrape("4", "2024-01-01T00:00:00Z", 5, "first"), scrape("4", "2024-01-01T00:00:00Z", 5, "second"),
        scrape(None, "2024-01-01T00:00:00Z", 1, "a"), scrape(None, "2024-01-02T00:00:00Z", 1, "b"),
    )
    kept = {r["gtin"]: r["name"] for r in reference.dedupe_latest(rows).collect()}
    assert kept == {"1": "new", "2": "timeless", "3": "no dan", "4": "second", None: "b"}
    assert reference.dedupe_latest(rows, keep_null_keys=True).count() == 6
    written = {r["gtin"]: r["name"] for r in reference.dedupe_written(rows).collect()}
    assert written == kept


def test_build_from_files_to_sinks(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    docs = [dict(FULL, gtin=str(i), dan=i, name=f"n,{i}\n\"q\"") for i in range(5)] + [dict(FULL, gtin="0", dan=0, name="again")]
    source.write_text("\n".join(json.dumps(d) for d in docs) + "\n{bad\n", encoding="utf-8")
    built = build_reference(spark, str(source))
    assert (built.source_rows, built.invalid_rows, built.clean_rows, built.duplicates_removed) == (7, 1, 5, 1)
    assert tuple(built.clean.columns) == EXPORT_COLUMNS
    kinds = dict(built.clean.dtypes)
    assert kinds["dan"] == "bigint" and kinds["price_eur"] == "double" and kinds["has_pills"] == "boolean"

    sinks.write_csv(built.clean, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"))
    row = back.where("gtin = '3'").first()
    assert row["name"] == 'n,3\n"q"' and row["has_variants"] == "True" and row["price_eur"] == "1299.0"
    assert row["product_is_pharmacy"] == "" and row["dan"] == "3"

    sinks.write_clean_table(built.clean, str(tmp_path / "table"))
    assert tables.read_table(spark, str(tmp_path / "table"), "gtin").count() == 5
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "table"), "no_such_column")

    text = sinks.write_profile(built.profile, str(tmp_path / "profile"))
    assert "clean_rows=5" in text and "## numeric" in text
    shape = {r["metric"]: r["value"] for r in built.profile.where("section = 'shape'").collect()}
    assert shape == {"source_rows": "7", "invalid_rows": "1", "clean_rows": "5", "columns": "89"}


def test_built_table_equals_itself(spark, tmp_path):
    """The CSV of a build, read back, is a full match for the built rows."""
    from catalogq.plans.compare import compare

    docs = [dict(FULL, gtin=str(1000 + i), dan=500 + i, name=f"n {i % 7}") for i in range(30)]
    built = build_from_lines(lines(spark, [json.dumps(d) for d in docs]))
    sinks.write_csv(built.clean, str(tmp_path / "a"))
    left, right = (tables.csv_table(spark, str(tmp_path / "a")) for _ in range(2))
    report = compare(left, right)
    assert report["status"] == "ok" and report["summary"]["overall_score_with_coverage"] == 1.0


def test_median_of_even_and_odd_counts(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (10.0, None), (4.0, 7)], "a double, b int")
    got = {r["column"]: tuple(r)[1:] for r in quality.numeric_summary(df, ["a", "b"]).collect()}
    assert got == {"a": (4, 1.0, 3.0, 4.25, 10.0), "b": (3, 5.0, 5.0, 17 / 3, 7.0)}


def test_median_with_a_hot_value(spark):
    df = spark.range(30_001).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("a"))
    row = quality.numeric_summary(df, ["a"]).first()
    expected = sorted(7.0 if i % 3 == 0 else float(i) for i in range(30_001))[15_000]
    assert row["median"] == expected and row["count"] == 30_001


def test_missing_ties_follow_rank_then_name(spark):
    df = spark.createDataFrame([(None, " ", None, "x")], "z string, unit_quantity string, breadcrumb_4 string, a string")
    shares = quality.most_missing(df, ["a", "breadcrumb_4", "unit_quantity", "z"]).collect()
    assert [r["column"] for r in shares] == ["breadcrumb_4", "unit_quantity", "z", "a"]
    assert [r["missing_pct"] for r in shares] == [100.0, 100.0, 100.0, 0.0]


def test_members_are_read_in_one_pass(spark):
    """The named members come from one struct; before, each path walked down from the root."""
    texts = ['{"name":" a\\u00a0b ","price":1e2,"available":"true","product":{"dan":7,"isPharmacy":true,"variants":{},"brand":"x"}}', '{"product":[1]}', "null"]
    flat = flatten_products(tables.parse_lines(lines(spark, texts)))
    shown = ["name", "price_eur_top", "available_raw", "product_dan", "product_is_pharmacy", "has_variants", "brand_product_name"]
    assert [tuple(r) for r in flat.orderBy("_ord").select(shown).collect()] == [
        ("a b", 100.0, None, 7, True, True, None), (None, None, None, None, None, False, None), (None, None, None, None, None, False, None),
    ]
    plan = flat.select("name", "slug", "product_dan", "metadata_canonical")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_variant_get(doc") == 1, plan


def test_order_documents_are_spread_over_tasks(spark, tmp_path):
    from catalogq.workloads import building

    spark.range(100).selectExpr("id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "'1' as o_orderpriority", "date'2024-01-01' as o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    dealt = building._order_documents(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


ODD_GROUPS = """{"product":{"descriptionGroups":[7,null,"x",[1],{"header":" "},
 {"header":"Material","contentBlock":[{"texts":["old"]}]},
 {"header":"Zutaten","contentBlock":[5,{"texts":"no array","bulletpoints":[" b ",null,3,{"a":1},true]},
  {"links":["u",{"linkText":"more","href":null},{"href":"/h"}],"descriptionList":[1,{"title":"t"},{"title":" ","description":"d"},{"title":"t","description":"d"}],
   "table":["r",[],["a",null," c "],[2]]}]},
 {"header":"Material"},{"header":9,"contentBlock":{}}]}}"""


def test_description_groups_of_other_kinds(spark):
    lines = spark.createDataFrame([(1, ODD_GROUPS.replace("\n", ""))], "_ord long, value string")
    row = flatten_products(tables.parse_lines(lines)).first()
    assert row["_headers"] == ["Material", "Zutaten", "Material", "9"]
    assert row["desc_material"] is None and row["desc_allergene"] is None
    assert row["desc_zutaten"] == 'b\n3\n{"a":1}\ntrue\nmore\n/h\nt\nd\nt: d\na /  / c || 2'


def test_flattening_walks_the_groups_once(spark):
    lines = spark.createDataFrame([(1, "{}")], "_ord long, value string")
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = flatten_products(tables.parse_lines(lines))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    # Neither a search of all groups for every header nor a walk from each group down to each of its parts.
    assert plan.count("lambdafunction(") <= 40
