"""Reference build: scraped JSON Lines to a clean product table with a quality profile."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catalogq.functions import variants as v
from catalogq.functions.ingest import (
    clean_text,
    equal_if_present,
    first_present,
    join_clean,
    rounded_difference,
    scrape_time,
    unit_info,
)
from catalogq.operators.topk import first_per_group
from catalogq.session import materialize
from catalogq.sources.tables import limit_valid, parse_lines, read_lines

# Description headers with a column of their own, and the clean table's columns.
DESCRIPTION_COLUMNS = {
    "Produktbeschreibung": "desc_productbeschreibung",
    "Produktmerkmale": "desc_produktmerkmale",
    "Verwendungshinweise": "desc_verwendungshinweise",
    "Inhaltsstoffe": "desc_inhaltsstoffe",
    "Aufbewahrungshinweise": "desc_aufbewahrungshinweise",
    "Warnhinweise": "desc_warnhinweise",
    "Hergestellt in": "desc_hergestellt_in",
    "Pflichthinweise": "desc_pflichthinweise",
    "Infos zur Nachhaltigkeit des Produktes": "desc_nachhaltigkeit",
    "Material": "desc_material",
    "Zutaten": "desc_zutaten",
    "Nährwerte": "desc_naehrwerte",
    "Allergene": "desc_allergene",
    "Lieferumfang": "desc_lieferumfang",
}
EXPORT_COLUMNS = (
    "gtin", "dan", "name", "brand", "title_subheadline", "price_eur", "currency",
    "unit_quantity", "unit_quantity_unit", "unit_price_eur", "unit_price_per_quantity", "unit_price_per_unit",
    "category_path", "breadcrumb_1", "breadcrumb_2", "breadcrumb_3", "breadcrumbs_path", "product_is_pharmacy",
    "rating_count", "rating_value", "has_variants", "has_videos", "has_seals", "has_pills", "has_eyecatchers",
    "eyecatchers", "pills", *DESCRIPTION_COLUMNS.values(),
)
DEFAULT_CURRENCY = "EUR"
SCRAPED_AT = "_scraped_at_time"
# The raw products and the scratch columns of the flattening steps.
_SEO = "$.product.seoInformation.structuredData"


def _scalars(doc: v.Members) -> dict[str, Column]:
    """Columns that one path and one coercion give."""
    return {
        "gtin": v.article_digits(doc, "$.gtin"),
        "dan": v.whole(doc, "$.dan"),
        "product_url": v.text(doc, "$.product_url"),
        "detail_api_url": v.text(doc, "$.detail_api_url"),
        "slug": v.text(doc, "$.slug"),
        "scraped_at_utc": v.text(doc, "$.scraped_at_utc"),
        "name": v.text(doc, "$.name"),
        "brand": v.text(doc, "$.brand"),
        "available_raw": v.boolean(doc, "$.available"),
        "price_raw": v.text(doc, "$.price"),
        "price_eur_top": v.euros(doc, "$.price"),
        "product_gtin": v.article_digits(doc, "$.product.gtin"),
        "product_dan": v.whole(doc, "$.product.dan"),
        "product_self_slug": v.text(doc, "$.product.self"),
        "product_is_pharmacy": v.boolean(doc, "$.product.isPharmacy"),
        "show_cbm_web": v.boolean(doc, "$.product.showConfidenceBuildingMeasuresWeb"),
        "show_cbm_app": v.boolean(doc, "$.product.showConfidenceBuildingMeasuresApp"),
        "brand_product_name": v.text(doc, "$.product.brand.name"),
        "title_headline": v.text(doc, "$.product.title.headline"),
        "title_subheadline": v.text(doc, "$.product.title.subheadline"),
        "a11y_label": v.text(doc, "$.product.a11yLabel"),
        "rating_count": v.whole(doc, "$.product.rating.ratingCount"),
        "rating_value": v.decimal(doc, "$.product.rating.ratingValue"),
        "metadata_canonical": v.text(doc, "$.product.metadata.canonical"),
        "metadata_currency": v.text(doc, "$.product.metadata.currency"),
        "metadata_price_eur": v.euros(doc, "$.product.metadata.price"),
        "metadata_page_title": v.text(doc, "$.product.metadata.pageTitle"),
        "metadata_is_pharmacy": v.boolean(doc, "$.product.metadata.isPharmacy"),
        "metadata_description": v.text(doc, "$.product.metadata.description"),
        "gross_price_current_eur": v.euros(doc, "$.product.price.price.current.value"),
        "net_price_current_eur": v.euros(doc, "$.product.netPrice.price.current.value"),
        "gross_not_increased_since": v.date_in(doc, "$.product.price.notIncreasedSince.text"),
        "net_not_increased_since": v.date_in(doc, "$.product.netPrice.notIncreasedSince.text"),
        "payback_info": v.text(doc, "$.product.price.paybackInfo"),
        "payback_points": v.integer_in(doc, "$.product.price.paybackInfo"),
        "seo_brand": v.text(doc, f"{_SEO}.brand"),
        "seo_category": v.text(doc, f"{_SEO}.category"),
        "seo_price_eur": v.euros(doc, f"{_SEO}.price"),
        "seo_price_currency": v.text(doc, f"{_SEO}.priceCurrency"),
        "seo_sku": v.text(doc, f"{_SEO}.sku"),
        "has_variants": v.is_object(doc, "$.product.variants"),
        "has_videos": F.size(v.items(doc, "$.product.videos")) > 0,
        "has_seals": F.size(v.items(doc, "$.product.seals")) > 0,
    }


def _array_columns(doc: v.Members) -> dict[str, Column]:
    """Scratch arrays that several columns are made from; each is read from the document once."""
    return {
        "_crumbs": F.transform(v.items(doc, "$.product.breadcrumbs", "string"), clean_text),
        "_codes": v.texts(doc, "$.product.metadata.categoryCodes"),
        "_gross": v.texts(doc, "$.product.price.infos"),
        "_net": v.texts(doc, "$.product.netPrice.infos"),
        "_catchers": v.items(doc, "$.product.eyecatchers"),
        "_pills": v.labels(v.items(doc, "$.product.pills"), ("text", "label")),
        "_groups": v.description_groups(v.items(doc, "$.product.descriptionGroups", v.GROUP), tuple(DESCRIPTION_COLUMNS)),
    }


def flatten_products(docs: DataFrame) -> DataFrame:
    """One wide row per valid document: `_ord`, the scrape time and 80 named columns."""
    # Each path by itself would walk down from the root again.
    found, columns = v.members(lambda doc: {**_scalars(doc), **_array_columns(doc)}, "_members")
    wide = found.of(docs.where("valid"), "doc", "_ord").select("_ord", *[c.alias(n) for n, c in columns.items()])
    wide = wide.withColumn("_eyecatchers", v.labels(F.col("_catchers"), ("text", "label", "alt")))
    wide = wide.withColumn("_last_first", F.reverse("_groups")).withColumn("_headers_last_first", F.col("_last_first.header"))
    crumbs, headers = F.col("_crumbs"), F.col("_groups.header")

    def body(header: str) -> Column:
        # A header that comes up again replaces the earlier text, even by nothing.
        return F.get("_last_first", (F.array_position("_headers_last_first", header) - 1).cast("int"))["body"]

    return wide.withColumns(
        {
            SCRAPED_AT: scrape_time(F.col("scraped_at_utc")),
            "breadcrumbs_count": F.size(crumbs).cast("bigint"),
            **{f"breadcrumb_{i}": F.get(crumbs, F.lit(i - 1)) for i in range(1, 5)},
            "breadcrumbs_path": join_clean(crumbs, " > "),
            "metadata_category_codes": join_clean(F.col("_codes"), "|"),
            "gross_price_infos": join_clean(F.col("_gross"), " | "),
            "net_price_infos": join_clean(F.col("_net"), " | "),
            **unit_info(F.col("_gross")),
            "has_pills": F.size("_pills") > 0,
            "has_eyecatchers": F.size("_eyecatchers") > 0,
            "eyecatchers_count": F.size("_catchers").cast("bigint"),
            "eyecatchers": join_clean(F.col("_eyecatchers"), " | "),
            "pills": join_clean(F.col("_pills"), " | "),
            "description_headers_count": F.size("_groups").cast("bigint"),
            "description_headers": join_clean(headers, " | "),
            "description_headers_json": F.to_json(headers),
            "_headers": headers,
            **{column: body(header) for header, column in DESCRIPTION_COLUMNS.items()},
        }
    ).drop("_crumbs", "_codes", "_gross", "_net", "_catchers", "_eyecatchers", "_pills", "_groups", "_last_first", "_headers_last_first")


def reconcile(rows: DataFrame) -> DataFrame:
    """Fill gaps from the other places a product states the same fact, and note disagreements."""
    filled = rows.withColumns(
        {
            "available_norm": F.col("available_raw"),
            "brand": first_present(F.col("brand"), F.col("brand_product_name")),
            "gtin": first_present(F.col("gtin"), F.col("product_gtin")),
            "dan": F.coalesce("dan", "product_dan"),
            "price_eur": F.coalesce(
                "price_eur_top", "gross_price_current_eur", "metadata_price_eur", "seo_price_eur"
            ),
            "category_path": first_present(F.col("seo_category"), F.col("breadcrumbs_path")),
            "currency": first_present(
                F.col("metadata_currency"), F.col("seo_price_currency"), F.lit(DEFAULT_CURRENCY)
            ),
            "price_diff_top_vs_gross": rounded_difference(F.col("price_eur_top"), F.col("gross_price_current_eur")),
            "price_diff_top_vs_meta": rounded_difference(F.col("price_eur_top"), F.col("metadata_price_eur")),
            "price_diff_gross_vs_meta": rounded_difference(
                F.col("gross_price_current_eur"), F.col("metadata_price_eur")
            ),
        }
    )
    return filled.withColumns(
        {
            "gtin_matches_nested": equal_if_present(F.col("gtin"), F.col("product_gtin")),
            "dan_matches_nested": equal_if_present(F.col("dan"), F.col("product_dan")),
        }
    )


def dedupe_latest(rows: DataFrame, keep_null_keys: bool = False) -> DataFrame:
    """The last row per gtin in the order scrape time, dan (a missing one comes last), input.

    Rows without a gtin count as one product unless keep_null_keys is set. Each task
    keeps one row per gtin before the shuffle.
    """
    order = [F.col(SCRAPED_AT).desc_nulls_first(), F.col("dan").desc_nulls_first(), F.col("_ord").desc()]
    keyed = rows.withColumn("_product", F.coalesce(F.col("gtin"), F.lit("")))
    if not keep_null_keys:
        return first_per_group(keyed, ["_product"], order).drop("_product")
    known = first_per_group(keyed.where("_product <> ''"), ["_product"], order)
    return known.unionByName(keyed.where("_product = ''")).drop("_product")


def dedupe_written(rows: DataFrame) -> DataFrame:
    """dedupe_latest for rows that are read from files: the wide rows are not shuffled for it.

    Four columns decide which rows stay. The outdated ones are named by their input
    position and taken out of the full rows, by a broadcast when adaptive execution
    finds them few, else by a join on the position, which no two rows share.
    """
    narrow = rows.select("gtin", "dan", SCRAPED_AT, "_ord")
    outdated = narrow.select("_ord").join(dedupe_latest(narrow).select("_ord"), "_ord", "left_anti")
    return rows.join(outdated, "_ord", "left_anti")


def for_export(rows: DataFrame) -> DataFrame:
    """What the clean table and the choice of its rows take from reconciled rows; the other columns need not be made or written."""
    return rows.select(*EXPORT_COLUMNS, SCRAPED_AT, "_ord")


def export_rows(rows: DataFrame) -> DataFrame:
    """The clean table: 41 columns in fixed order."""
    return rows.select(*EXPORT_COLUMNS)


def described_columns(rows: DataFrame) -> list[str]:
    """The columns a profile covers."""
    return sorted(c for c in rows.columns if not c.startswith("_"))


@dataclass(frozen=True)
class ReferenceBuild:
    """The outcome of a build: all kept rows, the clean table, line counts and the profile."""

    rows: DataFrame
    clean: DataFrame
    source_rows: int
    invalid_rows: int
    rows_before_dedupe: int
    flat: DataFrame

    @cached_property
    def profile(self) -> DataFrame:
        """The quality profile; only computed when it is asked for."""
        from catalogq.plans.quality import quality_profile

        return quality_profile(self.rows, self.flat, self.source_rows, self.invalid_rows)

    @property
    def clean_rows(self) -> int:
        return self.clean.count()

    @property
    def duplicates_removed(self) -> int:
        return self.rows_before_dedupe - self.clean_rows


def build_from_lines(lines: DataFrame, limit: int = 0) -> ReferenceBuild:
    """Lines (value, _ord) to the clean table and profile.

    The input is parsed once: the lines are counted while the flattened rows are written to
    the shared folder. The kept rows are written too, because the profile, the sinks and any
    later comparison read them again.
    """
    docs = limit_valid(parse_lines(lines), limit)
    seen = Observation()
    counted = docs.observe(
        seen, F.count(F.lit(1)).alias("source_rows"), F.count_if(~F.col("valid")).alias("invalid_rows")
    )
    flat = materialize(reconcile(flatten_products(counted)), "products")
    source, invalid = seen.get["source_rows"], seen.get["invalid_rows"]
    kept = materialize(dedupe_written(flat), "kept")
    return ReferenceBuild(kept, export_rows(kept), source, invalid, source - invalid, flat)


def build_reference(spark: SparkSession, path: str, limit: int = 0) -> ReferenceBuild:
    return build_from_lines(read_lines(spark, path), limit)
