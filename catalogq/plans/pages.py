"""Product pages as a table job: one row with everything a page shows, for every product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.display import (
    field_label,
    first_text,
    price_text,
    product_path,
    rating_note,
    rating_stars,
    rating_summary,
)
from catalogq.functions.text import WHITESPACE
from catalogq.operators.catalogue import ITEM_COLUMNS, SIMILAR_ITEMS, similar_lists

# Fields shown at the top of a page, not among its details.
HEADLINE_FIELDS = (
    "gtin", "dan", "name", "title_headline", "brand", "seo_brand", "price_raw", "price_eur", "metadata_price_eur",
    "currency", "category_path", "seo_category", "image", "image_url", "img", "thumbnail",
    "desc_productbeschreibung", "metadata_description", "rating_value", "rating_count",
)


def _present(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def details(df: DataFrame) -> Column:
    """(label, value) of every other field that is not blank, by field name."""
    fields = sorted(c for c in df.columns if c not in HEADLINE_FIELDS and not c.startswith("_"))
    if not fields:
        return F.array().cast("array<struct<label:string,value:string>>")
    shown = [
        F.struct(F.lit(field_label(c)).alias("label"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields
    ]
    return F.filter(
        F.array(*shown), lambda d: d["value"].isNotNull() & (F.btrim(d["value"], F.lit(WHITESPACE)) != "")
    )


def detail_rows(df: DataFrame, identifier: str = "gtin") -> DataFrame:
    """(id, label, value): the details of every product, one row each."""
    return df.select(F.col(identifier).alias("id"), F.inline(details(df)))


def display_columns(df: DataFrame, identifier: str = "gtin") -> dict[str, Column]:
    """The headline values with their fallbacks."""
    ident = F.coalesce(F.col(identifier).cast("string"), F.lit(""))
    value, count = F.col("rating_value"), F.col("rating_count")
    return {
        "id": ident,
        "product_path": product_path(ident),
        "name": first_text(*_present(df, "name", "title_headline"), F.concat(F.lit("Product "), ident)),
        "brand": first_text(*_present(df, "brand", "seo_brand"), F.lit("Unknown brand")),
        "price": first_text(*_present(df, "price_raw", "price_eur", "metadata_price_eur")),
        "price_text": price_text(F.col("price_eur"), F.col("currency")),
        "category": first_text(*_present(df, "category_path", "seo_category")),
        "image": first_text(*_present(df, "image", "image_url", "img", "thumbnail")),
        "description": first_text(*_present(df, "desc_productbeschreibung", "metadata_description")),
        "rating_summary": rating_summary(value, count),
        "rating_stars": rating_stars(value),
        "rating_note": rating_note(value, count),
    }


def product_payloads(catalogue: DataFrame, identifier: str = "gtin", k: int = SIMILAR_ITEMS) -> DataFrame:
    """Every product with display values, details and similar items.

    The similar items come from the few columns that decide them; the wide rows meet
    them in one join on the id, which must be unique.
    """
    shown = display_columns(catalogue, identifier)
    page = catalogue.select(
        F.col(identifier).alias("_id"), *[c.alias(n) for n, c in shown.items()], details(catalogue).alias("details")
    )
    needed = list(dict.fromkeys([identifier, *[c for c in ITEM_COLUMNS if c != "gtin"]]))
    keyed = catalogue.select(*needed).where(F.col(identifier).isNotNull())
    lists = similar_lists(keyed, identifier, k).select(F.col(identifier).alias("_id"), "similar")
    none = F.array().cast(lists.schema["similar"].dataType)
    joined = page.join(lists, "_id", "left").drop("_id")
    return joined.withColumn("similar", F.coalesce("similar", none))
