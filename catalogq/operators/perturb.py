"""Candidate tables made from a known table: shuffled, renamed, sampled, changed."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators.topk import first_n
from catalogq.sources.sinks import write_csv

# Renaming rules, applied one after the other to the whole name.
RENAMES = (
    ("breadcrumbs", "crumbs"),
    ("breadcrumb", "crumb"),
    ("category_path", "category_tree"),
    ("product_is_pharmacy", "is_pharmacy_product"),
    ("rating_count", "reviews_count"),
    ("rating_value", "rating_score"),
    ("price_eur", "price_eur_amt"),
    ("unit_price", "price_per_unit"),
    ("unit_quantity", "pack_qty"),
    ("currency", "currency_code"),
    ("title_subheadline", "title_subline"),
    ("has_", "is_"),
    ("desc_", "details_"),
    ("eyecatchers", "highlights"),
    ("pills", "badges"),
    ("gtin", "gtin_code"),
    ("dan", "dan_code"),
    ("name", "product_name"),
    ("brand", "brand_name"),
)
DEFAULT_SEED = 42


def renamed_header(name: str) -> str:
    for old, new in RENAMES:
        name = name.replace(old, new)
    return name


def renamed_headers(names: Sequence[str]) -> dict[str, str]:
    """New name per column; a name that comes up again gets _2, _3, …"""
    seen: dict[str, int] = {}
    result = {}
    for name in names:
        new = renamed_header(name)
        seen[new] = seen.get(new, 0) + 1
        result[name] = new if seen[new] == 1 else f"{new}_{seen[new]}"
    return result


def make_candidate(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = DEFAULT_SEED, sample_rows: int = 0
) -> tuple[DataFrame, dict[str, str]]:
    """Columns in seeded order under new names, rows in hash order, optionally only the first ones.

    The row order is the SHA-256 of the seed and the key, so it does not depend on the
    partitioning; it is kept in the column _ord, and write_candidate() writes the rows in it.
    A sample takes the first rows of that order.
    """
    shuffled = list(columns)
    random.Random(seed).shuffle(shuffled)
    mapping = renamed_headers(shuffled)
    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in key]), 256)
    order = F.struct(drawn.alias("hash"), *key)
    rows = df.select(*[F.col(f"`{c}`").alias(mapping[c]) for c in shuffled], order.alias("_ord"))
    if sample_rows > 0:
        rows = first_n(rows, [F.col("_ord")], sample_rows)
    return rows, mapping


def write_candidate(made: DataFrame, path: str) -> None:
    """The rows of make_candidate() as CSV files, in shuffled order inside and over the files."""
    in_order = made.repartitionByRange("_ord").sortWithinPartitions("_ord").drop("_ord")
    write_csv(in_order, path)


def drop_columns(df: DataFrame, names: Sequence[str], blank_rest: Sequence[str] = ()) -> DataFrame:
    """Without the named columns; the columns of blank_rest are emptied."""
    kept = df.drop(*names)
    return kept.withColumns({c: F.lit("") for c in blank_rest if c in kept.columns})


def add_noise_column(df: DataFrame, name: str, position: Column) -> DataFrame:
    return df.withColumn(name, F.format_string("noise_%03d", position.cast("long")))


def pad_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same numbers spelled longer: 1.5 as 1.500, 7 as 7.0."""

    def padded(name: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        return F.when((text == "") | text.isNull(), F.col(name).cast("string")).otherwise(
            F.concat(text, F.when(text.contains("."), F.lit("00")).otherwise(F.lit(".0")))
        )

    return df.withColumns({n: padded(n) for n in names})


def duplicate_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Every row that meets the condition twice, in one pass."""
    copies = F.when(condition, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def remove_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def set_cell(df: DataFrame, condition: Column, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, F.when(condition, value).otherwise(F.col(name)))
