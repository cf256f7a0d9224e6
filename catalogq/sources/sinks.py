"""Sinks: CSV files, the clean table, the profile, JSON payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.display import float_text
from catalogq.plans.quality import render_markdown
from catalogq.sources.layout import clustered

# Fixed value: columns written with a decimal point even when whole.
FLOAT_COLUMNS = ("price_eur", "unit_quantity", "unit_price_eur", "unit_price_per_quantity", "rating_value")
# Columns of the clean table that lookups use, and those of them that are ids.
LOOKUP_COLUMNS = ("category_path", "brand", "gtin", "dan")
ID_COLUMNS = ("gtin", "dan")
ROW_GROUP_BYTES = 32 << 20


def csv_cell(df: DataFrame, name: str) -> Column:
    """The text of a cell: True and False, floats with a point, missing as ''."""
    value, kind = F.col(f"`{name}`"), df.schema[name].dataType.simpleString()
    if kind == "boolean":
        shown = F.when(value, F.lit("True")).when(~value, F.lit("False"))
    elif kind in ("double", "float"):
        text = float_text(value.cast("double"))
        shown = text if name in FLOAT_COLUMNS else F.regexp_replace(text, r"\.0$", "")
    elif kind == "timestamp":
        shown = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("")).alias(name)


def csv_rows(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Every listed column as the text a CSV file shows."""
    return df.select(*[csv_cell(df, c) for c in (columns or df.columns)])


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """CSV files with a header; quotes only where needed, doubled inside, white space kept."""
    (
        csv_rows(df, columns)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


def write_clean_table(
    df: DataFrame, path: str, columns: Sequence[str] = LOOKUP_COLUMNS, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Parquet laid out so that a lookup on any of the columns reads few row groups.

    Ids get Bloom filters besides: their ranges in a row group are narrow only in part. Columns
    that the table does not have are passed over.
    """
    present = [c for c in columns if c in df.columns]
    rows = clustered(df, present) if present else df
    writer = rows.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in ID_COLUMNS:
        if name in present:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def write_profile(profile: DataFrame, path: str) -> str:
    """The long-form profile as one JSON file; returns the text report."""
    profile.coalesce(1).write.mode("overwrite").json(path)
    return render_markdown(profile)


def json_payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """Each row as a JSON document."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
