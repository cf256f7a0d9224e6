"""Quality profile of the built product rows, as rows (section, item, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.text import WHITESPACE, trimmed
from catalogq.operators.rowindex import with_running_total
from catalogq.operators.topk import top_per_group

# Profiled columns, list lengths, tie ranks, tolerance.
KEY_COLUMNS = ("gtin", "dan", "product_url", "slug")
NUMERIC_COLUMNS = (
    "price_eur_top", "gross_price_current_eur", "net_price_current_eur", "metadata_price_eur", "seo_price_eur",
    "rating_count", "rating_value",
)
COUNTED_COLUMNS = (
    "brand", "brand_product_name", "breadcrumb_1", "breadcrumb_2", "breadcrumb_3", "seo_category",
    "metadata_currency", "seo_price_currency", "available_norm", "has_variants", "has_videos", "has_seals",
    "has_pills", "has_eyecatchers",
)
MISSING_TIE_RANK = ("breadcrumb_4", "available_raw", "available_norm", "unit_quantity", "unit_price_eur")
PRICE_PAIRS = (
    ("top_vs_gross_abs_diff", "price_eur_top", "gross_price_current_eur"),
    ("top_vs_meta_abs_diff", "price_eur_top", "metadata_price_eur"),
    ("gross_vs_meta_abs_diff", "gross_price_current_eur", "metadata_price_eur"),
)
LISTED_MISSING = LISTED_VALUES = 20
LISTED_HEADERS = 30
PRICE_TOLERANCE = 0.01
NO_VALUE = "<NA>"


def is_missing(value: Column) -> Column:
    return value.isNull() | (F.btrim(value.cast("string"), F.lit(WHITESPACE)) == "")


def _values(rows: DataFrame, columns: Sequence[str], form) -> DataFrame:
    """(column, value): one row per cell of the listed columns."""
    return rows.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), form(c).alias("value")) for c in columns]))
    )


def uniqueness(rows: DataFrame, columns: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """(column, unique_values, duplicate_rows): distinct values, and rows whose value repeats."""
    present = _values(rows, columns, lambda c: F.when(~is_missing(F.col(c)), trimmed(F.col(c).cast("string"))))
    per_value = present.groupBy("column", "value").agg(F.count("value").alias("n"))
    return per_value.groupBy("column").agg(
        F.count("value").alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )


def missing_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing_pct) for every column, from one aggregation."""
    shares = rows.agg(*[F.avg(is_missing(F.col(c)).cast("double")).alias(c) for c in columns])
    return shares.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`") * 100, F.lit(0.0)).alias("missing_pct")
                    )
                    for c in columns
                ]
            )
        )
    )


def most_missing(rows: DataFrame, columns: Sequence[str], listed: int = LISTED_MISSING) -> DataFrame:
    """The columns with the largest share of missing values; ties by fixed rank, then name."""
    rank = reduce(
        lambda chain, item: chain.when(F.col("column") == item[1], item[0]),
        enumerate(MISSING_TIE_RANK[1:], 1),
        F.when(F.col("column") == MISSING_TIE_RANK[0], 0),
    )
    order = [F.col("missing_pct").desc(), rank.asc_nulls_last(), F.col("column")]
    return missing_shares(rows, columns).orderBy(*order).limit(listed)


def time_range(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.min(column).alias("min_time"), F.max(column).alias("max_time"))


def numeric_summary(rows: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """(column, count, min, median, mean, max); columns without numbers are left out.

    The median is exact and has no single-task step: equal numbers are counted
    together, running totals are taken inside range partitions, and the one or two
    middle values are the rows whose running total passes the middle positions.
    """
    numbers = _values(rows, columns, lambda c: F.col(c).cast("double")).where("value is not null")
    counted = numbers.groupBy("column", "value").agg(F.count("*").alias("n"))
    running = with_running_total(counted, "column", "value", "n", "upto")
    # The weighted figures come from the same per-value counts.
    totals = running.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.min("value").alias("min"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("value").alias("max"),
    )
    low = F.floor((F.col("count") - 1) / 2)
    high = F.floor(F.col("count") / 2)

    def holds(position: Column) -> Column:
        return (position >= F.col("upto") - F.col("n")) & (position < F.col("upto"))

    middle = (
        running.join(F.broadcast(totals.select("column", "count")), "column")
        .where(holds(low) | holds(high))
        .groupBy("column")
        .agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    )
    return totals.join(middle, "column").select("column", "count", "min", "median", "mean", "max")


def _shown(rows: DataFrame, column: str) -> Column:
    value = F.col(column)
    kind = rows.schema[column].dataType.simpleString()
    if kind == "boolean":
        return F.when(value, F.lit("True")).otherwise(F.lit("False"))
    return value.cast("string")


def value_counts(
    rows: DataFrame, columns: Sequence[str] = COUNTED_COLUMNS, listed: int = LISTED_VALUES
) -> DataFrame:
    """(column, value, count, rank): the commonest values per column, missing ones as <NA>."""
    shown = _values(
        rows, columns, lambda c: F.when(is_missing(F.col(c)), F.lit(NO_VALUE)).otherwise(_shown(rows, c))
    )
    counted = shown.groupBy("column", "value").agg(F.count("*").alias("count"))
    return top_per_group(counted, ["column"], [F.col("count").desc(), F.col("value")], listed, "rank")


def header_counts(rows: DataFrame, headers: str = "_headers", listed: int = LISTED_HEADERS) -> DataFrame:
    """(header, count): how often each description header occurs, repeats included."""
    return (
        rows.select(F.explode(headers).alias("header"))
        .groupBy("header")
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "header")
        .limit(listed)
    )


def price_disagreements(rows: DataFrame, pairs: Sequence[tuple[str, str, str]] = PRICE_PAIRS) -> DataFrame:
    """(pair, rows): rows in which two prices differ by more than a cent."""
    counts = rows.agg(
        *[F.count_if(F.abs(F.col(a) - F.col(b)) > PRICE_TOLERANCE).alias(name) for name, a, b in pairs]
    )
    return counts.select(
        F.inline(
            F.array(*[F.struct(F.lit(name).alias("pair"), F.col(name).alias("rows")) for name, _, _ in pairs])
        )
    )


def dataset_shape(rows: DataFrame, source_rows: int, invalid_rows: int, columns: int) -> DataFrame:
    return rows.agg(F.count("*").alias("clean_rows")).select(
        F.lit(source_rows).cast("bigint").alias("source_rows"),
        F.lit(invalid_rows).cast("bigint").alias("invalid_rows"),
        "clean_rows",
        F.lit(columns).cast("bigint").alias("columns"),
    )


def quality_profile(kept: DataFrame, flat: DataFrame, source_rows: int, invalid_rows: int) -> DataFrame:
    """All figures in long form. Headers are counted over all valid rows, the rest over the kept ones."""
    columns = sorted(c for c in kept.columns if not c.startswith("_"))

    def long(section: str, df: DataFrame, item: str | None, metrics: Sequence[str]) -> DataFrame:
        entry = F.lit("") if item is None else F.col(item).cast("string")
        figures = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics]
        return df.select(
            F.lit(section).alias("section"), entry.alias("item"), F.inline(F.array(*figures))
        )

    counts = value_counts(kept).withColumn("item", F.concat_ws("=", "column", "value"))
    parts = [
        long("shape", dataset_shape(kept, source_rows, invalid_rows, len(columns)), None,
             ["source_rows", "invalid_rows", "clean_rows", "columns"]),
        long("uniqueness", uniqueness(kept), "column", ["unique_values", "duplicate_rows"]),
        long("missing", most_missing(kept, columns), "column", ["missing_pct"]),
        long("time", time_range(kept, "_scraped_at_time"), None, ["min_time", "max_time"]),
        long("numeric", numeric_summary(kept), "column", ["count", "min", "median", "mean", "max"]),
        long("values", counts, "item", ["count", "rank"]),
        long("headers", header_counts(flat), "header", ["count"]),
        long("prices", price_disagreements(kept), "pair", ["rows"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def render_markdown(profile: DataFrame) -> str:
    """The profile as a text report; it has a few hundred lines at most, whatever the data."""
    sections: dict[str, dict[str, dict[str, str]]] = {s: {} for s in SECTIONS}
    for r in profile.collect():
        sections[r["section"]].setdefault(r["item"], {})[r["metric"]] = r["value"]
    text = ["# Product profile", ""]
    for section, entries in sections.items():
        if not entries:
            continue
        text.append(f"## {section}")
        for item, figures in sorted(entries.items(), key=lambda e: _place(section, *e)):
            shown = ", ".join(f"{metric}={_shown_number(value)}" for metric, value in figures.items() if metric != "rank")
            text.append(f"- {item + ': ' if item else ''}{shown}")
        text.append("")
    return "\n".join(text)


SECTIONS = ("shape", "uniqueness", "missing", "time", "numeric", "values", "headers", "prices")


def _place(section: str, item: str, figures: dict[str, str]) -> tuple:
    """Value lists by column and rank, shares and header counts from the largest, all else by name."""
    if section == "values":
        return item.split("=", 1)[0], int(figures["rank"])
    lead = {"missing": "missing_pct", "headers": "count"}.get(section)
    return (-float(figures[lead] or 0) if lead else 0, item)


def _shown_number(value: str | None) -> str:
    """Whole numbers with thousands separators, others with four significant digits."""
    if value is None:
        return ""
    if value.lstrip("-").isdigit():
        return f"{int(value):,}"
    try:
        return f"{float(value):.4g}"
    except ValueError:
        return value

