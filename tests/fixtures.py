"""Synthetic tables: a 41-column reference of 500 products and candidates made from it."""

from pyspark.sql import functions as F

from catalogq.operators import perturb
from catalogq.plans.compare import Table
from catalogq.plans.reference import EXPORT_COLUMNS

FLOATS = ("price_eur", "unit_quantity", "unit_price_eur", "unit_price_per_quantity", "rating_value")
FLAGS = ("product_is_pharmacy", "has_variants", "has_videos", "has_seals", "has_pills", "has_eyecatchers")


def _cell(name, i):
    """Text of column number i for the row `id`; only gtin and dan are unique."""
    row = F.col("id")
    spread = F.pmod(F.xxhash64(row, F.lit(name)), F.lit(97 + 2 * i))
    if name == "gtin":
        return F.format_string("40%011d", row * 7919 + 13)
    if name == "dan":
        return (row + 100000).cast("string")
    if name in FLOATS:
        return F.concat((spread + 1).cast("string"), F.lit("."), (spread % 9 + 1).cast("string"))
    if name in FLAGS:
        return F.when(spread % (i % 5 + 2) == 0, "True").otherwise("False")
    if name == "rating_count":
        return spread.cast("string")
    text = F.concat(F.lit(f"{name} "), spread.cast("string"), F.lit(" größe"))
    return F.when(spread % 11 == 0, "").otherwise(text)


def reference(spark, rows=500):
    df = spark.range(rows).select(*[_cell(c, i).alias(c) for i, c in enumerate(EXPORT_COLUMNS)], F.col("id").alias("_ord"))
    return Table(df, ["_ord"], EXPORT_COLUMNS, "reference")


def candidate(spark, rows=500, sample=0):
    made, _ = perturb.make_candidate(reference(spark, rows).df, EXPORT_COLUMNS, ["gtin"], sample_rows=sample)
    return Table(made, ["_ord"], path="candidate")


def changed(table, df):
    """The same kind of table over other rows."""
    return Table(df, table.order, path=table.path)
