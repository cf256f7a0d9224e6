"""Coercions of scraped values: prices, pack sizes, dates, digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogq.functions.text import NUMBER_PATTERN, WHITESPACE, blank_to_null, null_if_empty, round_half_away

NBSP = "\u00a0"
# Text shapes of pack sizes, German dates and scrape times.
UNIT_PATTERN = (
    r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*([A-Za-z]+)\s*"
    r"\(([^)]*?)\s*je\s*([0-9]+(?:[.,][0-9]+)?)\s*([A-Za-z]+)\s*\)\s*$"
)
GERMAN_DATE_PATTERN = r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})"
TIMESTAMP_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"
)


def bare_text(value: Column) -> Column:
    """Trimmed text with plain spaces."""
    return F.btrim(F.replace(value, F.lit(NBSP), F.lit(" ")), F.lit(WHITESPACE))


def clean_text(value: Column) -> Column:
    """Trimmed text with plain spaces, NULL when blank."""
    return null_if_empty(bare_text(value))


def to_double(text: Column) -> Column:
    """Strictly spelled number, else NULL (a bare cast would also take '1.5f')."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_long(text: Column) -> Column:
    """Whole number, or the whole part of a decimal one, else NULL."""
    return F.when(text.rlike("^[+-]?[0-9]+$") & text.try_cast("bigint").isNotNull(), text.try_cast("bigint")).when(
        text.rlike(NUMBER_PATTERN), text.try_cast("double").try_cast("bigint")
    )


def euro_amount(text: Column) -> Column:
    """Price from shop text: '1.299,00 €', 'EUR 12.50', 'ab 3.99'."""
    bare = F.regexp_replace(text, "€|EUR| ", "")
    german = F.translate(bare, ",.", ".")
    plain = F.regexp_replace(bare, r"[^0-9.\-]", "")
    return to_double(F.when(bare.contains(","), german).otherwise(plain))


def digits(text: Column) -> Column:
    """The digits of an article number, NULL when there are none."""
    return null_if_empty(F.regexp_replace(text, r"[^0-9]", ""))


def first_integer(text: Column) -> Column:
    """The first run of digits in a text."""
    return null_if_empty(F.regexp_extract(text, r"([0-9]+)", 1)).try_cast("bigint")


def german_date(text: Column) -> Column:
    """First dd.mm.yyyy in a text as an ISO date; NULL for none or an impossible date."""
    found = F.regexp_extract(text, GERMAN_DATE_PATTERN, 1)
    iso = F.concat_ws("-", F.substring(found, 7, 4), F.substring(found, 4, 2), F.substring(found, 1, 2))
    # There is no year 0.
    return F.when(~iso.startswith("0000"), iso.try_cast("date").cast("string"))


def scrape_time(text: Column) -> Column:
    """Instant of a well-formed RFC 3339 text, else NULL."""
    return F.when(text.rlike(TIMESTAMP_PATTERN), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def distinct_texts(texts: Column) -> Column:
    """Cleaned, non-blank, first occurrence of each, in order."""
    return F.array_remove(F.array_distinct(F.array_compact(F.transform(texts, bare_text))), "")


def join_clean(texts: Column, separator: str) -> Column:
    """Distinct texts that are cleaned already as one, NULL when none is left."""
    return null_if_empty(F.array_join(F.array_distinct(texts), separator))


def join_texts(texts: Column, separator: str) -> Column:
    """Distinct texts as one, NULL when none is left."""
    return null_if_empty(F.array_join(distinct_texts(texts), separator))


def unit_info(texts: Column) -> dict[str, Column]:
    """Pack size and unit price from the first price note such as '0,5 l (3,90 € je 1 l)'."""
    note = F.get(F.filter(texts, lambda t: t.rlike(UNIT_PATTERN)), F.lit(0))

    def part(group: int) -> Column:
        return F.regexp_extract(note, UNIT_PATTERN, group)

    def amount(group: int) -> Column:
        return to_double(F.translate(part(group), ",", "."))

    return {
        "unit_quantity": amount(1),
        "unit_quantity_unit": part(2),
        "unit_price_per_quantity": amount(4),
        "unit_price_per_unit": part(5),
        "unit_info_raw": join_texts(texts, " | "),
        "unit_price_eur": euro_amount(clean_text(part(3))),
    }


def rounded_difference(left: Column, right: Column) -> Column:
    return round_half_away(left - right, 4)


def equal_if_present(left: Column, right: Column) -> Column:
    """Equality of two values, NULL when either is missing or blank."""
    return blank_to_null(left.cast("string")) == blank_to_null(right.cast("string"))


def first_present(*values: Column) -> Column:
    """First text that is not blank, unchanged."""
    return F.coalesce(*[F.when(F.btrim(v, F.lit(WHITESPACE)) != "", v) for v in values])
