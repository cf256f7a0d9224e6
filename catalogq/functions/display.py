"""Text forms of values for feeds, payloads and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogq.functions.text import WHITESPACE


def first_text(*values: Column) -> Column:
    """First value whose text is not blank; '' when there is none."""
    texts = [v.cast("string") for v in values]
    return F.coalesce(*[F.when(F.btrim(t, F.lit(WHITESPACE)) != "", t) for t in texts], F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times inside one expression, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_digits(value: Column) -> Column:
    """The digits of a double without exponent, always with a decimal point; 'NaN', 'inf', '-inf'.

    They are the ones that Spark's own text of the number has, so they name the same double.
    """
    number = value.cast("double")

    def moved(t: Column) -> Column:
        """Digits and where the point stands among them, without sign and exponent."""
        mantissa = F.regexp_replace(F.substring_index(t, "E", 1), "^-", "")
        exponent = F.when(F.contains(t, F.lit("E")), F.substring_index(t, "E", -1).try_cast("int")).otherwise(0)
        return F.struct(
            F.startswith(t, F.lit("-")).alias("minus"),
            F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"),
            (F.length(F.substring_index(mantissa, ".", 1)) + exponent).alias("point"),
        )

    def spelled(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        shown = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        )
        short = F.regexp_replace(F.regexp_replace(shown, r"(\.\d+?)0+$", "$1"), r"^0+(?=\d)", "")
        return F.concat(F.when(x["minus"], "-").otherwise(""), short)

    return (
        F.when(number.between(0.001, 9999999), number.cast("string"))
        .when(F.isnan(number), "NaN")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .otherwise(_let(number.cast("string"), lambda t: _let(moved(t), spelled)))
    )


def fixed_point(value: Column, digits: int) -> Column:
    """The number with so many decimals, rounded by its exact binary value.

    format_string rounds the shortest decimal spelling instead, so it would show 3.905,
    which lies just below the tie, as 3.91. The whole part is split off, which is exact,
    and the comparison with the tie is: the rest is split into two halves whose products
    with the small scale are exact. From 2^63 on plain_digits() is shown.
    """
    number, scale = value.cast("double"), 10**digits
    size = F.abs(number)

    def halves(x: Column) -> Column:
        part = x - F.floor(x).cast("double")
        return F.struct(F.floor(x).alias("whole"), part.alias("part"), (part * 134217729.0).alias("spread"))

    def placed(x: Column) -> Column:
        high = x["spread"] - (x["spread"] - x["part"])
        return F.struct(
            x["whole"].alias("whole"),
            F.floor(x["part"] * scale).alias("below"),
            high.alias("high"),
            (x["part"] - high).alias("low"),
        )

    def rounded(x: Column) -> Column:
        tie = (x["high"] * (2 * scale) - (2 * x["below"] + 1)) + x["low"] * (2 * scale)
        # The scale is even, so the last digit shown is even if `below` is.
        up = (tie > 0) | ((tie == 0) & (x["below"] % 2 == 1))
        return F.struct(x["whole"].alias("whole"), (x["below"] + F.when(up, 1).otherwise(0)).alias("units"))

    def spelled(x: Column) -> Column:
        carry = F.when(x["units"] >= scale, 1).otherwise(0)
        return F.format_string(f"%d.%0{digits}d", x["whole"] + carry, x["units"] - carry * scale)

    exact = _let(size, lambda x: _let(halves(x), lambda y: _let(placed(y), lambda z: _let(rounded(z), spelled))))
    large = F.concat(F.substring_index(plain_digits(size), ".", 1), F.lit("." + "0" * digits))
    sign = F.when(number < 0, "-").otherwise("")
    return (
        F.when(size < float(2**63), F.concat(sign, exact))
        .when(size < float("inf"), F.concat(sign, large))
        .when(number.isNotNull(), plain_digits(number))
    )


def price_text(price: Column, currency: Column) -> Column:
    return F.when(
        price.isNotNull(),
        F.concat(
            fixed_point(price, 2),
            F.lit(" "),
            F.when(F.btrim(currency, F.lit(WHITESPACE)) != "", currency).otherwise(F.lit("EUR")),
        ),
    ).otherwise(F.lit("Price unavailable"))


def rating_summary(value: Column, count: Column) -> Column:
    """'★ 4.5 (12)', '★ 4.5', '12 reviews' or 'New'."""
    rated, counted = F.coalesce(value > 0, F.lit(False)), F.coalesce(count > 0, F.lit(False))
    stars = F.concat(F.lit("★ "), fixed_point(value, 1))
    return (
        F.when(rated & counted, F.concat(stars, F.format_string(" (%d)", count.cast("bigint"))))
        .when(rated, stars)
        .when(counted, F.format_string("%d reviews", count.cast("bigint")))
        .otherwise(F.lit("New"))
    )


def rating_stars(value: Column) -> Column:
    """Five stars filled up to the rounded rating and the rating itself; NULL when unrated."""
    shown = F.least(value.cast("double"), F.lit(5.0))
    full = F.floor(shown + 0.5).cast("int")
    return F.when(
        value > 0,
        F.concat(
            F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), F.lit(5) - full), F.lit(" "), fixed_point(shown, 1)
        ),
    )


def rating_note(value: Column, count: Column) -> Column:
    """The line below the stars; NULL when there is neither rating nor count."""
    return F.when(count > 0, F.format_string("%d ratings", count.cast("bigint"))).when(
        value > 0, F.lit("Customer reviews available")
    )


def field_label(name: str) -> str:
    """Human label of a column name (metadata, so plain Python)."""
    if name.startswith("desc_"):
        name = "description_" + name[len("desc_"):]
    return " ".join(word[:1].upper() + word[1:] for word in name.replace("_", " ").split())


def product_path(identifier: Column) -> Column:
    return F.concat(F.lit("/product/"), identifier)


def float_text(value: Column) -> Column:
    """Plain digits that always show a decimal point, for every double; NULL for NaN, 'inf' and '-inf'."""
    return F.when(~F.isnan(value), plain_digits(value))
