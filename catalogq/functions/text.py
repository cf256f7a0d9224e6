"""Cell normalisation: the per-cell steps of every comparison job, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Words read as booleans, in any case.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
# Number shapes. Plain decimals in comparison, exponents also at ingest.
DECIMAL_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
NUMBER_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# Values up to this many bytes are shuffled as they are, longer ones as a digest.
LONGEST_PLAIN_KEY = 64


def trimmed(value: Column) -> Column:
    """The cell without surrounding Unicode white space; NULL counts as empty."""
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(WHITESPACE))


def is_empty(value: Column) -> Column:
    return trimmed(value) == ""


def null_if_empty(text: Column) -> Column:
    """NULL for ''. Names its argument once: nullif repeats it, which multiplies inside lambdas."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def blank_to_null(value: Column) -> Column:
    """Trimmed text, or NULL where nothing is left."""
    return null_if_empty(F.btrim(value, F.lit(WHITESPACE)))


def bool_word(text: Column) -> Column:
    """Boolean for the eight known words of an already trimmed text, else NULL."""
    lowered = F.lower(text)
    return F.when(lowered.isin(*TRUE_WORDS), F.lit(True)).when(
        lowered.isin(*FALSE_WORDS), F.lit(False)
    )


def is_decimal(text: Column) -> Column:
    return text.rlike(DECIMAL_PATTERN)


def decimal_text(text: Column) -> Column:
    """One spelling per decimal value: no plus sign, no padding zeros, no negative zero.

    Works on the digits, so it is exact for any length.
    """
    whole = F.ltrim(F.substring_index(text, ".", 1), F.lit("+-0"))
    part = F.when(text.contains("."), F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))).otherwise(F.lit(""))
    return F.concat(
        F.when(text.startswith("-") & ((whole != "") | (part != "")), F.lit("-")).otherwise(F.lit("")),
        F.when(whole == "", F.lit("0")).otherwise(whole),
        F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)),
    )


def canonical_text(text: Column) -> Column:
    """The canonical form of an already trimmed text."""
    words = [F.lit(x) for word in TRUE_WORDS for x in (word, "true")]
    words += [F.lit(x) for word in FALSE_WORDS for x in (word, "false")]
    return F.coalesce(
        F.try_element_at(F.create_map(*words), F.lower(text)),
        F.when(is_decimal(text), decimal_text(text)).otherwise(text),
    )


def canonical(value: Column) -> Column:
    """The form under which two cells count as the same value; '' for an empty cell."""
    return canonical_text(trimmed(value))


def _bounded(form: Column) -> Column:
    """A canonical form as a shuffle key; never NULL, as the planner can see."""
    digest = F.concat(F.lit("sha256:"), F.sha2(form, 256))
    return F.coalesce(F.when(F.octet_length(form) > LONGEST_PLAIN_KEY, digest).otherwise(form), F.lit(""))


def with_match_key(df: DataFrame, value: Column, name: str, filled: bool = False) -> DataFrame:
    """Add the canonical value as a shuffle key of bounded width; NULL for an empty cell.

    Long texts travel as a SHA-256 digest. A digest key is longer than any plain
    key, so the two cannot be confused. The steps are separate projections, so that
    none is evaluated twice. With `filled`, rows with an empty cell are dropped before
    the steps and the key is known not to be NULL. A later test for NULL, or the one that
    a join adds, would carry all the steps down into a filter.
    """
    form = F.col("_form")
    rows = df.where(trimmed(value) != "") if filled else df
    return (
        rows.withColumn("_trimmed", trimmed(value))
        .withColumn("_form", canonical_text(F.col("_trimmed")))
        .withColumn(name, _bounded(form) if filled else null_if_empty(_bounded(form)))
        .drop("_trimmed", "_form")
    )


def match_keys(values: Column) -> Column:
    """The match keys of an array of cells, for few rows: its steps are not compiled."""
    return F.transform(F.transform(values, lambda v: canonical(v)), lambda f: null_if_empty(_bounded(f)))


def round_half_away(value: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back."""
    scale = F.lit(10.0**digits)
    scaled = value * scale
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))
