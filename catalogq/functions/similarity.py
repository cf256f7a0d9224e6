"""Similarity of two cells and of two column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.text import bool_word, decimal_text, is_decimal, trimmed

# What a column-name token stands for; an empty meaning drops the token.
HEADER_ALIASES = {
    "crumb": "breadcrumb",
    "crumbs": "breadcrumbs",
    "tree": "path",
    "details": "desc",
    "highlights": "eyecatchers",
    "badges": "pills",
    "reviews": "rating",
    "score": "value",
    "qty": "quantity",
    "pack": "unit",
    "subline": "subheadline",
    "amt": "",
    "code": "",
    "is": "has",
    "product": "",
}


# Cells up to this many code points are compared as they are.
SHORT_CELL = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times inside one expression, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_start(left: Column, right: Column) -> Column:
    """How many code points two texts begin with alike.

    The length is built from powers of two, the largest first: the next piece counts if it is
    the same in both. So the pieces compared are together about as long as the texts.
    """
    shorter = F.least(F.length(left), F.length(right))
    powers = F.when(shorter > 0, F.sequence(F.floor(F.log2(shorter + F.lit(0.5))).cast("int"), F.lit(0), F.lit(-1)))

    def longer(known: Column, power: Column) -> Column:
        step = F.pow(F.lit(2), power).cast("int")
        same = F.substring(left, known + 1, step) == F.substring(right, known + 1, step)
        return known + F.when((known + step <= shorter) & same, step).otherwise(0)

    return F.aggregate(F.coalesce(powers, F.array().cast("array<int>")), F.lit(0), longer)


def _cut_start(pair: Column) -> Column:
    """Both texts of a struct (l, r) without their common beginning."""
    rest = lambda x, n: F.substring(x, n + 1, F.greatest(F.length(x) - n, F.lit(0)))
    return _let(common_start(pair["l"], pair["r"]), lambda n: F.struct(rest(pair["l"], n).alias("l"), rest(pair["r"], n).alias("r")))


def _turned(pair: Column) -> Column:
    return F.struct(F.reverse(pair["l"]).alias("l"), F.reverse(pair["r"]).alias("r"))


def _middle_distance(pair: Column) -> Column:
    """Edit distance of texts that differ at both ends; where one is empty, the lengths give it."""
    left, right = pair["l"], pair["r"]
    empty = (left == "") | (right == "")
    return F.when(empty, F.greatest(F.length(left), F.length(right))).otherwise(F.levenshtein(left, right))


def edit_distance(left: Column, right: Column) -> Column:
    """Edit distance in code points.

    Of long texts the common beginning and end are cut off first, which leaves the distance as it
    is; the time grows with the product of what is left, so with the stretch that was changed.
    """
    pair = F.struct(left.alias("l"), right.alias("r"))
    ends_cut = lambda p: _let(_cut_start(p), lambda q: _let(_cut_start(_turned(q)), _middle_distance))
    short = F.least(F.length(left), F.length(right)) <= SHORT_CELL
    return F.when(short, F.levenshtein(left, right)).otherwise(_let(pair, ends_cut))


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, in code points."""
    longest = F.greatest(F.length(left), F.length(right))
    return (
        F.when(left == right, F.lit(1.0))
        .when((left == "") | (right == ""), F.lit(0.0))
        .otherwise(1 - edit_distance(left, right) / longest)
    )


def with_cell_similarity(df: DataFrame, left: str, right: str, result: str) -> DataFrame:
    """Add the similarity of two text columns.

    The steps are separate projections: as one expression the normalisers would be
    inlined dozens of times and the generated code would not compile. Cells that are
    already identical skip them all.
    """
    differs = ~F.col(left).eqNullSafe(F.col(right))
    lt, rt, lb, rb, ln, rn = (F.col(f"_sim_{n}") for n in ("lt", "rt", "lb", "rb", "ln", "rn"))
    lf, rf = ln.cast("double"), rn.cast("double")
    numeric = F.when(ln == rn, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - F.abs(lf - rf) / F.greatest(F.abs(lf), F.abs(rf), F.lit(1.0)))
    )
    return (
        df.withColumns(
            {
                "_sim_lt": F.when(differs, trimmed(F.col(left))),
                "_sim_rt": F.when(differs, trimmed(F.col(right))),
            }
        )
        .withColumns(
            {
                "_sim_lb": bool_word(lt),
                "_sim_rb": bool_word(rt),
                "_sim_ln": F.when(is_decimal(lt), decimal_text(lt)),
                "_sim_rn": F.when(is_decimal(rt), decimal_text(rt)),
            }
        )
        .withColumn(
            result,
            F.when(~differs, F.lit(1.0))
            .when(lt == rt, F.lit(1.0))
            .when((lt == "") | (rt == ""), F.lit(0.0))
            .when(lb.isNotNull() & rb.isNotNull(), (lb == rb).cast("double"))
            .when(ln.isNotNull() & rn.isNotNull(), numeric)
            .otherwise(edit_similarity(lt, rt)),
        )
        .drop("_sim_lt", "_sim_rt", "_sim_lb", "_sim_rb", "_sim_ln", "_sim_rn")
    )


def header_tokens(name: Column) -> Column:
    """The meaningful tokens of a column name."""
    meaning = F.create_map(*[F.lit(x) for pair in HEADER_ALIASES.items() for x in pair])
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(
        F.transform(words, lambda w: F.coalesce(F.try_element_at(meaning, w), w)), lambda w: w != ""
    )


def token_similarity(left: Column, right: Column) -> Column:
    """The better of spelling similarity and overlap of two token lists."""
    spelled = edit_similarity(F.array_join(left, ""), F.array_join(right, ""))
    union = F.size(F.array_union(left, right))
    overlap = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)
    return F.greatest(spelled, overlap)


def header_similarity(left: Column, right: Column) -> Column:
    """Similarity of two column names."""
    return token_similarity(header_tokens(left), header_tokens(right))


def type_compatibility(
    left_numeric: Column, left_bool: Column, right_numeric: Column, right_bool: Column
) -> Column:
    """How well two columns agree in kind, from the shares of number and boolean cells."""
    lb, rb, ln, rn = left_bool >= 0.9, right_bool >= 0.9, left_numeric >= 0.9, right_numeric >= 0.9
    return (
        F.when(lb & rb, F.lit(1.0))
        .when(lb != rb, F.lit(0.1))
        .when(ln & rn, F.lit(1.0))
        .when(ln != rn, F.lit(0.2))
        .otherwise(F.lit(0.8))
    )
