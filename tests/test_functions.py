"""Cell functions against plain statements of their rules."""

import random
import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogq.functions import display, ingest, similarity, text

CELLS = [
    None, "", " ", " ", "   x ", "true", "Yes", " y", "FALSE", "n", "0", "1", "1.0", "01", "+1", "-0", "-0.00",
    ".5", "5.", "-.50", "007.0700", "1e5", "12345678901234567890123456789012345678901234.5000", "abc", "abd", "Größe",
    "Grosse", "😀x", "😀y", "1.5f", "--1", "1,5", "  12.5  ", "no", "100", "99.5", "x" * 200,
]


def trimmed(v):
    return (v or "").strip(text.WHITESPACE)


def bool_of(t):
    return {**dict.fromkeys(text.TRUE_WORDS, True), **dict.fromkeys(text.FALSE_WORDS, False)}.get(t.lower())


def number_of(t):
    return Fraction(t if t[-1] != "." else t + "0") if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", t) else None


def canonical(v):
    t = trimmed(v)
    if t == "":
        return ""
    if bool_of(t) is not None:
        return str(bool_of(t)).lower()
    n = number_of(t)
    if n is None:
        return t
    sign, body = ("-", t[1:]) if t[0] == "-" else ("", t.lstrip("+"))
    whole, _, part = body.partition(".")
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    return "0" if n == 0 else sign + whole + ("." + part if part else "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    a, b = trimmed(a), trimmed(b)
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if bool_of(a) is not None and bool_of(b) is not None:
        return float(bool_of(a) == bool_of(b))
    x, y = number_of(a), number_of(b)
    if x is not None and y is not None:
        if x == y:
            return 1.0
        return max(0.0, 1 - abs(float(x) - float(y)) / max(abs(float(x)), abs(float(y)), 1.0))
    return 1 - distance(a, b) / max(len(a), len(b))


def test_canonical_form(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "v string")
    got = df.select("v", text.canonical(F.col("v")).alias("c")).collect()
    assert {r["v"]: r["c"] for r in got} == {v: canonical(v) for v in CELLS}


def test_cell_similarity_of_all_pairs(spark):
    pairs = [(a, b) for a in CELLS for b in CELLS]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r["a"], r["b"]): r["s"] for r in similarity.with_cell_similarity(df, "a", "b", "s").collect()}
    assert got == {(a, b): pytest.approx(similar(a, b), abs=1e-12) for a, b in pairs}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="01+-. ayesnoÄ\t", max_size=8), min_size=1, max_size=60))
def test_canonical_form_of_random_cells(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["c"] for r in df.select(text.canonical(F.col("v")).alias("c")).collect()]
    assert got == [canonical(v) for v in values]


def test_match_keys_keep_values_apart(spark):
    long_one, long_two = "a" * 100, "a" * 99 + "b"
    df = spark.createDataFrame([(v,) for v in ("x", " x", long_one, long_two, "", None)], "v string")
    keys = [r["k"] for r in text.with_match_key(df, F.col("v"), "k").collect()]
    assert keys[0] == keys[1] and keys[4] is None and keys[5] is None
    assert len({keys[0], keys[2], keys[3]}) == 3 and len(keys[2]) < 100


@pytest.mark.parametrize(
    "left, right, expected",
    [
        ("rating_count", "reviews_count", 1.0),
        ("category_path", "category_tree", 1.0),
        ("gtin", "gtin_code", 1.0),
        ("", "code", 1.0),
        ("code", "gtin", 0.0),
        ("abc", "abd", 2 / 3),
        ("has_pills", "is_badges", 1.0),
        ("a_b_c_d", "d_c_b_a", 1.0),
    ],
)
def test_header_similarity(spark, left, right, expected):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    assert df.select(similarity.header_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize(
    "ratios, expected",
    [((0, 1, 0, 0.95), 1), ((0, 1, 1, 0), 0.1), ((0.95, 0, 0.9, 0), 1), ((1, 0, 0.5, 0), 0.2), ((0, 0, 0.5, 0), 0.8)],
)
def test_type_compatibility(spark, ratios, expected):
    df = spark.createDataFrame([tuple(map(float, ratios))], "a double, b double, c double, d double")
    got = df.select(similarity.type_compatibility(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert got == pytest.approx(expected)


def values(spark, function, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_euro_amounts(spark):
    inputs = ["1.299,00 €", "EUR 12.50", "12,5", "ab 3.99", "1.2.3", "-5.25", "", "auf Anfrage", "1,2,3", "€", "5-", None]
    assert values(spark, ingest.euro_amount, inputs) == [1299.0, 12.5, 12.5, 3.99, None, -5.25, None, None, None, None, None, None]


def test_numbers_and_digits(spark):
    assert values(spark, ingest.to_long, ["12", "-3", "+4", "12.9", "-12.9", "1e3", "1.5f", "x", None]) == [
        12, -3, 4, 12, -12, 1000, None, None, None]
    assert values(spark, ingest.to_double, ["1.5", "1e-2", "1.5f", "NaN", ".5"]) == [1.5, 0.01, None, None, 0.5]
    assert values(spark, ingest.digits, ["4-01 2", "none", None]) == ["4012", None, None]
    assert values(spark, ingest.first_integer, ["bis 120 Punkte 3", "x", None]) == [120, None, None]
    assert values(spark, ingest.german_date, ["seit 01.02.2024, 03.04.2025", "31.02.2024", "x"]) == ["2024-02-01", None, None]


def test_scrape_times(spark):
    got = values(spark, lambda c: ingest.scrape_time(c).cast("string"), [
        "2024-01-01T10:00:00Z", "2024-01-01T10:00:00.123456789+02:00", "2024-01-01", "2024-01-01T25:00:00Z", None])
    assert got == ["2024-01-01 10:00:00", "2024-01-01 08:00:00.123456", None, None, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(
    st.integers(0, 2000).map(lambda n: n / 200), st.floats(0, 1e6), st.integers(0, 10**6).map(lambda n: n / 1000 + 0.005),
), min_size=1, max_size=50))
def test_fixed_point_equals_printf(spark, numbers):
    df = spark.createDataFrame([(i, float(n)) for i, n in enumerate(numbers)], "i int, v double")
    got = df.select("i", display.fixed_point(F.col("v"), 2).alias("x"), display.fixed_point(F.col("v"), 1).alias("y"))
    rows = got.orderBy("i").collect()
    assert [r["x"] for r in rows] == [f"{n:.2f}" for n in numbers]
    assert [r["y"] for r in rows] == [f"{n:.1f}" for n in numbers]


def test_float_text(spark):
    df = spark.createDataFrame([(1.0,), (0.1,), (12345678.5,), (1e7,), (0.0005,), (-2.5,), (None,)], "v double")
    got = [r[0] for r in df.select(display.float_text(F.col("v"))).collect()]
    assert got == ["1.0", "0.1", "12345678.5", "10000000.0", "0.0005", "-2.5", None]


def test_labels():
    assert display.field_label("desc_material") == "Description Material"
    assert display.field_label("unit_price_eur") == "Unit Price Eur"


def test_plain_digits_of_every_size(spark):
    values = [1.2345678901234e-4, 3e-14, 1e26, 1.5e300, 5e-324, -2.5e-7, 123456789012345.67, 1e22, 0.0, -0.0, 9.999e6, 1e7]
    values += [float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", display.plain_digits(F.col("v")).alias("t"))
    for r in rows.collect():
        if r["t"] in ("NaN", "inf", "-inf"):
            assert str(r["v"]) == r["t"].lower()
        else:
            assert float(r["t"]) == r["v"] and re.fullmatch(r"-?(0|[1-9]\d*)\.(0|\d*[1-9])", r["t"])


def test_fixed_point_is_exact_and_never_fails(spark):
    draw = random.Random(6)
    values = [0.005, 0.015, 2.675, 3.905, 0.125, 0.375, 0.995, 0.999, 9.995, 1e15 + 0.125, 2.0**52 + 0.5, 2.0**53 + 2, 9e18, -0.001]
    values += [draw.uniform(-1, 1) * 10 ** draw.randrange(-5, 18) for _ in range(300)]
    for digits in (1, 2):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", display.fixed_point(F.col("v"), digits).alias("t"))
        assert [r["t"] for r in rows.collect()] == [f"{v:.{digits}f}" for v in values]
    odd = spark.createDataFrame([(1e25,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in odd.select(display.fixed_point(F.col("v"), 2)).collect()] == ["1" + "0" * 25 + ".00", "NaN", "inf", None]
