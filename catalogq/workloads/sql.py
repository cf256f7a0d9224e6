"""SQL texts for the oracles, and expressions that both engines read alike."""

from __future__ import annotations

from catalogq.functions.similarity import HEADER_ALIASES
from catalogq.functions.text import FALSE_WORDS, TRUE_WORDS, WHITESPACE

DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)"


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def trim(expr: str) -> str:
    return f"trim(coalesce(CAST({expr} AS VARCHAR), ''), '{WHITESPACE}')"


def bool_word(text: str) -> str:
    return (
        f"CASE WHEN lower({text}) IN ({words(TRUE_WORDS)}) THEN true "
        f"WHEN lower({text}) IN ({words(FALSE_WORDS)}) THEN false END"
    )


def is_decimal(text: str) -> str:
    return f"regexp_full_match({text}, '{DECIMAL}')"


def decimal_text(text: str) -> str:
    whole = f"ltrim(regexp_extract({text}, '^[+-]?([0-9]*)', 1), '0')"
    part = f"rtrim(regexp_extract({text}, '\\.([0-9]*)$', 1), '0')"
    return (
        f"CASE WHEN {whole} = '' AND {part} = '' THEN '0' ELSE "
        f"CASE WHEN {text} LIKE '-%' THEN '-' ELSE '' END || "
        f"CASE WHEN {whole} = '' THEN '0' ELSE {whole} END || "
        f"CASE WHEN {part} = '' THEN '' ELSE '.' || {part} END END"
    )


def canonical(expr: str) -> str:
    t = trim(expr)
    return (
        f"CASE WHEN {t} = '' THEN '' WHEN lower({t}) IN ({words(TRUE_WORDS)}) THEN 'true' "
        f"WHEN lower({t}) IN ({words(FALSE_WORDS)}) THEN 'false' "
        f"WHEN {is_decimal(t)} THEN {decimal_text(t)} ELSE {t} END"
    )


def edit_similarity(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 "
        f"ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"
    )


def cell_similarity(a: str, b: str) -> str:
    x, y = trim(a), trim(b)
    fx, fy = f"TRY_CAST({x} AS DOUBLE)", f"TRY_CAST({y} AS DOUBLE)"
    numeric = (
        f"CASE WHEN ({decimal_text(x)}) = ({decimal_text(y)}) THEN 1.0 ELSE "
        f"greatest(0.0, 1 - abs({fx} - {fy}) / greatest(abs({fx}), abs({fy}), 1.0)) END"
    )
    return (
        f"CAST(CASE WHEN {x} = {y} THEN 1.0 WHEN {x} = '' OR {y} = '' THEN 0.0 "
        f"WHEN ({bool_word(x)}) IS NOT NULL AND ({bool_word(y)}) IS NOT NULL "
        f"THEN CASE WHEN ({bool_word(x)}) = ({bool_word(y)}) THEN 1.0 ELSE 0.0 END "
        f"WHEN {is_decimal(x)} AND {is_decimal(y)} THEN {numeric} "
        f"ELSE {edit_similarity(x, y)} END AS DOUBLE)"
    )


def header_tokens(name: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADER_ALIASES.items())
    return (
        f"list_filter(list_transform(regexp_extract_all(lower({name}), '[a-z0-9]+'), "
        f"lambda w: CASE w {cases} ELSE w END), lambda w: w <> '')"
    )


def header_similarity(a: str, b: str) -> str:
    x, y = header_tokens(a), header_tokens(b)
    joined_x, joined_y = f"array_to_string({x}, '')", f"array_to_string({y}, '')"
    union = f"len(list_distinct(list_concat({x}, {y})))"
    overlap = f"CASE WHEN {union} = 0 THEN 1.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / {union} END"
    return f"CAST(greatest({edit_similarity(joined_x, joined_y)}, {overlap}) AS DOUBLE)"


def type_compatibility(rn: str, rb: str, cn: str, cb: str) -> str:
    return (
        f"CAST(CASE WHEN {rb} >= 0.9 AND {cb} >= 0.9 THEN 1 WHEN ({rb} >= 0.9) <> ({cb} >= 0.9) THEN 0.1 "
        f"WHEN {rn} >= 0.9 AND {cn} >= 0.9 THEN 1 WHEN ({rn} >= 0.9) <> ({cn} >= 0.9) THEN 0.2 "
        f"ELSE 0.8 END AS DOUBLE)"
    )


def profile_counts(source: str, columns) -> str:
    """SELECT giving position, column and the count figures of each column of `source`."""
    selects = []
    for i, c in enumerate(columns):
        k = f"nullif({canonical(c)}, '')"
        selects.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS row_count, count({k}) AS non_empty_count, "
            f"count(*) - count({k}) AS null_count, count(DISTINCT {k}) AS unique_non_empty_count, "
            f"count({k}) > 0 AND count({k}) = count(DISTINCT {k}) AS is_unique, "
            f"CASE WHEN count({k}) = 0 THEN 0.0 ELSE CAST(count(DISTINCT {k}) AS DOUBLE) / count({k}) END "
            f"AS uniqueness_ratio FROM {source}"
        )
    return " UNION ALL ".join(selects)


def profile_sample(source: str, columns, order: str) -> str:
    """SELECT giving position, column, number and boolean shares and byte lengths."""
    selects = []
    for i, c in enumerate(columns):
        selects.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", "
            f"coalesce(avg(CASE WHEN {is_decimal('t')} THEN 1.0 ELSE 0.0 END), 0.0) AS numeric_ratio, "
            f"coalesce(avg(CASE WHEN ({bool_word('t')}) IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) AS bool_ratio, "
            f"coalesce(avg(CAST(strlen(t) AS DOUBLE)), 0.0) AS avg_len_sample, "
            f"CAST(coalesce(max(strlen(t)), 0) AS DOUBLE) AS max_len_sample "
            f"FROM (SELECT {trim(c)} AS t FROM {source} WHERE {trim(c)} <> '' ORDER BY {order} LIMIT 500)"
        )
    return " UNION ALL ".join(selects)


# --- views over the driver tables: the same text serves Spark and the oracle -----------------

# Cells in many spellings, made from every line item.
ODD_CELL = """CASE CAST(l_partkey % 10 AS INT)
 WHEN 0 THEN concat('  ', CAST(CAST(l_quantity AS INT) AS STRING), ' ')
 WHEN 1 THEN concat('+00', CAST(CAST(l_quantity AS INT) AS STRING), '.500')
 WHEN 2 THEN concat('-0.0', CAST(l_linenumber AS STRING))
 WHEN 3 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE ' fAlse' END
 WHEN 4 THEN concat('.', CAST(CAST(l_quantity AS INT) AS STRING), '00')
 WHEN 5 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.')
 WHEN 6 THEN concat(l_returnflag, ' ', CAST(CAST(l_quantity AS INT) AS STRING))
 WHEN 7 THEN CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE '   ' END
 WHEN 8 THEN concat('-', CAST(l_orderkey AS STRING), '.', CAST(l_suppkey AS STRING), '0')
 ELSE '-000.000' END"""

# Products made from parts and the line items that sold them.
LINEITEM_FIGURES = """SELECT l_partkey, count(*) AS rating_count, avg(l_quantity) / 10 AS rating_value
 FROM lineitem GROUP BY l_partkey"""
PRODUCTS = f"""SELECT lpad(CAST(p_partkey AS STRING), 13, '0') AS gtin, p_partkey AS dan, p_name AS name,
 CASE WHEN p_size % 17 = 0 THEN ' ' ELSE p_brand END AS brand,
 p_retailprice / 200 AS price_eur, 'EUR' AS currency,
 CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_type END AS category_path,
 CASE WHEN p_size % 19 = 0 THEN NULL ELSE rating_value END AS rating_value, rating_count,
 p_size % 10 = 0 AS product_is_pharmacy, p_size % 7 = 0 AS has_eyecatchers, p_size % 11 = 0 AS has_pills
 FROM part LEFT JOIN ({LINEITEM_FIGURES}) figures ON p_partkey = l_partkey"""

# The same products as an extractor might return them.
CANDIDATE = f"""SELECT gtin AS gtin_code, dan AS dan_code,
 CASE WHEN dan % 5 = 0 THEN concat(name, 'x') WHEN dan % 7 = 0 THEN upper(name) ELSE name END AS product_name,
 CASE WHEN dan % 11 = 0 THEN '' ELSE brand END AS brand_name,
 CASE WHEN dan % 3 = 0 THEN price_eur + 0.5 ELSE price_eur END AS price_eur_amt, currency AS currency_code,
 category_path AS category_tree, rating_value AS rating_score, rating_count AS reviews_count,
 CASE WHEN product_is_pharmacy THEN 'yes' ELSE 'no' END AS is_pharmacy_product
 FROM ({PRODUCTS}) products"""
REFERENCE_COLUMNS = (
    "gtin", "dan", "name", "brand", "price_eur", "currency", "category_path", "rating_value", "rating_count",
    "product_is_pharmacy",
)
CANDIDATE_COLUMNS = (
    "gtin_code", "dan_code", "product_name", "brand_name", "price_eur_amt", "currency_code", "category_tree",
    "rating_score", "reviews_count", "is_pharmacy_product",
)
