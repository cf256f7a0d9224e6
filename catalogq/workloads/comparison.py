"""Queries of the comparison side: normalise, profile, find keys, align, map, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.functions import similarity, text
from catalogq.operators import align, keymatch, keytable, mapping, perturb, profile, scoring
from catalogq.plans import compare as comparison
from catalogq.session import materialize, new_folder
from catalogq.sources import sinks, tables
from catalogq.workloads import sql
from catalogq.workloads.registry import query, table
from catalogq.workloads.views import candidate, odd_cells, products

CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
SUPPLIER = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("col_profile_counts", sql.profile_counts("customer", CUSTOMER))
def col_profile_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_counts(table(spark, d, "customer"), CUSTOMER)


@query("col_profile_counts_text", sql.profile_counts("documents", DOCUMENTS))
def col_profile_counts_text(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_counts(table(spark, d, "documents"), DOCUMENTS)


@query(
    "unique_columns",
    f'SELECT position, "column" FROM ({sql.profile_counts("customer", CUSTOMER)}) WHERE is_unique',
)
def unique_columns(spark: SparkSession, d: str) -> DataFrame:
    return keytable.find_unique(table(spark, d, "customer"), CUSTOMER)


def _rounded_sample(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("numeric_ratio", "bool_ratio", "avg_len_sample")})


def _rounded_sample_sql(inner: str) -> str:
    return (
        'SELECT position, "column", round(numeric_ratio, 6) AS numeric_ratio, round(bool_ratio, 6) AS bool_ratio, '
        f"round(avg_len_sample, 6) AS avg_len_sample, max_len_sample FROM ({inner})"
    )


@query("col_profile_sample", _rounded_sample_sql(sql.profile_sample("documents", DOCUMENTS, "doc_id")))
def col_profile_sample(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_sample(profile.profile_sample(table(spark, d, "documents"), DOCUMENTS, ["doc_id"]))


@query(
    "canonical_scalar",
    f"SELECT {LINE_KEY}, {sql.canonical('cell')} AS canonical FROM (SELECT *, {sql.ODD_CELL} AS cell FROM lineitem)",
)
def canonical_scalar(spark: SparkSession, d: str) -> DataFrame:
    return odd_cells(spark, d).withColumn("canonical", text.canonical(F.col("cell"))).drop("cell")


@query(
    "parse_bool_decimal",
    f"SELECT {LINE_KEY}, {sql.bool_word('t')} AS truth, {sql.is_decimal('t')} AS numeric, "
    f"CASE WHEN {sql.is_decimal('t')} THEN {sql.decimal_text('t')} END AS digits, t = '' AS is_empty "
    f"FROM (SELECT *, {sql.trim(sql.ODD_CELL)} AS t FROM lineitem)",
)
def parse_bool_decimal(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    trimmed = odd_cells(spark, d).withColumn("t", text.trimmed(F.col("cell")))
    return trimmed.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        text.bool_word(t).alias("truth"),
        text.is_decimal(t).alias("numeric"),
        F.when(text.is_decimal(t), text.decimal_text(t)).alias("digits"),
        (t == "").alias("is_empty"),
    )


PAIRED = f"({sql.PRODUCTS}) r JOIN ({sql.CANDIDATE}) c ON r.gtin = c.gtin_code"


@query(
    "cell_similarity",
    f"SELECT gtin, round({sql.cell_similarity('name', 'product_name')}, 6) AS name_similarity, "
    f"round({sql.cell_similarity('price_eur', 'price_eur_amt')}, 6) AS price_similarity, "
    f"round({sql.cell_similarity('brand', 'brand_name')}, 6) AS brand_similarity, "
    f"round({sql.cell_similarity('product_is_pharmacy', 'is_pharmacy_product')}, 6) AS flag_similarity, "
    f"round({sql.cell_similarity('name', 'price_eur_amt')}, 6) AS mixed_similarity FROM {PAIRED}",
)
def cell_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = {
        "name_similarity": ("name", "product_name"),
        "price_similarity": ("price_eur", "price_eur_amt"),
        "brand_similarity": ("brand", "brand_name"),
        "flag_similarity": ("product_is_pharmacy", "is_pharmacy_product"),
        "mixed_similarity": ("name", "price_eur_amt"),
    }
    ref, cand = products(spark, d), candidate(spark, d)
    used = sorted({c for pair in pairs.values() for c in pair})
    rows = ref.join(cand, ref.gtin == cand.gtin_code).select(
        "gtin", *[F.col(c).cast("string").alias(c) for c in used]
    )
    for name, (a, b) in pairs.items():
        rows = similarity.with_cell_similarity(rows, a, b, name)
    return rows.select("gtin", *[F.round(name, 6).alias(name) for name in pairs])


@query(
    "levenshtein_norm",
    f"SELECT p_partkey, levenshtein(p_name, p_type) AS distance, "
    f"round(CAST({sql.edit_similarity('p_name', 'lower(p_type)')} AS DOUBLE), 6) AS similarity FROM part",
)
def levenshtein_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey",
        F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"),
        F.round(similarity.edit_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("similarity"),
    )


HEADER_A = "concat('product_', p_name, CASE WHEN p_size % 3 = 0 THEN ' qty' ELSE ' Score_' END)"
HEADER_B = "concat(p_name, '-quantity ', CASE WHEN p_size % 2 = 0 THEN 'amt' ELSE p_brand END)"


@query(
    "header_similarity",
    f"SELECT p_partkey, array_to_string({sql.header_tokens('a')}, ' ') AS tokens, "
    f"round({sql.header_similarity('a', 'b')}, 6) AS similarity "
    f"FROM (SELECT p_partkey, {HEADER_A} AS a, {HEADER_B} AS b FROM part)",
)
def header_similarity(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", F.expr(HEADER_A).alias("a"), F.expr(HEADER_B).alias("b"))
    return named.select(
        "p_partkey",
        F.array_join(similarity.header_tokens(F.col("a")), " ").alias("tokens"),
        F.round(similarity.header_similarity(F.col("a"), F.col("b")), 6).alias("similarity"),
    )


@query(
    "type_compat",
    f"SELECT r.\"column\" AS reference_column, c.\"column\" AS candidate_column, "
    f"{sql.type_compatibility('r.numeric_ratio', 'r.bool_ratio', 'c.numeric_ratio', 'c.bool_ratio')} AS compatibility "
    f"FROM ({sql.profile_sample('supplier', SUPPLIER, 's_suppkey')}) r, "
    f"({sql.profile_sample('customer', CUSTOMER, 'c_custkey')}) c",
)
def type_compat(spark: SparkSession, d: str) -> DataFrame:
    left = profile.profile_sample(table(spark, d, "supplier"), SUPPLIER, ["s_suppkey"])
    right = profile.profile_sample(table(spark, d, "customer"), CUSTOMER, ["c_custkey"])
    # The column names are known, so the pairs are listed and then joined by name.
    names = F.explode(F.array(*[F.lit(c) for c in CUSTOMER])).alias("candidate_column")
    kinds = right.select(F.struct("numeric_ratio", "bool_ratio").alias("c"), F.col("column").alias("candidate_column"))
    pairs = left.select(F.col("column").alias("reference_column"), "numeric_ratio", "bool_ratio", names).join(
        kinds, "candidate_column"
    )
    return pairs.select(
        "reference_column",
        "candidate_column",
        similarity.type_compatibility(
            F.col("numeric_ratio"), F.col("bool_ratio"), F.col("c.numeric_ratio"), F.col("c.bool_ratio")
        ).alias("compatibility"),
    )


# Customers as another source might list them: renamed, one in seven unknown.
OTHER_CUSTOMER = (
    "SELECT CASE WHEN c_custkey % 7 = 0 THEN -1 - c_custkey ELSE c_custkey END AS cust_code, "
    "CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, ' ') ELSE c_name END AS product_name, "
    "c_nationkey AS nation_code, c_mktsegment AS segment FROM customer"
)
OTHER = ("cust_code", "product_name", "nation_code", "segment")


def _other_customer(spark: SparkSession, d: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    return table(spark, d, "customer").select(
        F.when(key % 7 == 0, -1 - key).otherwise(key).alias("cust_code"),
        F.when(key % 4 == 0, F.concat(name, F.lit(" "))).otherwise(name).alias("product_name"),
        F.col("c_nationkey").alias("nation_code"),
        F.col("c_mktsegment").alias("segment"),
    )


def _values_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS col, {sql.canonical(c)} AS v FROM {source} WHERE {sql.canonical(c)} <> ''"
        for c in columns
    )


OVERLAP_SQL = (
    f"SELECT r.col AS reference_column, c.col AS candidate_column, count(*) AS intersection_count "
    f"FROM ({_values_sql('customer', CUSTOMER)}) r JOIN ({_values_sql(f'({OTHER_CUSTOMER})', OTHER)}) c USING (v) "
    f"GROUP BY 1, 2"
)


@query("key_overlap", OVERLAP_SQL)
def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    return keymatch.key_overlap(table(spark, d, "customer"), CUSTOMER, _other_customer(spark, d), OTHER)


def _key_rank_sql(reference: str, columns, candidate_: str, others) -> str:
    """CTEs u (unique columns of the reference) and keys: pairs of unique columns that share values, scored."""
    overlap = (
        f"SELECT r.col AS reference_column, c.col AS candidate_column, count(*) AS intersection_count "
        f"FROM ({_values_sql(reference, columns)}) r JOIN ({_values_sql(candidate_, others)}) c USING (v) GROUP BY 1, 2"
    )
    return f"""kr AS ({sql.profile_counts(reference, columns)}), kc AS ({sql.profile_counts(candidate_, others)}),
 u AS (SELECT "column" FROM kr WHERE is_unique), o AS ({overlap}),
 ks AS (SELECT o.*, r.row_count = c.row_count AND r.unique_non_empty_count = intersection_count
   AND c.unique_non_empty_count = intersection_count AS complete_set_match,
   CAST(intersection_count AS DOUBLE) / c.unique_non_empty_count AS cc,
   CAST(intersection_count AS DOUBLE) / r.unique_non_empty_count AS rc,
   {sql.header_similarity('reference_column', 'candidate_column')} AS hs,
   least(CAST(r.unique_non_empty_count AS DOUBLE) / r.row_count,
         CAST(c.unique_non_empty_count AS DOUBLE) / c.row_count) AS su,
   r.non_empty_count AS rn, c.non_empty_count AS cn, r.position AS rp, c.position AS cp
   FROM o JOIN kr r ON r."column" = reference_column JOIN kc c ON c."column" = candidate_column
   WHERE r.is_unique AND c.is_unique),
 keys AS (SELECT reference_column, candidate_column, complete_set_match, intersection_count,
  round(cc, 6) AS candidate_key_coverage, round(rc, 6) AS reference_key_coverage,
  round(hs, 6) AS header_similarity, rn AS reference_non_empty, cn AS candidate_non_empty,
  round(CASE WHEN complete_set_match THEN 10.0 ELSE 0.0 END + 2 * cc + rc + hs + 3 * su, 6) AS score, rp, cp FROM ks)"""


@query(
    "key_rank",
    f"WITH {_key_rank_sql('customer', CUSTOMER, f'({OTHER_CUSTOMER})', OTHER)} SELECT * EXCLUDE (rp, cp) FROM keys",
)
def key_rank(spark: SparkSession, d: str) -> DataFrame:
    ref, cand = table(spark, d, "customer"), _other_customer(spark, d)
    ref_counts, cand_counts = profile.profile_counts(ref, CUSTOMER), profile.profile_counts(cand, OTHER)
    ref_unique = [r["column"] for r in profile.unique_columns(ref_counts).collect()]
    cand_unique = [r["column"] for r in profile.unique_columns(cand_counts).collect()]
    ranked = keymatch.rank_keys(ref, cand, ref_counts, cand_counts, ref_unique, cand_unique)
    return ranked.withColumn("score", F.round("score", 6))


REF_KEYS = f"SELECT o_orderkey, {sql.canonical('o_custkey')} AS k FROM orders"
CAND_KEYS = f"SELECT event_id, {sql.canonical('user_id')} AS k FROM events"


@query(
    "align_first_wins",
    f"SELECT r.o_orderkey AS reference_row, c.event_id AS candidate_row FROM "
    f"(SELECT k, min(o_orderkey) AS o_orderkey FROM ({REF_KEYS}) WHERE k <> '' GROUP BY k) r JOIN "
    f"(SELECT k, min(event_id) AS event_id FROM ({CAND_KEYS}) WHERE k <> '' GROUP BY k) c USING (k)",
)
def align_first_wins(spark: SparkSession, d: str) -> DataFrame:
    pairs = align.align_rows(
        table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id", ["o_orderkey"], ["event_id"]
    )
    return pairs.select(
        F.col("ref_ord.o_orderkey").alias("reference_row"), F.col("cand_ord.event_id").alias("candidate_row")
    )


@query(
    "align_counts",
    f"""WITH r AS ({REF_KEYS}), c AS ({CAND_KEYS}),
 f AS (SELECT (SELECT count(*) FROM r) AS reference_rows, (SELECT count(*) FROM c) AS candidate_rows,
  (SELECT count(DISTINCT k) FROM c WHERE k <> '' AND k IN (SELECT k FROM r)) AS matched_rows,
  (SELECT count(*) - count(DISTINCT k) FROM r WHERE k <> '') AS duplicate_reference_keys,
  (SELECT count(*) - count(DISTINCT k) FROM c WHERE k <> '' AND k IN (SELECT k FROM r)) AS duplicate_candidate_matches,
  (SELECT count(*) FROM c WHERE k = '' OR k NOT IN (SELECT k FROM r)) AS missing_candidate_keys)
 SELECT duplicate_reference_keys = 0 AND duplicate_candidate_matches = 0 AND missing_candidate_keys = 0
  AND matched_rows = reference_rows AND matched_rows = candidate_rows AS complete, *,
  CAST(matched_rows AS DOUBLE) / reference_rows AS coverage_reference,
  CAST(matched_rows AS DOUBLE) / candidate_rows AS coverage_candidate FROM f""",
)
def align_counts(spark: SparkSession, d: str) -> DataFrame:
    return align.alignment_counts(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id")


@query(
    "unmatched_rows",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE {sql.canonical('o_custkey')} NOT IN (SELECT k FROM ({CAND_KEYS}))",
)
def unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return align.unmatched_rows(orders, table(spark, d, "events"), "o_custkey", "user_id")


# --- mapping and scoring of the product candidate ---------------------------------------------



def _sample_sql(candidate_columns=sql.CANDIDATE_COLUMNS, source: str = sql.CANDIDATE) -> str:
    """CTE sims: the sample similarity of every pair of columns."""
    left = ", ".join(f"{sql.canonical(c)} AS r{i}" for i, c in enumerate(sql.REFERENCE_COLUMNS))
    right = ", ".join(f"{sql.canonical(c)} AS c{i}" for i, c in enumerate(candidate_columns))
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS reference_position, {j} AS candidate_position, "
        f"avg(CASE WHEN r{i} = c{j} THEN 1.0 ELSE 0.0 END) * 0.85 + "
        f"avg(CASE WHEN (r{i} = '') = (c{j} = '') THEN 1.0 ELSE 0.0 END) * 0.15 AS s FROM joined"
        for i in range(len(sql.REFERENCE_COLUMNS))
        for j in range(len(candidate_columns))
    )
    return (
        f"WITH RECURSIVE joined AS (SELECT {left}, {right} FROM ({sql.PRODUCTS}) r JOIN ({source}) c ON r.gtin = c.gtin_code "
        f"ORDER BY gtin LIMIT 256), sims AS ({pairs})"
    )


def _pairs_sql(candidate_columns=sql.CANDIDATE_COLUMNS, source: str = sql.CANDIDATE) -> str:
    """CTE pairs: every pair of columns with its figures."""
    return f"""{_sample_sql(candidate_columns, source)}, products AS ({sql.PRODUCTS}), candidate AS ({source}),
 r AS ({sql.profile_sample('products', sql.REFERENCE_COLUMNS, 'gtin')}),
 c AS ({sql.profile_sample('candidate', candidate_columns, 'gtin_code')}),
 f AS (SELECT r.position AS rp, c.position AS cp, r."column" AS reference_column, c."column" AS candidate_column,
  {sql.header_similarity('r."column"', 'c."column"')} AS h,
  {sql.type_compatibility('r.numeric_ratio', 'r.bool_ratio', 'c.numeric_ratio', 'c.bool_ratio')} AS t FROM r, c),
 pairs AS (SELECT reference_position, candidate_position, reference_column, candidate_column,
  round(h, 6) AS header_similarity, t AS type_compatibility, round(CAST(s AS DOUBLE), 6) AS sample_similarity,
  round(CAST(0.35 * h + 0.10 * t + 0.55 * s AS DOUBLE), 6) AS mapping_confidence
  FROM f JOIN sims ON rp = reference_position AND cp = candidate_position)"""


# Best pair first: each pair is taken if it is good enough and neither of its columns is taken.
_GREEDY_SQL = """ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY mapping_confidence DESC, sample_similarity DESC,
  header_similarity DESC, reference_position, candidate_position) AS n FROM pairs),
 picked AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS refs, CAST([] AS VARCHAR[]) AS cands UNION ALL
  SELECT ranked.n, CASE WHEN free THEN list_append(refs, reference_column) ELSE refs END,
   CASE WHEN free THEN list_append(cands, candidate_column) ELSE cands END
  FROM (SELECT ranked.*, refs, cands, (mapping_confidence >= 0.55 OR sample_similarity >= 0.85)
    AND NOT list_contains(refs, reference_column) AND NOT list_contains(cands, candidate_column) AS free
   FROM picked JOIN ranked ON ranked.n = picked.n + 1) AS ranked),
 accepted AS (SELECT unnest(refs) AS reference_column, unnest(cands) AS candidate_column
  FROM (SELECT * FROM picked ORDER BY n DESC LIMIT 1))"""


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return mapping.sample_rows(
        products(spark, d), candidate(spark, d), "gtin", "gtin_code", ["gtin"], ["gtin_code"],
        sql.REFERENCE_COLUMNS, sql.CANDIDATE_COLUMNS, mapping.DEFAULT_SAMPLE,
    )


# An order with few values: the key decides, and there is one row per key however many rows share a place.
@query(
    "mapping_sample_ties",
    f"SELECT k AS key, p AS priority FROM (SELECT {sql.canonical('o_custkey')} AS k, min(o_orderpriority) AS p FROM orders "
    f"GROUP BY ALL) WHERE k IN (SELECT {sql.canonical('user_id')} FROM events) AND k <> '' ORDER BY p, k LIMIT 100",
)
def mapping_sample_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = mapping.sample_rows(
        table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id", ["o_orderpriority"], ["event_type"],
        ["o_totalprice", "o_orderdate"], ["value"], 100,
    )
    return rows.select(F.col("_key").alias("key"), F.col("ref_ord.o_orderpriority").alias("priority"))


@query(
    "mapping_sample",
    f"{_sample_sql()} SELECT reference_position, candidate_position, round(CAST(s AS DOUBLE), 6) AS sample_similarity FROM sims",
)
def mapping_sample(spark: SparkSession, d: str) -> DataFrame:
    found = mapping.sample_similarity(_sample(spark, d), sql.REFERENCE_COLUMNS, sql.CANDIDATE_COLUMNS)
    return found.withColumn("sample_similarity", F.round("sample_similarity", 6))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mapping_pairs(
        mapping.sample_similarity(_sample(spark, d), sql.REFERENCE_COLUMNS, sql.CANDIDATE_COLUMNS),
        profile.profile_sample(products(spark, d), sql.REFERENCE_COLUMNS, ["gtin"]),
        profile.profile_sample(candidate(spark, d), sql.CANDIDATE_COLUMNS, ["gtin_code"]),
    )


@query("mapping_pairs", f"{_pairs_sql()} SELECT * FROM pairs")
def mapping_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


_EXPECTED = list(zip(sql.REFERENCE_COLUMNS, sql.CANDIDATE_COLUMNS))


@query("mapping_greedy", f"{_pairs_sql()}, {_GREEDY_SQL} SELECT * FROM accepted")
def mapping_greedy(spark: SparkSession, d: str) -> DataFrame:
    accepted = mapping.assign_columns([r.asDict() for r in _pairs(spark, d).collect()])
    rows = [(p["reference_column"], p["candidate_column"]) for p in accepted]
    return spark.createDataFrame(rows, "reference_column string, candidate_column string")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return align.align_rows(
        products(spark, d), candidate(spark, d), "gtin", "gtin_code", ["gtin"], ["gtin_code"],
        sql.REFERENCE_COLUMNS, sql.CANDIDATE_COLUMNS,
    )


SCORES_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS reference_column, '{c}' AS candidate_column, avg({sql.cell_similarity(r, c)}) AS similarity, "
    f"count(*) AS row_count_scored FROM {PAIRED}"
    for r, c in _EXPECTED
)


@query(
    "column_scores",
    f"SELECT reference_column, candidate_column, round(similarity, 6) AS similarity, row_count_scored FROM ({SCORES_SQL})",
)
def column_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = scoring.column_scores(_aligned(spark, d), _EXPECTED)
    return scores.withColumn("similarity", F.round("similarity", 6))


# The coverage of a candidate that lacks every fourth product.
_COVERAGE = f"(SELECT CAST(count(c.gtin_code) AS DOUBLE) / count(*) FROM ({sql.PRODUCTS}) r LEFT JOIN ({sql.CANDIDATE}) c ON r.gtin = c.gtin_code AND dan_code % 4 <> 0)"


@query(
    "dataset_score",
    f"SELECT round(sum(similarity) / {len(_EXPECTED)}, 6) AS dataset_similarity_equal_weighted, "
    f"round(sum(similarity) / {len(_EXPECTED)} * {_COVERAGE}, 6) AS overall_score_with_coverage, "
    f"count(*) AS mapped_reference_columns, CAST({len(_EXPECTED)} AS BIGINT) AS reference_columns_total "
    f"FROM ({SCORES_SQL.replace(f'FROM {PAIRED}', f'FROM (SELECT * FROM {PAIRED} WHERE dan_code % 4 <> 0)')})",
)
def dataset_score(spark: SparkSession, d: str) -> DataFrame:
    other = candidate(spark, d).where("dan_code % 4 <> 0")
    counts = align.alignment_counts(products(spark, d), other, "gtin", "gtin_code").first()
    aligned = align.align_rows(
        products(spark, d), other, "gtin", "gtin_code", ["gtin"], ["gtin_code"], sql.REFERENCE_COLUMNS, sql.CANDIDATE_COLUMNS
    )
    scores = scoring.column_scores(aligned, _EXPECTED)
    total = scoring.dataset_score(scores, sql.REFERENCE_COLUMNS, counts["coverage_reference"])
    return total.withColumns(
        {c: F.round(c, 6) for c in ("dataset_similarity_equal_weighted", "overall_score_with_coverage")}
    )


def _compared(
    spark: SparkSession, d: str, kept: Column | None = None, sample_size: int = mapping.DEFAULT_SAMPLE
) -> dict:
    """A comparison reads its tables several times, so the two views are written first."""
    made = materialize(products(spark, d), "ref")
    other = candidate(spark, d, made) if kept is None else candidate(spark, d, made).where(kept)
    return comparison.compare(
        comparison.Table(made, ["gtin"], sql.REFERENCE_COLUMNS, "products"),
        comparison.Table(materialize(other, "cand"), ["gtin_code"], sql.CANDIDATE_COLUMNS, "candidate"),
        sample_size,
    )


def _summary_sql(condition: str = "true") -> str:
    scores = SCORES_SQL.replace(f"FROM {PAIRED}", f"FROM (SELECT * FROM {PAIRED} WHERE {condition})")
    return f"""WITH s AS ({scores}), n AS (SELECT count(*) AS n FROM part),
 m AS (SELECT count(*) AS m FROM {PAIRED} WHERE {condition}),
 t AS (SELECT sum(similarity) / {len(_EXPECTED)} AS t, count(*) AS c FROM s)
 SELECT CASE WHEN m = n THEN 'ok' ELSE 'partial_key_match' END AS status, round(t, 6) AS dataset_similarity_equal_weighted, CAST(m AS DOUBLE) / n AS coverage_reference,
  CAST(1 AS DOUBLE) AS coverage_candidate, round(t * m / n, 6) AS overall_score_with_coverage, m AS matched_rows,
  n AS reference_rows, m AS candidate_rows, c AS mapped_reference_columns,
  CAST({len(_EXPECTED)} AS BIGINT) AS reference_columns_total, CASE WHEN m = n THEN 'complete' ELSE 'partial' END AS key_match_mode,
  'gtin' AS key_reference_column, 'gtin_code' AS key_candidate_column FROM t, n, m"""


def _summary(spark: SparkSession, report: dict) -> DataFrame:
    return comparison.summary_frame(spark, report).withColumns(
        {c: F.round(c, 6) for c in ("dataset_similarity_equal_weighted", "overall_score_with_coverage")}
    )


@query("compare_summary", _summary_sql())
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, _compared(spark, d))


@query("compare_all_rows", _summary_sql())
def compare_all_rows(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, _compared(spark, d, sample_size=0))


# A candidate that lacks every fourth product.
@query("compare_partial", _summary_sql("dan_code % 4 <> 0"))
def compare_partial(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, _compared(spark, d, F.col("dan_code") % 4 != 0))


# Both tables through CSV files, as the comparison of two files reads them.
@query("compare_csv", _summary_sql())
def compare_csv(spark: SparkSession, d: str) -> DataFrame:
    def through_csv(df: DataFrame, order: str, label: str) -> comparison.Table:
        path = new_folder(spark, label)
        sinks.write_csv(df.repartitionByRange(order).sortWithinPartitions(order), path)
        return tables.csv_table(spark, path, multi_line=False)

    reference = through_csv(products(spark, d).select(*sql.REFERENCE_COLUMNS), "gtin", "csv-reference")
    other = through_csv(candidate(spark, d).select(*sql.CANDIDATE_COLUMNS), "gtin_code", "csv-candidate")
    return _summary(spark, comparison.compare(reference, other))


# A candidate without ratings but with a column that the reference lacks: every figure of its report.
_REPORT_COLUMNS = (*[c for c in sql.CANDIDATE_COLUMNS if c != "rating_score"], "extra_noise")
_REPORT_CANDIDATE = (
    f"SELECT * EXCLUDE (rating_score), concat('n', CAST(dan_code % 10 AS VARCHAR)) AS extra_noise FROM ({sql.CANDIDATE}) q"
)


def _long_sql(section: str, item: str, metrics: dict[str, str], source: str) -> list[str]:
    return [
        f"SELECT '{section}' AS section, {item} AS item, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, "
        f"CAST(NULL AS VARCHAR) AS text FROM {source}"
        for metric, value in metrics.items()
    ]


def _names_sql(section: str, item: str, metric: str, text: str, source: str) -> str:
    return f"SELECT '{section}' AS section, {item} AS item, '{metric}' AS metric, CAST(NULL AS DOUBLE) AS value, {text} AS text FROM {source}"


def _report_sql() -> str:
    pair = "reference_column || '=' || candidate_column"
    figures = ("header_similarity", "type_compatibility", "sample_similarity", "mapping_confidence")
    matched = [(r, c) for r, c in _EXPECTED if c in _REPORT_COLUMNS]
    scores = " UNION ALL ".join(
        f"SELECT '{r}' AS reference_column, '{c}' AS candidate_column, avg({sql.cell_similarity(r, c)}) AS similarity, "
        f"count(*) AS row_count_scored FROM products r JOIN candidate c ON r.gtin = c.gtin_code"
        for r, c in matched
    )
    total = len(sql.REFERENCE_COLUMNS)
    counts = {"reference_rows": "n", "candidate_rows": "m", "matched_rows": "k", "coverage_reference": "round(k / n, 6)", "coverage_candidate": "round(k / m, 6)"}
    overall = {
        "dataset_similarity_equal_weighted": "round(t, 6)", "overall_score_with_coverage": "round(t * k / n, 6)",
        "mapped_reference_columns": "mapped", "reference_columns_total": str(total),
    }
    lists = lambda names: "(SELECT unnest([" + ", ".join(f"'{c}'" for c in names) + "]) AS col)"
    status = "CASE WHEN k = n AND k = m THEN 'ok' ELSE 'partial_key_match' END"
    mode = "CASE WHEN k = n AND k = m THEN 'complete' ELSE 'partial' END"
    parts = [
        *_long_sql("summary", "''", {**{k: v for k, v in counts.items()}, **overall}, "facts"),
        _names_sql("summary", "''", "status", status, "facts"),
        _names_sql("summary", "''", "key_match_mode", mode, "facts"),
        _names_sql("summary", "''", "key_reference_column", "reference_column", "best"),
        _names_sql("summary", "''", "key_candidate_column", "candidate_column", "best"),
        *_long_sql("reference_profile", "''", {"row_count": "n", "column_count": str(total)}, "facts"),
        *_long_sql("candidate_profile", "''", {"row_count": "m", "column_count": str(len(_REPORT_COLUMNS))}, "facts"),
        *_long_sql("reference_profile", '"column"', {"unique": "1"}, "u"),
        *_long_sql("reference_unmatched", "col", {"unmatched": "1"}, f"{lists(sql.REFERENCE_COLUMNS)} WHERE col NOT IN (SELECT reference_column FROM accepted)"),
        *_long_sql("candidate_unmatched", "col", {"unmatched": "1"}, f"{lists(_REPORT_COLUMNS)} WHERE col NOT IN (SELECT candidate_column FROM accepted)"),
        *_long_sql(
            "row_alignment", "''",
            {
                **counts, "complete": "CASE WHEN k = n AND k = m THEN 1 ELSE 0 END", "duplicate_reference_keys": "0",
                "duplicate_candidate_matches": "0", "missing_candidate_keys": "m - k",
            },
            "facts",
        ),
        _names_sql("row_alignment", "''", "reference_key", "reference_column", "best"),
        _names_sql("row_alignment", "''", "candidate_key", "candidate_column", "best"),
        *_long_sql(
            "key", pair,
            {c: c for c in (
                "rank", "complete_set_match", "intersection_count", "candidate_key_coverage", "reference_key_coverage",
                "header_similarity", "reference_non_empty", "candidate_non_empty", "score",
            )},
            "listed",
        ),
        *_long_sql("pair", pair, {"rank": "n", **{c: c for c in figures}}, "ranked WHERE n <= 50"),
        *_long_sql("column_mapping", "''", {"mapping_confidence_avg": "round(avg(mapping_confidence), 6)"}, "chosen"),
        _names_sql("column_mapping", "reference_column", "candidate_column", "candidate_column", "chosen"),
        *_long_sql("column_mapping", "reference_column", {c: c for c in figures}, "chosen"),
        *_long_sql(
            "score", "reference_column",
            {
                "similarity": "round(similarity, 6)", "matched": "1", "row_count_scored": "row_count_scored",
                **{c: c for c in ("mapping_confidence", "header_similarity", "sample_similarity")},
            },
            "chosen JOIN scored USING (reference_column, candidate_column)",
        ),
        _names_sql("score", "reference_column", "candidate_column", "candidate_column", "chosen"),
        *_long_sql("score", "col", {"similarity": "0", "matched": "0"}, f"{lists(sql.REFERENCE_COLUMNS)} WHERE col NOT IN (SELECT reference_column FROM accepted)"),
        *_long_sql("scores", "''", overall, "facts"),
    ]
    return f"""{_pairs_sql(_REPORT_COLUMNS, _REPORT_CANDIDATE)}, {_GREEDY_SQL},
 {_key_rank_sql('products', sql.REFERENCE_COLUMNS, 'candidate', _REPORT_COLUMNS)},
 listed AS (SELECT *, row_number() OVER (ORDER BY score DESC, reference_non_empty DESC, rp, cp) AS rank FROM keys QUALIFY rank <= 10),
 best AS (SELECT * FROM listed WHERE rank = 1),
 chosen AS (SELECT ranked.* FROM ranked JOIN accepted USING (reference_column, candidate_column)), scored AS ({scores}),
 facts AS (SELECT (SELECT count(*) FROM products) AS n, (SELECT count(*) FROM candidate) AS m,
  (SELECT count(*) FROM products JOIN candidate ON gtin = gtin_code) AS k,
  (SELECT sum(similarity) / {total} FROM scored JOIN accepted USING (reference_column, candidate_column)) AS t,
  (SELECT count(*) FROM accepted) AS mapped)
 {' UNION ALL '.join(parts)}"""


@query("compare_report", _report_sql())
def compare_report(spark: SparkSession, d: str) -> DataFrame:
    made = materialize(products(spark, d), "ref")
    noise = F.concat(F.lit("n"), (F.col("dan_code") % 10).cast("string"))
    noisy = candidate(spark, d, made).drop("rating_score").withColumn("extra_noise", noise)
    report = comparison.compare(
        comparison.Table(made, ["gtin"], sql.REFERENCE_COLUMNS, "products"),
        comparison.Table(materialize(noisy, "cand"), ["gtin_code"], _REPORT_COLUMNS, "candidate"),
    )
    return comparison.report_rows(spark, report).withColumn("value", F.round("value", 6))


@query(
    "compare_no_key",
    f"""SELECT 'no_complete_key_match' AS status, CAST(0 AS DOUBLE) AS dataset_similarity_equal_weighted,
 CAST(0 AS DOUBLE) AS coverage_reference, CAST(0 AS DOUBLE) AS coverage_candidate, CAST(0 AS DOUBLE) AS overall_score_with_coverage,
 CAST(0 AS BIGINT) AS matched_rows, count(*) AS reference_rows, count(*) AS candidate_rows,
 CAST(0 AS BIGINT) AS mapped_reference_columns, CAST({len(_EXPECTED)} AS BIGINT) AS reference_columns_total,
 'no_exact_or_partial_unique_key_match' AS reason FROM part""",
)
def compare_no_key(spark: SparkSession, d: str) -> DataFrame:
    blank = [c for c in sql.CANDIDATE_COLUMNS if c not in ("gtin_code", "dan_code")]
    # The order column is no comparison column: only blanked ones are compared.
    keyless = perturb.drop_columns(candidate(spark, d), ["gtin_code"], blank)
    report = comparison.compare(
        comparison.Table(products(spark, d), ["gtin"], sql.REFERENCE_COLUMNS),
        comparison.Table(keyless, ["dan_code"], blank),
    )
    frame = comparison.report_frame(spark, report)
    shown = (
        "status", "dataset_similarity_equal_weighted", "coverage_reference", "coverage_candidate",
        "overall_score_with_coverage", "matched_rows", "reference_rows", "candidate_rows",
        "mapped_reference_columns", "reference_columns_total",
    )
    return frame.select(*[f"summary.{c}" for c in shown], "key_match.reason")
