"""The registered queries: against their SQL, and the columns that their contracts fix."""

import oracle
import pytest

import __spark_entry__ as contract
from catalogq.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_sentencepiece": "doc_id:bigint ids:array<int> n_ids:bigint round_trip:boolean",
    "op2_shard_bytes": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op3_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op4_secret_scan": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op5_benchmark_leaks": "doc_id:bigint item_id:bigint coverage:double agreement:double",
    "op6_quality_rules": (
        "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint "
        "base_failed:boolean kept:boolean"
    ),
    "op7_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op8_quality_model": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op9_html_main_text": "page_id:bigint url:string text:string n_chars:bigint",
    "op10_minhash_near_dedup": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op11_license_scan": (
        "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string "
        "score:double"
    ),
    "op12_phrase_collocations": "lang:string rank:bigint phrase:string a:bigint l:bigint r:bigint n:bigint score:bigint",
    "op13_embedding_whitening": (
        "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double"
    ),
}


# The table of a query where it is not documents, and its rows per row of the table (None: not fixed).
SOURCES = {"op5": ("documents", None), "op9": ("pages", 1), "op12": ("documents", None), "op13": ("embeddings", 32)}


def test_every_query_is_in_the_contract():
    assert set(COLUMNS) == set(QUERIES) and {*QUERIES, "pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(name, spark, sf_dir):
    df = contract.queries()[name](spark, sf_dir)
    assert " ".join(f"{c}:{t}" for c, t in df.dtypes) == COLUMNS[name]
    source, each = SOURCES.get(name.split("_")[0], ("documents", 1))
    assert each is None or df.count() == each * spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir):
    assert oracle.difference(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) == ""
