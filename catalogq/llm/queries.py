"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogq.llm import (
    decontam,
    html_main,
    langid,
    license_scan,
    minhash,
    oracles,
    phrases,
    pieces,
    quality_model,
    quality_rules,
    secret_scan,
    sharding,
    toxicity,
    whitening,
)
from catalogq.llm.registry import ORACLES, PIECE_FILE, QUERIES, query, table  # noqa: F401

@query("op10_minhash_near_dedup", oracles.NEAR_DEDUP)
def op10(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_secret_scan", oracles.SECRET_SCAN)
def op4(spark, sf_dir):
    return secret_scan.scan_report(table(spark, sf_dir, "documents"))


@query("op6_quality_rules", oracles.QUALITY_RULES)
def op6(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_shard_bytes")
def op2(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality_model")
def op8(spark, sf_dir):
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


@query("op5_benchmark_leaks")
def op5(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    return pieces.encode_texts(table(spark, sf_dir, "documents"), pieces.load_pieces(PIECE_FILE))


@query("op9_html_main_text", oracles.HTML_MAIN)
def op9(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_phrase_collocations", oracles.PHRASES)
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op11_license_scan", oracles.LICENSES)
def op11(spark, sf_dir):
    return license_scan.license_report(table(spark, sf_dir, "documents"))
