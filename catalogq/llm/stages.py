"""Stages of the corpus pipeline: each takes whole documents; all but the last give them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.llm import decontam, minhash, pieces, quality_rules, secret_scan
from catalogq.llm.registry import PIECE_FILE, table
from catalogq.llm.scratch import keep

STAGE_THRESHOLD = 80  # per cent of the union of the five-word shingles


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (STAGE_THRESHOLD) stays: the one with the smallest doc_id.

    Rows without doc_id stay. Of several rows with a doc_id that stays, one stays.
    """
    found = minhash.near_duplicates(docs, STAGE_THRESHOLD).select("doc_id", "kept")
    state = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.bool_or("kept").alias("kept")
    )
    # Written, so that the sizes of the lists are known before they may be broadcast.
    odd = keep(state.where((F.col("rows") > 1) | ~F.col("kept")), "odd-documents")
    single = docs.join(odd.select("doc_id"), "doc_id", "left_anti")
    repeated = docs.join(odd.where("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, private keys with their bodies, is replaced by a mark; n_chars follows the text. A null text stays null."""
    found = secret_scan.find_secrets(docs, secret_scan.MASKED)
    hidden = F.size("_spans") > 0
    masked = secret_scan.masked(F.col("_text"), F.col("_spans"))
    changed = found.withColumn("_new", F.when(hidden, masked).otherwise(F.col("_row.text")))
    length = F.when(hidden, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars"))
    new = {"text": F.col("_new").alias("text"), "n_chars": length.alias("n_chars")}
    return changed.select(*[new.get(c, F.col(f"_row.`{c}`").alias(c)) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_ids of every document."""
    encoded = pieces.encode_texts(docs, pieces.load_pieces(PIECE_FILE), ("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", "ids", "n_ids")
