"""Bounded samples of labelled rows for fitting models; everything else reads whole tables.

A sample is bounded twice: in rows, and in bytes of whole texts (no text is cut; one that does
not fit any more is left out). An id counts once, however often it stands in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep
from catalogq.operators.topk import top_per_group


def fold(parts: int) -> Column:
    """The fold of a row: crc32 of doc_id as text, modulo parts (null ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


def _pick() -> Column:
    return F.xxhash64(F.lit("sample"), "doc_id")


def _distinct() -> Column:
    """About how many ids there are; sketches are all that is shuffled."""
    return F.approx_count_distinct("doc_id")


def _thin(rows: Column | int, total: Column | int) -> Column:
    """Keeps somewhat more than so many of all rows, by the hash."""
    return F.col("_pick") / F.lit(2.0**64) + 0.5 <= (1.2 * rows + 100) / total


def bounded(ids: DataFrame, rows: int) -> DataFrame:
    """At most so many ids of a narrow table with doc_id, picked by a hash of doc_id, one row each.

    The table is thinned by the hash to about the number asked for before anything is shuffled, so no
    task gets more than about that many rows.
    """
    total = ids.agg(_distinct()).first()[0]
    thinned = ids.withColumn("_pick", _pick()).where(_thin(rows, max(total, 1)))
    return thinned.dropDuplicates(["doc_id"]).orderBy("_pick", "doc_id").limit(rows).drop("_pick")


def bounded_each(ids: DataFrame, column: str, rows: int, values: int) -> DataFrame:
    """At most so many ids of each of the values with the most rows, picked by a hash of doc_id.

    The values' counts are a short list on the driver; with them each task thins its rows before
    anything is shuffled, so a value with most of the rows is no hot spot.
    """
    counted = ids.groupBy(column).agg(_distinct().alias("count")).orderBy(F.desc("count"), column).limit(values).collect()
    if not counted:
        return ids.where("false")
    totals = F.create_map(*[F.lit(x) for r in counted for x in (r[column], r["count"])])
    hashed = ids.withColumn("_pick", _pick()).withColumn("_total", F.try_element_at(totals, F.col(column)))
    thinned = hashed.where(_thin(rows, F.col("_total"))).dropDuplicates(["doc_id"])
    return top_per_group(thinned, [column], [F.col("_pick"), F.col("doc_id")], rows).select(*ids.columns)


def picked_texts(docs: DataFrame, picked: DataFrame, most_bytes: int, group: str | None = None) -> list[Row]:
    """The whole texts of a bounded table of ids with its other columns, up to so many bytes together.

    Of several rows with an id the smallest text counts. Texts are taken in the order of the ids'
    hashes while they fit; with group, each of its values has an equal part of the bytes, and its
    first text that fits in all of them. Tasks reduce repeated ids before their texts are shuffled.
    """
    picked = keep(picked, "sampled-ids")
    ids = F.broadcast(picked.select("doc_id"))  # of a number of rows that the caller has bounded
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    rows = keep(texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(picked), "doc_id"), "sampled-texts")
    listed = rows.select(*picked.columns, F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes"), _pick().alias("_pick"))
    used: dict = {}
    sizes = sorted(listed.collect(), key=lambda r: (r["_pick"], r["doc_id"]))
    share = most_bytes // max(len({r[group] for r in sizes}) if group else 1, 1)
    chosen = []
    for r in sizes:
        key = r[group] if group else None
        if used.get(key, 0) + r["_bytes"] <= share or key not in used and r["_bytes"] <= most_bytes:
            used[key] = used.get(key, 0) + r["_bytes"]
            chosen.append(r["doc_id"])
    found = rows if len(chosen) == len(sizes) else rows.where(F.col("doc_id").isin(chosen))
    return sorted(found.collect(), key=lambda r: r["doc_id"])


def sampled_texts(docs: DataFrame, ids: DataFrame, rows: int, most_bytes: int) -> list[Row]:
    """picked_texts of a bounded sample of ids."""
    return picked_texts(docs, bounded(ids, rows), most_bytes)
