"""Near copies of documents: MinHash with banding, verified on whole shingle sets, and components.

* Each text gives its set of distinct five-word shingles (64-bit hashes of lower-cased words;
  a shorter text is one shingle). Universal hash functions give the minima, and runs of minima
  (bands) are the keys that near copies share. Bands and their rows follow from the threshold
  (layout): a pair at the threshold shares no band with probability below 1e-8; at 0.85 there
  are 32 bands of 5 rows.
* Texts with the same set are one class, met once, whatever their number.
* Buckets are not expanded into pairs. First every member of a bucket is checked against the
  smallest member; the links found give classes of linked texts. Members of buckets that still
  hold several classes get a second, finer set of keys (64 runs of 10 minima at 0.85: a pair at the
  threshold shares none with probability below 0.95e-6, texts that only have a passage in
  common share none as a rule). The members of its mixed buckets are dealt by hash into small
  hands and checked against the first of their hand, again and again until a deal finds no link;
  what is then left in buckets of several classes is joined across classes on the rare shingles
  of each set, which finds all links among these texts.
* A pair is dropped by signature only if the share of equal minima is DOUBT standard errors
  below the threshold; all others are decided on the whole sets.

Rows without doc_id take part in nothing: component_id is null and kept is true. Rows with the
same doc_id are one document. Texts without words have an empty set and are linked with nothing.
"""

from __future__ import annotations

from functools import partial
from math import ceil, log, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.llm.components import components
from catalogq.llm.scratch import drop, keep, store
from catalogq.llm.textbatch import (
    list_column,
    lowered,
    mix,
    over_texts,
    span_hashes,
    split_words,
    text_bytes,
    window_hashes,
)

SHINGLE = 5  # words
ROWS, LEAST_BANDS, BANDS, MISSED = 5, 32, 64, 1e-8  # rows at most, bands if more rows allow it, chance of a missed pair
FINE_ROWS, FINE_LEAST, FINE_BANDS, FINE_MISSED = 10, 64, 80, 0.95e-6
HAND = 4  # members of a mixed bucket that are compared with one of them
THRESHOLD = 85  # per cent of the union
DOUBT = 7  # standard errors of the estimate from the minima of a signature
COLUMNS = 2048  # shingles hashed at a time


class Layout(NamedTuple):
    bands: int
    rows: int

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _layout(threshold: int, rows: int, least: int, most: int, missed: float) -> Layout:
    """The most rows a band whose bands, at most `most` unless rows are 1, miss a pair at the threshold with chance missed."""
    share = threshold / 100
    while True:
        needed = 1 if share >= 1 else ceil(log(missed) / log1p(-(share**rows)))
        if needed <= most or rows == 1:
            return Layout(max(least, needed), rows)
        rows -= 1


def layout(threshold: int) -> tuple[Layout, Layout]:
    """Coarse and fine bands for a threshold in per cent; together they miss a pair with chance below 1e-6."""
    if not 0 < threshold <= 100:
        raise ValueError("threshold: per cent, above 0 and at most 100")
    return (
        _layout(threshold, ROWS, LEAST_BANDS, BANDS, MISSED),
        _layout(threshold, FINE_ROWS, FINE_LEAST, FINE_BANDS, FINE_MISSED),
    )


def _drawn(seed: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of universal hash functions x -> factor * x + shift modulo 2^64."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 63, (2, hashes, 1), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


COARSE_SEED, FINE_SEED = 8_105, 8_106


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    words = split_words(lowered(data), offsets)
    hashes = span_hashes(words.data, words.starts, words.ends)
    windows = window_hashes(hashes, size)
    first = words.first.tolist()
    sets = []
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            sets.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            sets.append(mix(window_hashes(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            sets.append(hashes[:0])
    return sets


def minima(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over a set that isn't empty."""
    factor, shift = functions
    least = (shingles[:COLUMNS] * factor + shift).min(axis=1)
    for at in range(COLUMNS, len(shingles), COLUMNS):
        np.minimum(least, (shingles[at : at + COLUMNS] * factor + shift).min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    rows = least.reshape(bands, -1)
    rows = mix(rows + np.arange(rows.shape[1], dtype=np.uint64) * np.uint64(1 << 40))
    return mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _sketch(batch: pa.RecordBatch, coarse: Layout) -> pa.RecordBatch:
    functions = _drawn(COARSE_SEED, coarse.hashes)
    sets = shingle_sets(batch.column(1))
    sizes = np.array([len(s) for s in sets], np.int64)
    marks = np.zeros((2, len(sets)), np.uint64)
    bands = [np.zeros(0, np.uint64)]
    for i, s in enumerate(sets):
        if len(s):
            marks[0, i], marks[1, i] = s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)
            bands.append(band_keys(minima(s, functions), coarse.bands))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(sizes),
            pa.array(marks[0].view(np.int64)),
            pa.array(marks[1].view(np.int64)),
            list_column(np.concatenate(bands).view(np.int64), np.where(sizes > 0, coarse.bands, 0), pa.int64()),
        ],
        ["doc_id", "n_shingles", "mark_a", "mark_b", "bands"],
    )


def _sets(batch: pa.RecordBatch, coarse: Layout) -> pa.RecordBatch:
    functions = _drawn(COARSE_SEED, coarse.hashes)
    sets = shingle_sets(batch.column(1))
    least = [minima(s, functions).astype(np.uint32).view(np.int32) if len(s) else np.zeros(0, np.int32) for s in sets]
    count = lambda parts: np.array([len(p) for p in parts], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            list_column(np.concatenate(least), count(least), pa.int32()),
            list_column(np.concatenate(sets).view(np.int64), count(sets), pa.int64()),
        ],
        ["rep", "signature", "shingles"],
    )


def _fine(batch: pa.RecordBatch, fine: Layout) -> pa.RecordBatch:
    functions = _drawn(FINE_SEED, fine.hashes)
    sets = batch.column(1)
    values, ends = sets.flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(sets).to_numpy())
    keys = [band_keys(minima(x, functions), fine.bands) for x in np.split(values, ends[:-1])]
    bands = list_column(np.concatenate(keys).view(np.int64), np.full(len(keys), fine.bands), pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), bands], ["rep", "bands"])


def _buckets(sketches: DataFrame, label: str) -> DataFrame:
    """(band, leader, rep) of all buckets with several members; the leader is the smallest."""
    banded = sketches.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1")
    return keep(banded.join(shared.select("band", "leader"), "band"), label)


def _classed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, rep, class, size) of the buckets that hold several classes of linked texts."""
    classed = members.join(found, members.rep == found.node, "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("class")
    )
    mixed = classed.groupBy("band").agg(
        F.min("class").alias("_least"), F.max("class").alias("_last"), F.count("*").alias("size")
    )
    return classed.join(mixed.where("_least < _last").select("band", "size"), "band")


def _dealt(members: DataFrame, deal: int) -> DataFrame:
    """Pairs across classes after dealing each bucket's members by hash into hands of about HAND."""
    hand = F.pmod(F.xxhash64("rep", F.lit(deal)), F.ceil(F.col("size") / HAND))
    dealt = members.withColumn("hand", hand)
    leaders = dealt.groupBy("band", "hand").agg(F.min(F.struct("rep", "class")).alias("leader"))
    pairs = dealt.join(leaders, ["band", "hand"]).where(F.col("class") != F.col("leader.class"))
    return pairs.select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _stars(members: DataFrame) -> DataFrame:
    """The pairs of each member with its bucket's leader."""
    return members.where("leader < rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; signatures drop the clearly unlike first."""
    share, hashes = threshold / 100, layout(threshold)[0].hashes
    least = hashes * (share - DOUBT * (share * (1 - share) / hashes) ** 0.5)
    signatures = sets.select("rep", "signature")
    alike = F.aggregate(
        F.zip_with("sig_a", "sig_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x
    )
    likely = (
        pairs.join(signatures.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a")), "a")
        .join(signatures.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b")), "b")
        .where(alike >= least)
        .select("a", "b")
    )
    whole = sets.select("rep", "shingles")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        likely.join(whole.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(whole.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
        .withColumn("_common", common)
        .where(F.col("_common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("_common")) * threshold)
        .select("a", "b")
    )


def _across(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs across the classes of members (rep, class), without loss: prefix and position filter.

    With the shingles of every set in one order, rare ones first, two similar sets share a shingle
    in their prefixes, and enough shingles can follow the first one they share.
    """
    tokens = members.join(sets.select("rep", "shingles"), "rep").select(
        "rep", "class", F.size("shingles").alias("size"), F.explode("shingles").alias("token")
    )
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ordered = tokens.join(counts, "token").groupBy("rep", "class", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens")
    )
    prefix = F.slice("tokens", F.lit(1), F.col("size") - F.ceil(F.col("size") * threshold / 100).cast("int") + 1)
    first = keep(
        ordered.select("rep", "class", "size", F.posexplode(prefix).alias("place", "x"))
        .where("x.n > 1")
        .select("rep", "class", "size", "place", "x.token"),
        "prefixes",
    )
    side = lambda x: first.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "class", "size", "place")])
    rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))  # places count from 0
    likely = (
        (F.col("class_a") < F.col("class_b"))
        & (F.col("size_a") * threshold <= F.col("size_b") * 100)
        & (F.col("size_b") * threshold <= F.col("size_a") * 100)
        & (rest * (100 + threshold) >= (F.col("size_a") + F.col("size_b")) * threshold)
    )
    a, b = side("a"), side("b")
    pairs = a.join(b, (a.token == b.token) & likely)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _linked(classes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of the classes (rep, bands) that have links; texts has doc_id and text."""
    coarse, finer = layout(threshold)
    members = _buckets(classes, "members")
    sets = keep(
        over_texts(
            texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"),
            partial(_sets, coarse=coarse),
            "rep long, signature array<int>, shingles array<long>",
        ),
        "sets",
    )
    stars = _stars(members)
    first = keep(components(_verified(stars, sets, threshold)), "first")
    mixed = _classed(members, first).select("rep").distinct()
    again = sets.select("rep", "shingles").join(mixed, "rep", "left_semi")
    fine = _buckets(keep(over_texts(again, partial(_fine, fine=finer), "rep long, bands array<long>"), "fine-sketches"), "fine")
    now, deal = first, 0
    while True:
        classed, classed_path = store(_classed(fine, now), "classed")
        links, links_path = store(_verified(_dealt(classed, deal), sets, threshold), "links")
        if links.isEmpty():
            break
        now, deal = keep(components(_tied(now).union(links)), "dealt"), deal + 1
        drop(fine.sparkSession, classed_path)
        drop(fine.sparkSession, links_path)
    left = classed.select("rep", "class").distinct()
    return components(_tied(now).union(_verified(_across(left, sets, threshold), sets, threshold)))


def _tied(found: DataFrame) -> DataFrame:
    """Components as edges."""
    return found.select(F.col("component").alias("a"), F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row (see the module's text).

    docs needs doc_id (long) and text; other columns are ignored, whatever their names.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = keep(
        over_texts(
            plain, partial(_sketch, coarse=layout(threshold)[0]), "doc_id long, n_shingles long, mark_a long, mark_b long, bands array<long>"
        ),
        "sketches",
    )
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    same = ["mark_a", "mark_b", "n_shingles"]
    classes = keep(
        usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes"
    )
    found = _tied(_linked(classes, plain, threshold))
    # A document id with several texts ties their classes together.
    owners = usable.join(classes.select(*same, "rep"), same).select("doc_id", "rep").distinct()
    split = owners.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_last")).where("a < _last")
    repeated = owners.join(split, "doc_id").select("a", F.col("rep").alias("b"))
    final = keep(components(found.union(repeated)), "final")
    named = classes.select(*same, "rep").join(final, classes.rep == final.node, "left").select(
        *same, F.coalesce("component", "rep").alias("component")
    )
    return sketches.join(named, same, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
