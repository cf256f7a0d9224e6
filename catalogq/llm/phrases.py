"""Phrases of two to four words that belong together, mined per language by top-order marginalisation.

Only the longest windows are counted: each word occurrence gives one window, the word and its
three leads inside the piece, padded where the piece ends. Spark's ROLLUP over the window's
columns then sums the counts of all shorter prefixes, which are the counts of all shorter
phrases, so no shorter n-grams are exploded. All counts and scores are exact integers.

Windows are shortened where that can't change a count of LEAST or more: no phrase across a pair
or triple of neighbours that occurs less often can be frequent. Which ones may be frequent is
told by a bitmap of fixed size (BITS), set from counts of their hashes, triples only where both
pairs may be frequent; a shared bit only leaves a window longer than needed. So the bitmap saves
shuffled rows and is nothing that the results depend on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep
from catalogq.llm.textbatch import (
    byte_ranges,
    lowered,
    mix,
    small_batches,
    spaced_words,
    span_hashes,
    split_words,
    text_bytes,
    window_hashes,
)
from catalogq.operators.topk import top_per_group

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words
TOP = 2000  # phrases of each language
ABSORBED = 80  # per cent of a phrase's occurrences that lie in one longer candidate
BITS = 26  # the bitmap has 2^BITS bits, 8 MB
RUNS_HELD = 1 << 21  # hashes that a task sorts at a time
WINDOWS_OUT = 1 << 17  # windows that a task hands over at a time

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Batch:
    """The words of a batch of (lang, text), and which runs of them lie inside a piece and may be frequent."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(0)
        data, offsets = text_bytes(batch.column(1))
        data = lowered(data)
        self.gap = _GAP[data]
        self.words = split_words(data, offsets, self.gap)
        self.count = len(self.words.starts)
        self.owner = np.repeat(np.arange(batch.num_rows), np.diff(self.words.first))
        # Words with the same number of breaks before them, in the same text, share a piece.
        piece = np.searchsorted(np.flatnonzero(_BREAK[data]), self.words.starts)
        self.joined = (piece[1:] == piece[:-1]) & (self.owner[1:] == self.owner[:-1])
        names = self.langs.dictionary_encode()
        salts = np.array([_salt(x) for x in names.dictionary.to_pylist()], np.uint64)
        self.salt = salts[names.indices.to_numpy(zero_copy_only=False)][self.owner] if self.count else np.zeros(0, np.uint64)
        self.hashes = span_hashes(data, self.words.starts, self.words.ends)

    def runs(self, size: int) -> np.ndarray:
        """A hash of each run of so many words, by its first word."""
        n = max(self.count - size + 1, 0)
        return mix(window_hashes(self.hashes, size) + self.salt[:n] + np.uint64(size))

    def together(self, size: int, bits: np.ndarray | None, asked: int) -> np.ndarray:
        """Which runs of so many words lie in a piece, with all their runs of 2 to asked words set in the bitmap."""
        good = self.joined
        for length in range(2, size + 1):
            if length > 2:
                good = good[:-1] & good[1:]
            if length <= asked:
                good = good & _bits_set(bits, self.runs(length))
        return good


def _bits_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _run_batches(
    batches: Iterator[pa.RecordBatch], size: int, bits: np.ndarray | None, most: int
) -> Iterator[pa.RecordBatch]:
    """(hash, n) of runs of so many words whose shorter runs may be frequent; each hash once per most runs or so."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "n"])

    for batch in batches:
        read = _Batch(batch)
        if read.count >= size:
            held.append(read.runs(size)[read.together(size, bits, size - 1)])
        if sum(map(len, held)) >= most:
            yield flush()
    if any(map(len, held)):
        yield flush()


def _window_batches(
    batches: Iterator[pa.RecordBatch], bits: np.ndarray, longest: int, most: int
) -> Iterator[pa.RecordBatch]:
    """(lang, window) of every word, at most so many at a time: the words from it on that the piece and the bitmap leave."""
    for batch in batches:
        read = _Batch(batch)
        if not read.count:
            continue
        last = np.arange(read.count)
        for size in range(2, min(longest, read.count) + 1):
            good = read.together(size, bits, longest - 1)
            last[: len(good)] += good
        data, starts, ends = spaced_words(read.words, read.gap)
        for at in range(0, read.count, most):
            part = slice(at, at + most)
            yield pa.RecordBatch.from_arrays(
                [read.langs.take(pa.array(read.owner[part])), byte_ranges(data, starts[part], ends[last[part]])],
                ["lang", "window"],
            )


def _bitmap(runs: DataFrame, least: int) -> np.ndarray:
    """The bits of all hashes that occur often enough; at most 2^(BITS - 6) longs come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITS)
    often = runs.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - BITS}) & 63))")
    lanes = often.select(F.shiftright(place, 6).alias("lane"), bit.alias("bit"))
    found = lanes.groupBy("lane").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["lane"].to_numpy()] = found["bits"].to_numpy()
    return out.astype("<i8").view(np.uint8)


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, f): all phrases of up to longest words found at least so often.

    size 0 holds the number of all word occurrences of each language. docs has lang and text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    small_batches(spark)
    held, most = RUNS_HELD, WINDOWS_OUT
    bits = spark.sparkContext.broadcast(np.zeros(1 << (BITS - 3), np.uint8))
    for size in range(2, longest):
        known = bits

        def runs(batches: Iterator[pa.RecordBatch], size=size, known=known) -> Iterator[pa.RecordBatch]:
            return _run_batches(batches, size, known.value, held)

        bits = spark.sparkContext.broadcast(known.value | _bitmap(texts.mapInArrow(runs, "hash long, n long"), least))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _window_batches(batches, bits.value, longest, most)

    each = texts.mapInArrow(windows, "lang string, window string")
    longest_only = each.groupBy("lang", "window").agg(F.count("*").alias("n"))
    columns = [f"w{i}" for i in range(1, longest + 1)]
    word = lambda i: F.coalesce(F.try_element_at(F.split("window", " "), F.lit(i)), F.lit(""))
    padded = longest_only.select("lang", *[word(i + 1).alias(c) for i, c in enumerate(columns)], "n")
    sums = padded.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    # So many columns are rolled up that this many words are left; -1 is the total over all languages.
    left = F.lit(longest) - F.bit_count("rolled").cast("int")
    last = F.get(F.array(F.lit("-"), *columns), F.col("size"))
    phrase = F.array_join(F.slice(F.array(*columns), F.lit(1), F.col("size")), " ")
    return (
        sums.withColumn("size", left)
        .where("size = 0 or size > 0 and f >= " + str(int(least)))
        .where(last != "")
        .select("lang", "size", phrase.alias("phrase"), "f")
    )


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, length), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorbed: int = ABSORBED, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    A null lang is "und", a null text empty; texts without words and empty tables add nothing.
    Repeated rows count as often as they stand. Equal scores are told apart by a, then by the
    phrase's bytes, which are unique, so ranks have no ties. Other columns are not read.
    """
    frequent = keep(counts(docs, least, longest), "phrases")
    words = F.split("phrase", " ")
    known = frequent.where("size > 0").select("lang", "phrase", "f")
    candidates = frequent.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("words"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        _part(F.col("words"), 1, F.col("k")).alias("first"),
        _part(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # Decimals: the product may pass 64 bits.
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length")
    longer = candidates.where("size > 2").select("lang", "size", "words", "a", inner)
    longer = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("at"))
    holders = longer.groupBy("lang", _part(F.col("words"), F.col("at"), F.col("length")).alias("phrase")).agg(
        F.max("a").alias("longer")
    )
    free = scored.join(holders, ["lang", "phrase"], "left").where(
        F.expr(f"longer is null or cast(100 as decimal(3, 0)) * longer < cast({int(absorbed)} as decimal(5, 0)) * a")
    )
    flat = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = top_per_group(flat, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, rank="rank")
    totals = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
