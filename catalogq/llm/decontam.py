"""Benchmark passages in documents, also where numbers, names or units were exchanged.

A text is read in three ways: as plain words (without case and punctuation), and twice as a
template, in which numbers, names and units become typed placeholders; a capital that opens a
sentence makes a name in one of the two only. A run of names or of numbers is one placeholder,
so values may change their number of words. In scripts written without spaces each character is
a word. Windows of WINDOW words or placeholders are
hash-joined with those of the benchmark; an item shorter than that is one window of its length, and
one shorter than two windows has windows of LEAST_WORDS too. An item under LEAST_WORDS words has no
template that tells anything: it is searched whole, as plain words. Matched windows whose diagonals (position in
the document minus position in the item) follow each other within a few words are one stretch,
so words may be added or dropped inside a copy. A document holds an item if the matched windows
of a stretch cover at least COVER of the item's words and the slots agree: plain windows alone
reach COVER, or AGREE of the slots are unchanged, or values that repeat in the item and names
stand for one value each (one, or 1 - AGREE of them, may clash), or nearly all of the item is
covered by many plain words. Re-parameterised copies thus match, while text that only shares a
template does not.

The tasks that read documents pass on only windows whose hash is in a bitmap of FILTER_BITS bits
made from the benchmark, so its size is fixed; the join decides.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep
from catalogq.llm.textbatch import (
    list_column,
    lowered,
    mix,
    small_batches,
    span_hashes,
    split_words,
    text_bytes,
    window_hashes,
)

WINDOW, LEAST_WORDS = 8, 5
COVER, AGREE = 0.6, 0.9
SLACK = 8  # words (or a quarter of the item) between the diagonals of one stretch
MANY, NEARLY = 20, 0.8  # plain words, and their share of the item, from which values need not agree
FILTER_BITS = 22

# Units as they follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz t ml l gal s sec min h hr hrs ms day days week weeks month months year years "
    "hour hours minute minutes second seconds % percent usd eur gbp dollar dollars euro euros cent cents pound pounds "
    "mile miles meter meters metre metres kilometer kilometers kilogram kilograms gram grams liter liters litre litres "
    "hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal mph kmh c f k"
).split()

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KEPT = np.zeros(256, bool)  # bytes that count in a word
_KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[128:] = True
_KEPT[ord("%")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
_NUMBER, _NAME, _UNIT = (np.uint64(k) for k in (11, 12, 13))
SLOT_KINDS = 3


# Scripts written without spaces, and the first bytes of their characters.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_UNSPACED_BYTE = np.zeros(256, bool)
_UNSPACED_BYTE[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True


@cache
def _capitals() -> np.ndarray:
    """Which code points are capitals, in any script that has them."""
    return np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x20000)])


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters whose UTF-8 begins at the places given; those of later planes as 0."""
    tail = [np.append(data, np.zeros(3, np.uint8))[at + k].astype(np.int64) & 63 for k in range(1, 4)]
    head = data[at].astype(np.int64)
    two = (head & 31) << 6 | tail[0]
    three = (head & 15) << 12 | tail[0] << 6 | tail[1]
    four = (head & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    point = np.where(head < 0xC0, head, np.where(head < 0xE0, two, np.where(head < 0xF0, three, four)))
    return np.where(point < 0x20000, point, 0)


def _spaced(texts: pa.Array) -> pa.Array:
    """The characters of scripts without spaces set apart, each as a word."""
    data, _ = text_bytes(texts)
    if not _UNSPACED_BYTE[data].any():
        return texts
    return pc.replace_substring_regex(texts.cast(pa.large_string()), _UNSPACED, r" \1 ")


def _unit_hashes() -> np.ndarray:
    data, offsets = text_bytes(pa.array(UNITS, pa.large_string()))
    words = split_words(data, offsets)
    return np.sort(span_hashes(data, words.starts, words.ends))


_UNITS = _unit_hashes()


class _Read(NamedTuple):
    value: np.ndarray  # hash of each word with letters or digits
    number: np.ndarray
    unit: np.ndarray
    capital: np.ndarray
    opening: np.ndarray  # the word opens a sentence
    owner: np.ndarray
    first: np.ndarray  # where each text's words begin


class _Stream(NamedTuple):
    token: np.ndarray  # hash of each word or placeholder
    kind: np.ndarray
    value: np.ndarray
    begin: np.ndarray  # the words of its text it stands for
    end: np.ndarray
    owner: np.ndarray
    first: np.ndarray


def _values(texts: pa.Array) -> np.ndarray:
    """The hash of each word with letters or digits, from the bytes that count."""
    data, offsets = text_bytes(texts)
    held = _KEPT[data]
    words = split_words(data, offsets)
    counted = np.zeros(len(data) + 1, np.int64)
    np.cumsum(held, out=counted[1:])
    starts, ends = counted[words.starts], counted[words.ends]
    real = ends > starts
    return span_hashes(lowered(data)[held], starts[real], ends[real])


def _folded(texts: pa.Array) -> pa.Array:
    """In lower case, also beyond ASCII; the capital of a sharp s is two letters."""
    return pc.replace_substring(pc.utf8_lower(texts.cast(pa.large_string())), "ß", "ss")


def _read(texts: pa.Array) -> _Read:
    texts = _spaced(texts)
    data, offsets = text_bytes(texts)
    # Words without the bytes that don't count: those are taken out before hashing.
    held = _KEPT[data]
    gap = _SPACE[data]
    words = split_words(data, offsets)
    counted = np.zeros(len(data) + 1, np.int64)
    np.cumsum(held, out=counted[1:])
    starts, ends = counted[words.starts], counted[words.ends]
    real = np.flatnonzero(ends > starts)
    value = _values(_folded(texts) if (data >= 128).any() else texts)
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_DIGIT[data], out=digits[1:])
    begin, end = words.starts[real], words.ends[real]
    number = digits[end] > digits[begin]
    # The first character that counts: a capital letter, unless a sentence begins here.
    places = np.flatnonzero(held)
    letter = places[starts[real]]
    capital = _capitals()[_code_points(data, letter)]
    owner = np.searchsorted(words.first, real, "right") - 1
    opening = np.ones(len(real), bool)
    if len(real) > 1:
        stops = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_STOP[data] | ((data == 10) & gap), out=stops[1:])
        inside = stops[begin[1:]] == stops[letter[:-1]]  # no stop between the last word's first letter and this word
        opening[1:] = ~inside | (owner[1:] != owner[:-1])
    unit = np.zeros(len(real), bool)
    if len(real):
        at = np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)
        known = _UNITS[at] == value
        unit[1:] = known[1:] & number[:-1] & (owner[1:] == owner[:-1])
    return _Read(value, number, unit, capital, opening, owner, np.searchsorted(owner, np.arange(len(offsets))))


def _typed(read: _Read, openings: bool) -> tuple[np.ndarray, np.ndarray]:
    """(template hash, kind) of each word; openings: a capital makes a name also where a sentence opens."""
    name = read.capital & ~read.number & (openings | ~read.opening)
    kind = np.where(read.number, 1, np.where(read.unit, 3, np.where(name, 2, 0)))
    template = np.where(
        read.number, _NUMBER, np.where(read.unit, _UNIT, np.where(name, _NAME, read.value))
    )
    return mix(template), kind


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, kind, value hash) per word with letters or digits, and where each text's words begin.

    kind is 0 for a plain word, 1 number, 2 name, 3 unit; value is the word's own hash.
    """
    read = _read(texts)
    return *_typed(read, False), read.value, read.first


def _streams(read: _Read) -> list[_Stream]:
    """The plain words, and the template words of both typings with runs of names or numbers as one."""
    n, texts = len(read.value), np.arange(len(read.first))
    at = np.arange(n) - read.first[read.owner]
    streams = [_Stream(mix(read.value), np.zeros(n, np.int64), read.value, at, at + 1, read.owner, read.first)]
    for openings in (False, True):
        template, kind = _typed(read, openings)
        head = np.ones(n, bool)
        head[1:] = (kind[1:] != kind[:-1]) | (read.owner[1:] != read.owner[:-1]) | ((kind[1:] != 1) & (kind[1:] != 2))
        heads = np.flatnonzero(head)
        run = np.cumsum(head) - 1
        inside = (np.arange(n) - heads[run]).astype(np.uint64) if n else read.value
        value = np.add.reduceat(mix(read.value + inside), heads) if n else read.value
        owner = read.owner[heads]
        size = np.diff(np.append(heads, n))
        streams.append(
            _Stream(template[heads], kind[heads], value, at[heads], at[heads] + size, owner, np.searchsorted(owner, texts))
        )
    return streams


def _window_batch(batch: pa.RecordBatch, sizes: list[int], whole: bool, bits: np.ndarray | None) -> pa.RecordBatch:
    """Windows of the given sizes with their slots; whole: only the sizes that a text of the benchmark is asked by.

    These are WINDOW, or a shorter text's own length; LEAST_WORDS besides for a text in which a
    word added in the middle leaves no window of WINDOW. Sizes under LEAST_WORDS are of plain words only.
    """
    read = _read(batch.column(1))
    words = np.diff(read.first)
    names = ("row", "at", "stop", "size", "exact", "hash", "counts", "places", "kinds", "slots")
    found: dict[str, list] = {k: [] for k in names}
    for number, stream in enumerate(_streams(read)):
        lengths = np.diff(stream.first)
        typed = np.flatnonzero(stream.kind)
        for size in sizes:
            if number and size < LEAST_WORDS:
                continue
            hashes = mix(window_hashes(stream.token, size) + np.uint64(size + 64 * number))
            n = len(hashes)
            if not n:
                continue
            good = stream.owner[:n] == stream.owner[size - 1 : size - 1 + n]
            if whole and size < WINDOW:
                short = lengths[stream.owner[:n]]
                good &= (short == size) | ((size == LEAST_WORDS) & (short < 2 * WINDOW))
            if bits is not None:
                good &= bits[hashes >> np.uint64(64 - FILTER_BITS)]
            at = np.flatnonzero(good)
            # The slots inside each window, in order; plain words give no entry.
            low, high = np.searchsorted(typed, at), np.searchsorted(typed, at + size)
            counts = high - low
            index = typed[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
            parts = (
                stream.owner[at], stream.begin[at], stream.end[at + size - 1], np.full(len(at), size),
                np.full(len(at), number == 0), hashes[at].view(np.int64), counts, stream.begin[index],
                stream.kind[index], stream.value[index].view(np.int64),
            )
            for k, part in zip(names, parts):
                found[k].append(part)
    out = {k: np.concatenate([np.zeros(0, bool if k == "exact" else np.int64), *v]) for k, v in found.items()}
    lists = [list_column(out[k], out["counts"], pa.int64()) for k in ("places", "kinds", "slots")]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(out["row"])),
            *[pa.array(out[k]) for k in ("at", "stop", "size")],
            pa.array(words[out["row"]]),
            pa.array(out["exact"]),
            pa.array(out["hash"]),
            *lists,
        ],
        ["id", "at", "stop", "size", "words", "exact", "hash", "places", "kinds", "slots"],
    )


_SCHEMA = (
    "id long, at long, stop long, size long, words long, exact boolean, hash long, places array<long>, "
    "kinds array<long>, slots array<long>"
)


def windows(texts: DataFrame, sizes: list[int], whole: bool = False, bits: np.ndarray | None = None) -> DataFrame:
    """All windows of (id, text): the words at to stop, and the places, kinds and values of their slots."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # a bitmap of fixed size

    def apply(batches):
        for batch in batches:
            yield _window_batch(batch, sizes, whole, shared.value)

    small_batches(texts.sparkSession)
    return texts.mapInArrow(apply, _SCHEMA)


def _covered(spans: Column) -> Column:
    """How many words sorted spans (item_at, item_stop) cover."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("covered"))
    fresh = lambda s, x: F.greatest(x["item_stop"] - F.greatest(s["end"], x["item_at"]), F.lit(0))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["item_stop"]).alias("end"), (s["covered"] + fresh(s, x)).alias("covered")
        ),
        lambda s: s["covered"],
    )


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which leading bits occur among the hashes; at most 2^FILTER_BITS places come back."""
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("top")
    bits = np.zeros(1 << FILTER_BITS, bool)
    places = hashes.select(top).distinct().toPandas()["top"].to_numpy()
    bits[places.astype(np.int64)] = True
    return bits


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, item_id, coverage, agreement) of each benchmark item of least words or more that a document holds.

    docs has doc_id and text, benchmark item_id and text. Null texts hold nothing, rows without
    an id are left out; repeated rows give one result.
    """
    items = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("long").alias("id"), F.col("text").cast("string")
    )
    sizes = list(range(least, WINDOW + 1))
    asked = keep(windows(items, sizes, whole=True), "benchmark")
    present = sorted(r["size"] for r in asked.select("size").distinct().collect())
    if not present:
        return asked.select(
            F.col("id").alias("doc_id"), F.col("id").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("agreement")
        )
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")
    )
    seen = windows(texts, present, bits=_bitmap(asked))
    item = asked.select(
        "hash", "size", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("stop").alias("item_stop"),
        "words", "exact", "places", "kinds", F.col("slots").alias("item_slots"),
    )
    met = seen.select("hash", "size", F.col("id").alias("doc_id"), "at", "slots").join(item, ["hash", "size"])
    met = keep(met.withColumn("diagonal", F.col("at") - F.col("item_at")), "met")
    # Windows of one copy lie on diagonals that follow each other closely.
    pair = ["doc_id", "item_id"]
    order = Window.partitionBy(*pair).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.greatest(F.lit(SLACK), F.col("words") / 4)
    stretches = (
        met.select(*pair, "diagonal", "words").distinct()
        .withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
        .select(*pair, "diagonal", F.sum("apart").over(order).alias("stretch"))
    )
    one = [*pair, "stretch"]
    met = met.join(stretches, [*pair, "diagonal"])
    span = F.struct("item_at", "item_stop")
    coverage = (
        met.groupBy(*one)
        .agg(
            F.first("words").alias("words"),
            F.array_sort(F.collect_set(span)).alias("spans"),
            F.array_sort(F.collect_set(F.when(F.col("exact"), span))).alias("plain"),
        )
        .select(*one, "words", _covered(F.col("spans")).alias("covered"), (_covered(F.col("plain")) / F.col("words")).alias("exact"))
        .withColumn("coverage", F.col("covered") / F.col("words"))
        .where(F.col("coverage") >= COVER)
    )
    # Each slot of the item with the value that most windows set against it.
    slots = (
        met.join(coverage.select(*one), one, "left_semi")
        .select(*one, F.explode(F.arrays_zip("places", "kinds", "item_slots", "slots")).alias("s"))
        .groupBy(*one, "s.places", "s.kinds", "s.item_slots", "s.slots").agg(F.count("*").alias("n"))
        .groupBy(*one, "places")
        .agg(F.max(F.struct("n", "kinds", "item_slots", "slots")).alias("s"))
        .select(*one, "places", "s.kinds", "s.item_slots", "s.slots")
    )
    # Judged: what stands at several places of the item, and names of the document at several places.
    sides = [slots.withColumn("own", F.col("item_slots")).withColumn("other", F.col("slots")).withColumn("side", F.lit(0))]
    sides.append(
        slots.where("kinds = 2").withColumn("own", F.col("slots")).withColumn("other", F.col("item_slots")).withColumn("side", F.lit(1))
    )
    agreed = (
        sides[0].unionByName(sides[1]).groupBy(*one, "side", "own")
        .agg(F.count("*").alias("n"), F.count_distinct("other").alias("partners"))
        .groupBy(*one)
        .agg(
            F.count_if((F.col("n") > 1)).alias("judged"),
            F.count_if(F.col("partners") > 1).alias("clashes"),
        )
    )
    unchanged = slots.groupBy(*one).agg(
        F.avg(F.when(F.col("item_slots") == F.col("slots"), 1.0).otherwise(0.0)).alias("same"),
        F.count("*").alias("n_slots"),
    )
    steady = 1 - F.col("clashes") / F.greatest("judged", F.lit(1))
    plain = F.col("covered") - F.col("n_slots")
    judged = (
        # Without slots there is nothing to disagree on.
        coverage.join(agreed.join(unchanged, one), one, "left")
        .withColumn("agreement", F.coalesce(F.greatest(steady, "same"), F.lit(1.0)))
        .where(
            F.col("n_slots").isNull()
            | (F.col("exact") >= COVER)
            | (F.col("same") >= AGREE)
            | (F.col("clashes") <= F.greatest(F.lit(1), F.floor((1 - AGREE) * F.col("judged") + 1e-9)))
            | ((plain >= MANY) & (plain >= NEARLY * F.col("words")))
        )
    )
    return judged.groupBy("doc_id", "item_id").agg(
        F.max("coverage").alias("coverage"), F.max("agreement").alias("agreement")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item of LEAST_WORDS words or more, with all their columns.

    Fewer words stand in clean texts too.
    """
    # Written, so that the size of the list is known before it may be broadcast.
    found = keep(leaks(docs, benchmark, LEAST_WORDS).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
