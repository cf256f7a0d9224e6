"""SentencePiece encoding and decoding of whole texts.

A text becomes a mark for each space, with one in front, and is cut into words where no piece can
reach across: before a run of marks, and around characters that are in no longer piece. The
best cut of a word into pieces is found on its lattice: its substrings up to the longest piece
are the candidates, an equi-join with the piece table leaves the edges, edges are grouped by
word, and a Viterbi fold over the edges keeps the best score of each position (of equal ones the
one whose last piece is longest). A character without piece is an edge of bytes.

The words that make up most of a corpus, at most FREQUENT of them, go through the lattice once
as a Spark job: explode, equi-join, group, aggregate. Their pieces, a table of bounded size,
are sent to the tasks that encode the texts. Rarer words meet the same lattice in the task that
has them, as arrays over all new words of a batch. See the README for why they aren't joined.

The scores of the piece file are used as they are, so the result is the best-scoring cut, also
for a file made by merging, whose own encoder can choose other pieces. Decoding the ids gives
the text back exactly, but for U+2581, which is the space mark.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep
from catalogq.llm.textbatch import list_column, mix, small_batches

MARK = "▁"
FREQUENT = 1 << 17  # words encoded ahead of the texts
MOST_PIECES = 1 << 20  # a larger piece table isn't broadcast
LONGEST_FREQUENT = 64  # characters
COUNTED = 300_000  # words counted before a task passes its counts on
REMEMBERED = 400_000  # rare words a task keeps
PENALTY = 10.0  # of a character without piece, below the worst score


class Pieces(NamedTuple):
    texts: list  # by id; byte pieces and pieces never chosen are None
    scores: list
    bytes: list  # 256 ids of byte pieces, or empty
    unknown: int

    @property
    def normal(self) -> dict:
        return {t: i for i, t in enumerate(self.texts) if t is not None}

    @property
    def worst(self) -> float:
        return min((s for t, s in zip(self.texts, self.scores) if t is not None), default=0.0) - PENALTY


def load_pieces(path: str) -> Pieces:
    """Read a SentencePiece model file (on the driver)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    texts = [None if odd(i) else model.id_to_piece(i) for i in ids]
    if any(MARK in t.lstrip(MARK) for t in texts if t):
        raise ValueError("a piece has a space mark after another character")
    names = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    byte_ids = [names[f"<0x{b:02X}>"] for b in range(256)] if len(names) == 256 else []
    return Pieces(texts, [model.get_score(i) for i in ids], byte_ids, model.unk_id())


def word_pattern(pieces: Pieces) -> re.Pattern:
    """Words of a marked text: marks with the characters of longer pieces, or any other character alone."""
    joined = sorted({c for t in pieces.normal if len(t) > 1 for c in t} - {MARK})
    letters = "".join(map(re.escape, joined)) or "\\uFFFF"
    return re.compile(f"{MARK}*[{letters}]+|{MARK}+|.", re.S)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def fallback(pieces: Pieces, character: str) -> list:
    """The ids of a character without piece."""
    return [pieces.bytes[b] for b in character.encode()] if pieces.bytes else [pieces.unknown]


# The lattice as a Spark job


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    rows = [(t, float(pieces.scores[i]), i) for t, i in pieces.normal.items()]
    if len(rows) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    return spark.createDataFrame(rows, "piece string, score double, id int")


def _viterbi(edges: Column, length: Column) -> Column:
    """Ids of the best path over edges (stop, start, score, ids), sorted; every place has an edge into it."""
    kind = "array<struct<score:double,start:int,ids:array<int>>>"
    first = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.array().cast("array<int>").alias("ids"))

    def step(best: Column, e: Column) -> Column:
        found = F.struct(
            (F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["ids"].alias("ids")
        )
        known = F.size(best) > e["stop"]
        better = found["score"] > F.get(best, e["stop"])["score"]
        return (
            F.when(~known, F.concat(best, F.array(found)))
            .when(better, F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(found)))
            .otherwise(best)
        )

    def back(best: Column) -> Column:
        start = F.struct(length.cast("int").alias("at"), F.array().cast("array<int>").alias("ids"))

        def walk(s: Column, place: Column) -> Column:
            edge = F.get(best, place)
            here = s["at"] == place
            return F.struct(
                F.when(here, edge["start"]).otherwise(s["at"]).alias("at"),
                F.when(here, F.concat(edge["ids"], s["ids"])).otherwise(s["ids"]).alias("ids"),
            )

        return F.aggregate(F.sequence(length, F.lit(1), F.lit(-1)), start, walk, lambda s: s["ids"])

    return F.aggregate(edges, F.array(first).cast(kind), step, back)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) for a table of distinct, non-empty words."""
    table = piece_table(words.sparkSession, pieces)
    longest = max(map(len, pieces.normal), default=1)
    start = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("begin")
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("begin") + 1))
    parts = words.select("word", start).select("word", "begin", F.explode(lengths).alias("size"))
    parts = parts.withColumn("piece", F.substr("word", "begin", "size"))
    # A piece table of checked size. Single characters stay without piece, as edges of bytes.
    joined = parts.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    if pieces.bytes:
        code = F.transform(
            F.sequence(F.lit(1), F.octet_length("piece")),
            lambda i: F.conv(F.substr(F.hex(F.encode("piece", "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("int"),
        )
        table_of_bytes = F.array(*[F.lit(i) for i in pieces.bytes])
        spare = F.transform(code, lambda b: F.get(table_of_bytes, b))
    else:
        spare = F.array(F.lit(pieces.unknown))
    edge = F.struct(
        (F.col("begin") + F.col("size") - 1).alias("stop"),
        (F.col("begin") - 1).alias("start"),
        F.coalesce("score", F.lit(pieces.worst)).alias("score"),
        F.when(F.col("id").isNull(), spare).otherwise(F.array("id")).alias("ids"),
    )
    edges = joined.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return edges.select("word", _viterbi(F.col("edges"), F.length("word")).alias("ids"))


# The lattice over arrays, for the words of a batch


class Lattice:
    """Viterbi over all words of a list at once, with the same edges and choices as encode_words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.tables = []
        by_size: dict[int, list] = {}
        for text, i in pieces.normal.items():
            by_size.setdefault(len(text), []).append((text, i))
        for size in range(1, max(by_size, default=1) + 1):
            rows = by_size.get(size, [])
            codes = np.array([[ord(c) for c in t] for t, _ in rows], np.uint64).reshape(len(rows), size)
            hashes = np.zeros(len(rows), np.uint64)
            for k in range(size):
                hashes = mix(hashes + codes[:, k] + np.uint64(1))
            order = np.argsort(hashes)
            ids = np.array([i for _, i in rows], np.int64)[order]
            scores = np.array([pieces.scores[i] for i in ids], float)
            bits = np.zeros(1 << 18, bool)
            bits[hashes >> np.uint64(46)] = True
            self.tables.append((hashes[order], ids, scores, bits))

    def encode(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each word)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        last = np.repeat(ends, sizes)  # where the word of each character ends
        base = np.repeat(ends - sizes, sizes)
        starts, stops, ids, scores = [], [], [], []
        hashes = np.zeros(len(codes), np.uint64)
        place = np.arange(len(codes))
        for size, (table, table_ids, table_scores, bits) in enumerate(self.tables, 1):
            inside = place + size <= last[place]
            place, hashes = place[inside], hashes[inside]
            if not len(place):
                break
            hashes = mix(hashes + codes[place + size - 1] + np.uint64(1))
            maybe = np.flatnonzero(bits[hashes >> np.uint64(46)])
            hit = np.zeros(len(place), bool)
            if len(table) and len(maybe):
                at = np.minimum(np.searchsorted(table, hashes[maybe]), len(table) - 1)
                good = table[at] == hashes[maybe]
                at, found = at[good], maybe[good]
                hit[found] = True
                starts.append(place[found])
                stops.append(place[found] + size)
                ids.append(table_ids[at])
                scores.append(table_scores[at])
            if size == 1:
                spare = place[~hit]
                starts.append(spare)
                stops.append(spare + 1)
                ids.append(np.full(len(spare), -1))
                scores.append(np.full(len(spare), self.pieces.worst))
        start, stop, piece, score = map(np.concatenate, (starts, stops, ids, scores))
        # Edges by the place in the word where they end; of equal paths the earliest start wins.
        depth = stop - base[start]
        # Sorted by (depth, stop, start): runs of one piece size are in order already, and few depths repeat.
        order = np.argsort(stop * 4096 - (stop - start), kind="stable")
        few = depth.max() < 1 << 16
        order = order[np.argsort(depth[order].astype(np.uint16 if few else np.int64), kind="stable")]
        start, stop, piece, score, depth = (x[order] for x in (start, stop, piece, score, depth))
        best = np.zeros(len(codes) + 1)  # best score of the part of a word before a place; 0 at its start
        chosen = np.zeros(len(codes) + 1, np.int64)  # the edge into a place
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(depth)]):
            s, e = start[low:high], stop[low:high]
            begins = s == base[s]
            total = np.where(begins, 0.0, best[s]) + score[low:high]
            first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            top = np.maximum.reduceat(total, first)
            winner = np.flatnonzero(total == np.repeat(top, np.diff(np.r_[first, len(e)])))
            target = e[winner]
            keep_first = np.r_[True, target[1:] != target[:-1]]
            best[target[keep_first]] = top
            chosen[target[keep_first]] = winner[keep_first] + low
        # Back from the ends of all words at once; each step takes the last piece of what is left.
        place, number = ends.copy(), np.arange(len(words))
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(number):
            edge = chosen[place]
            place = start[edge]
            steps.append((number, piece[edge], place))
            more = place > (ends - sizes)[number]
            place, number = place[more], number[more]
        owner, taken, begin = (np.concatenate(x)[::-1] for x in zip(*steps))
        order = np.argsort(owner, kind="stable")
        owner, taken, begin = owner[order], taken[order], begin[order]
        spare = np.flatnonzero(taken < 0)
        if not len(spare):
            return taken.astype(np.int32), np.bincount(owner, minlength=len(words))
        lists = [fallback(self.pieces, chr(int(codes[i]))) for i in begin[spare]]
        counts = np.ones(len(taken), np.int64)
        counts[spare] = [len(x) for x in lists]
        flat = np.repeat(taken, counts)
        flat[flat < 0] = [i for x in lists for i in x]
        return flat.astype(np.int32), np.bincount(owner, counts, len(words)).astype(np.int64)

    def encode_lists(self, words: list) -> list:
        """The ids of each word, as lists."""
        flat, counts = self.encode(words)
        bounds = np.cumsum([0, *counts])
        return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


# Texts


class WordStore:
    """Ids by word: the frequent words, and as many rare ones as fit."""

    def __init__(self, pieces: Pieces, words: list, ids: list):
        self.lattice, self.words, self.ids = Lattice(pieces), words, ids
        self.reset()

    def reset(self) -> None:
        self.known = {w: i for i, w in enumerate(self.words)}
        self.counts = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        self.ends = np.cumsum(self.counts)
        self.flat = np.fromiter(chain.from_iterable(self.ids), np.int32, int(self.counts.sum()))

    def extend(self, fresh: list) -> None:
        flat, counts = self.lattice.encode(fresh)
        self.known.update(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh))))
        self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(counts)])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text) for lists of words."""
        if len(self.known) > len(self.words) + REMEMBERED:
            self.reset()
        fresh = set(chain.from_iterable(texts)).difference(self.known)
        if fresh:
            self.extend(list(fresh))
        sizes = [len(t) for t in texts]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        counts = self.counts[at]
        total = np.cumsum(counts)
        places = np.repeat(self.ends[at] - total, counts) + np.arange(int(total[-1]) if len(total) else 0)
        return self.flat[places], np.diff(np.concatenate([[0], total])[np.cumsum([0, *sizes])])


def _counts(words_of):
    def apply(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(words_of(marked(text)))
            if len(seen) > COUNTED:
                yield _counted(seen)
                seen = Counter()
        if seen:
            yield _counted(seen)

    return apply


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
    )


def frequent_words(docs: DataFrame, pieces: Pieces, most: int = FREQUENT) -> DataFrame:
    """(word): the words of all texts that occur at least so often that no more than `most` do.

    Counted over the whole table, with one partial count per task.
    """
    pattern = word_pattern(pieces).pattern
    small_batches(docs.sparkSession)
    words_of = lambda text: re.findall(pattern, text, re.S)
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_counts(words_of), "word string, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).where(
        (F.col("n") > 1) & (F.length("word") <= LONGEST_FREQUENT)
    )
    counted = keep(counted, "words")
    # One row per count that occurs, few of which lie above the cut.
    levels = counted.groupBy("n").agg(F.count("*").alias("words"))
    cut, room = None, most
    for row in levels.orderBy(F.desc("n")).limit(most).toLocalIterator():
        room -= row["words"]
        if room < 0:
            break
        cut = row["n"]
    return counted.where(F.col("n") >= cut if cut is not None else F.lit(False)).select("word")


def encode_texts(docs: DataFrame, pieces: Pieces, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns, ids, n_ids and round_trip of every row of docs (with text).

    A null or empty text has no ids. round_trip says whether decoding the ids gave the text back.
    """
    spark = docs.sparkSession
    rows = encode_words(frequent_words(docs, pieces), pieces).collect()  # at most FREQUENT short words
    words, ids = [r["word"] for r in rows], [r["ids"] for r in rows]
    shared = spark.sparkContext.broadcast((pieces, words, ids))

    def apply(batches):
        pieces, words, ids = shared.value
        store, decoder, words_of = WordStore(pieces, words, ids), Decoder(pieces), word_pattern(pieces).findall
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            flat, counts = store.encode([words_of(marked(t or "")) for t in texts])
            back = decoder.decode(flat, counts)
            whole = [(t or "") == b for t, b in zip(texts, back)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    list_column(flat, counts, pa.int32()),
                    pa.array(counts, pa.int64()),
                    pa.array(whole),
                ],
                [*columns, "ids", "n_ids", "round_trip"],
            )

    small_batches(spark)
    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(apply, f"{kinds}, ids array<int>, n_ids long, round_trip boolean")


class Decoder:
    """Texts from ids: the bytes of the pieces in a row, marks as spaces, without the first one."""

    def __init__(self, pieces: Pieces):
        parts = [b"" if t is None else t.replace(MARK, " ").encode() for t in pieces.texts]
        for value, i in enumerate(pieces.bytes):
            parts[i] = bytes([value])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list:
        """The texts of lists of ids, given in a row with their lengths; broken bytes become U+FFFD."""
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        data = self.flat[np.repeat(self.ends[ids] - total, sizes) + np.arange(int(total[-1]) if len(total) else 0)]
        data, bounds = data.tobytes(), np.concatenate([[0], total])[np.cumsum([0, *counts])].tolist()
        return [data[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(bounds, bounds[1:])]


def decode_texts(rows: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows with a column of id lists, and the text that they stand for; null lists give null."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    others = [c for c in rows.columns if c != text]

    def apply(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            counts = np.array([0 if x is None else len(x) for x in lists.to_pylist()], np.int64)
            flat = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decoder.decode(flat, counts)
            texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*others, text])

    small_batches(spark)
    plain = rows.select(*others, F.col(ids).alias("_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(apply, f"{kinds}, `{text}` string")
