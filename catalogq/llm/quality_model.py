"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Three word sequences are read: the words, their shapes (case, symbols, punctuation, length,
whether the word repeats the last one or stands in a repeated run of three words), and the
shapes without length. Runs of one and two words of each are hashed into 2^18 places; a text
is the vector of their counts scaled to length one, and its score the logistic function of a
sparse dot product with the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.llm.samples import fold, sampled_texts
from catalogq.llm.textbatch import lowered, mix, small_batches, span_hashes, split_words, text_bytes, window_hashes

FOLDS, HELD_OUT = 5, 0
TRAIN_ROWS, TRAIN_BYTES = 8_000, 28 << 20  # bounds of the training sample, in whole texts and in bytes of them
PLACES = 1 << 18
CHUNK = 200  # training texts turned into vectors at a time
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
CUT = 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>=@^~_\\{}[]+/")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small code per word from the kinds of bytes in it."""
    code = np.zeros(len(starts), np.uint64)
    for bit, kind in enumerate((_SYMBOL, _SHOUT, _STOP, _UPPER, _LOWER, _DIGIT)):
        held = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=held[1:])
        code |= (held[ends] > held[starts]).astype(np.uint64) << np.uint64(bit)
    return code


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, value) of all nonzero entries, in order of text and place."""
    data, offsets = text_bytes(texts)
    words = split_words(data, offsets)
    n = len(words.starts)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    plain = span_hashes(lowered(data), words.starts, words.ends)
    shape = _shapes(data, words.starts, words.ends)
    again = np.zeros(n, bool)
    again[1:] = (plain[1:] == plain[:-1]) & (owner[1:] == owner[:-1])
    repeated = np.zeros(n, bool)
    if n > 2:
        inside = np.flatnonzero(owner[2:] == owner[:-2])  # runs that cross into the next text don't count
        runs = mix(window_hashes(plain, 3) + owner[:-2].astype(np.uint64))[inside]
        _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
        repeated[inside] = count[which] > 1
    shape |= again.astype(np.uint64) << np.uint64(6) | repeated.astype(np.uint64) << np.uint64(7)
    length = np.minimum((words.ends - words.starts) // 3, 8).astype(np.uint64)
    sequences = (plain, mix(shape + np.uint64(1 << 20)), mix(shape + (length << np.uint64(10)) + np.uint64(1 << 21)))
    found, owners = [], []
    for tokens in sequences:
        found.append(tokens)
        owners.append(owner)
        if n > 1:
            found.append(window_hashes(tokens, 2)[owner[1:] == owner[:-1]])
            owners.append(owner[:-1][owner[1:] == owner[:-1]])
    place = (np.concatenate(found) % np.uint64(PLACES)).astype(np.int64)
    entries, counts = np.unique(np.concatenate(owners).astype(np.int64) * PLACES + place, return_counts=True)
    rows, places = entries // PLACES, entries % PLACES
    norm = np.sqrt(np.bincount(rows, counts.astype(float) ** 2, len(offsets) - 1))
    return rows, places, counts / norm[rows] if len(rows) else counts.astype(float)


def train(texts: list, labels: list) -> tuple[np.ndarray, float]:
    """Weights and bias after PASSES passes of FTRL-proximal updates, one text at a time."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)  # the last place is the bias

    def weights(at):
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    parts = []
    for at in range(0, len(texts), CHUNK):
        rows, places, values = vectors(pa.array(texts[at : at + CHUNK], pa.large_string()))
        parts.append((rows.astype(np.int32) + np.int32(at), places.astype(np.int32), values.astype(np.float32)))
    rows, places, values = map(np.concatenate, zip(*parts))
    del parts
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        for i in order.permutation(len(texts)):
            at = np.append(places[bounds[i] : bounds[i + 1]], PLACES)
            x = np.append(values[bounds[i] : bounds[i + 1]], 1.0)
            w = weights(at)
            error = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50))) - labels[i]
            g = error * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(np.arange(PLACES + 1))
    return final[:-1], float(final[-1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on at most TRAIN_ROWS labelled texts outside the held-out fold.

    Of several labels of a document the worst counts; null labels and ids are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = sampled_texts(docs, known, TRAIN_ROWS, TRAIN_BYTES)
    if not rows:
        return np.zeros(PLACES), 0.0
    return train([r["text"] or "" for r in rows], [int(r["quality"] >= 1) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts get the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights

    def apply(batches):
        weights, bias = shared.value
        for batch in batches:
            rows, places, values = vectors(batch.column(1))
            total = np.bincount(rows, weights[places] * values, batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -50, 50))))], ["doc_id", "score"]
            )

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(apply, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    Null and empty texts get the model's bias; repeated rows come out as often as they stand, all
    alike, and an id counts once in training; without labelled rows every score is 0.5; an empty
    table gives no rows; other columns are not read.
    """
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (fold(FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
