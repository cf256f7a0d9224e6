"""Toxicity by non-negative positive-unlabelled learning.

A text's features are its distinct words and word beginnings (64-bit hashes, so none collide).
Confirmed toxic texts (P) are set against unlabelled ones (U): features clearly more frequent
in P are kept, and a linear model on them is trained in numpy on the risk
    prior * R(P, toxic) + max(0, R(U, clean) - prior * R(P, clean)),
whose second term is the risk on clean text, corrected for the toxic share (the class prior) of
U and held at zero or above. The score is the logistic function of the sum of the weights.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.llm.samples import fold, sampled_texts
from catalogq.llm.textbatch import lowered, mix, small_batches, span_hashes, split_words, text_bytes

FOLDS, HELD_OUT = 4, 2
# Bounds of the training sample, in whole texts and in bytes of them.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 8_000
POSITIVE_BYTES, UNLABELLED_BYTES = 12 << 20, 24 << 20
CHUNK = 250  # training texts whose features are made at a time
BEGINNINGS = (4, 5, 6)  # bytes
LEAST_ROWS, LEAST_LIFT, SURPRISE, MOST_FEATURES = 4, 6.0, 5.0, 8_192  # SURPRISE in standard errors
STEPS, RATE, SHRINK = 400, 0.05, 1e-4
CUT = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and word beginning; features may repeat."""
    data, offsets = text_bytes(texts)
    data = lowered(data)
    words = split_words(data, offsets, ~_LETTER[data])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    found, owners = [span_hashes(data, words.starts, words.ends)], [owner]
    for size in BEGINNINGS:
        longer = words.ends - words.starts > size
        starts = words.starts[longer]
        found.append(mix(span_hashes(data, starts, starts + size) + np.uint64(size)))
        owners.append(owner[longer])
    return np.concatenate(owners), np.concatenate(found)


class Lookup:
    """Places of hashes in a sorted table; a bitmap settles most of those that aren't there."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, np.zeros(1 << 20, bool)
        self.bits[table >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are in the table, their places)."""
        if not len(self.table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.table, hashes[maybe]), len(self.table) - 1)
        hit = self.table[place] == hashes[maybe]
        return maybe[hit], place[hit]


def _presence(texts: list, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, place of a feature)."""
    parts = [np.zeros(0, np.int64)]
    for at in range(0, len(texts), CHUNK):
        owner, found = features(pa.array(texts[at : at + CHUNK], pa.large_string()))
        which, place = lookup.find(found)
        parts.append(np.unique((owner[which] + at) * np.int64(len(lookup.table) + 1) + place))
    pairs = np.concatenate(parts)
    return pairs // (len(lookup.table) + 1), pairs % (len(lookup.table) + 1)


def _frequent(positive: list, unlabelled: list, prior: float) -> np.ndarray:
    """Features in at least LEAST_ROWS positive texts and LEAST_LIFT times as frequent there as in U.

    A feature of toxic texts only is 1 / prior times as frequent, so half of that is enough.
    """

    def rows_with(texts: list) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.zeros(0, np.uint64)]
        for at in range(0, len(texts), CHUNK):
            owner, found = features(pa.array(texts[at : at + CHUNK], pa.large_string()))
            order = np.lexsort((owner, found))
            owner, found = owner[order], found[order]
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            parts.append(found[fresh])
        return np.unique(np.concatenate(parts), return_counts=True)

    names, in_p = rows_with(positive)
    names, in_p = names[in_p >= LEAST_ROWS], in_p[in_p >= LEAST_ROWS]
    others, in_u = rows_with(unlabelled)
    place = np.minimum(np.searchsorted(others, names), max(len(others) - 1, 0))
    seen = np.where(others[place] == names, in_u[place], 0) if len(others) else np.zeros(len(names), int)
    lift = (in_p / len(positive)) / ((seen + 1) / (len(unlabelled) + 1))
    usual = (seen + 1) * len(positive) / (len(unlabelled) + 1)
    chosen = np.flatnonzero((lift >= min(LEAST_LIFT, 0.5 / prior)) & (in_p >= usual + SURPRISE * np.sqrt(usual)))
    return np.sort(names[chosen[np.argsort(-in_p[chosen], kind="stable")[:MOST_FEATURES]]])


def train(positive: list, unlabelled: list, prior: float) -> Model:
    """The model for texts of both kinds and the share of toxic texts among the unlabelled."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    lookup = Lookup(_frequent(positive, unlabelled, prior))
    sets = [(*_presence(texts, lookup), len(texts)) for texts in (positive, unlabelled)]
    size = len(lookup.table) + 1  # the last weight is the bias
    weights, moment, square = np.zeros(size), np.zeros(size), np.zeros(size)

    def sums(rows, places, n, w):
        return np.bincount(rows, w[places], n) + w[-1]

    def slope(rows, places, n, pull):
        out = np.bincount(places, pull[rows], size).astype(float)
        out[-1] = pull.sum()
        return out

    for step in range(1, STEPS + 1):
        (rp, pp, np_), (ru, pu, nu) = sets
        toxic_p, toxic_u = (1 / (1 + np.exp(-sums(*s, weights))) for s in sets)
        # Logistic loss: its slope is p - 1 for "toxic" and p for "clean".
        clean_risk = np.log1p(np.exp(sums(ru, pu, nu, weights))).mean() - prior * np.log1p(
            np.exp(sums(rp, pp, np_, weights))
        ).mean()
        gradient = prior * slope(rp, pp, np_, (toxic_p - 1) / np_)
        corrected = slope(ru, pu, nu, toxic_u / nu) - prior * slope(rp, pp, np_, toxic_p / np_)
        gradient = gradient + corrected if clean_risk >= 0 else -corrected
        gradient[:-1] += SHRINK * weights[:-1]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights = weights - RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(lookup.table, weights[:-1], float(weights[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most POSITIVE_ROWS confirmed toxic and UNLABELLED_ROWS other texts outside the held-out fold.

    The prior is the share of toxic rows among the labels of the training folds. A document
    with several labels is toxic if any says so; null labels and ids are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    confirmed = known.where("toxic >= 1").select("doc_id")
    positive = [r["text"] for r in sampled_texts(docs, confirmed, POSITIVE_ROWS, POSITIVE_BYTES) if r["text"]]
    others = docs.where(F.col("doc_id").isNotNull() & (fold(FOLDS) != HELD_OUT)).select("doc_id")
    unlabelled = [r["text"] for r in sampled_texts(docs, others, UNLABELLED_ROWS, UNLABELLED_BYTES)]
    prior = (counts["toxic"] or 0) / counts["n"] if counts["n"] else 0.0
    return train(positive, [t or "" for t in unlabelled], min(max(prior, 1e-4), 0.9))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts get the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def apply(batches):
        model = shared.value
        lookup = Lookup(model.features)
        for batch in batches:
            owner, found = features(batch.column(1))
            which, place = lookup.find(found)
            pairs = np.unique(owner[which] * np.int64(len(model.features) + 1) + place)
            rows, place = pairs // (len(model.features) + 1), pairs % (len(model.features) + 1)
            total = np.bincount(rows, model.weights[place], batch.num_rows) + model.bias
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -50, 50))))], ["doc_id", "score"]
            )

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(apply, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    Null and empty texts get the model's bias; repeated rows come out as often as they stand, all
    alike, and an id counts once in training; without labelled rows every score is the same low
    one; an empty table gives no rows; other columns are not read. MOST_FEATURES bounds the model.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        (fold(FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
