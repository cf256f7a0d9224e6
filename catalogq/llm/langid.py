"""Language of whole texts by a convolutional network over bytes.

A text is read as windows of WINDOW bytes. Filters of several widths run over a window; the
largest response of each filter feeds a softmax over the languages. The network is trained in
numpy on a bounded sample of the texts of every language (Adam, gradients only at the largest responses);
scoring takes every window of a text and averages the windows' probabilities by their bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.llm.samples import bounded_each, fold, picked_texts
from catalogq.llm.textbatch import lowered, small_batches, text_bytes

FOLDS, HELD_OUT = 5, 0
WINDOW = 256  # bytes
WIDTHS, FILTERS = (2, 3, 4), 16
# Bounds of the training sample, shared alike by the languages; and of the languages, those with the most documents.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_WINDOWS, MOST_LANGUAGES = 3_000, 16 << 20, 8_000, 200
LEAST_ROWS, LEAST_WINDOWS = 100, 300  # of a language
PASSES, BATCH, RATE = 3, 64, 0.01
CHUNK = 48  # windows scored at a time
UNKNOWN = "und"


class Net(NamedTuple):
    languages: list
    filters: list  # per width: (width, 256, FILTERS)
    bias: list  # per width: (FILTERS,)
    out: np.ndarray  # (WIDTHS * FILTERS + 1, languages), the last row is the bias


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text number, bytes in use) of all texts; the last window of a text is padded with zeros."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    first = np.cumsum(counts) - counts
    padded = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    for begin, stop, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (first * WINDOW).tolist()):
        padded[at : at + stop - begin] = data[begin:stop]
    owner = np.repeat(np.arange(len(sizes)), counts)
    used = np.minimum(WINDOW, sizes[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return padded.reshape(-1, WINDOW), owner, used


def _responses(x: np.ndarray, width: int, filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(windows, places, FILTERS) before the maximum."""
    places = x.shape[1] - width + 1
    total = filters[0][x[:, :places]]
    for j in range(1, width):
        total = total + filters[j][x[:, j : j + places]]
    return total + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list) -> Net:
    """Adam on the cross-entropy, weighted so that every language counts alike."""
    draw = np.random.default_rng(5)
    filters = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(languages))).astype(np.float32)
    params = [*filters, *bias, out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    weight = (1 / np.maximum(share * len(languages), 1e-3))[labels].astype(np.float32)
    step = 0
    for _ in range(PASSES):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y, n = windows[pick], labels[pick], len(pick)
            best, pooled = [], []
            for w, f, b in zip(WIDTHS, filters, bias):
                r = _responses(x, w, f, b)
                best.append(r.argmax(axis=1))
                pooled.append(np.take_along_axis(r, best[-1][:, None], 1)[:, 0])
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            full = np.concatenate([hidden, np.ones((n, 1), np.float32)], axis=1)
            error = _softmax(full @ out)
            error[np.arange(n), y] -= 1
            error *= weight[pick, None] / n
            back = (error @ out[:-1].T) * (hidden > 0)
            grads = []
            for k, (w, f) in enumerate(zip(WIDTHS, filters)):
                g, pull = np.zeros_like(f), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, best[k] + j, 1), np.arange(FILTERS)), pull)
                grads.append(g)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grads.append(full.T @ error)
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Net(languages, filters, bias, out)


class Scorer:
    """The net with its filters summed over pairs of bytes, so that a place costs few look-ups."""

    def __init__(self, net: Net):
        self.net = net
        self.pairs = {}
        for w, f in zip(WIDTHS, net.filters):
            for j in range(0, w - 1, 2):
                self.pairs[w, j] = (f[j][:, None] + f[j + 1][None]).reshape(-1, FILTERS)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [np.zeros((0, len(self.net.languages)))]
        for at in range(0, len(windows), CHUNK):
            x = windows[at : at + CHUNK]
            code = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            pooled = []
            for w, f, b in zip(WIDTHS, self.net.filters, self.net.bias):
                places = WINDOW - w + 1
                total = np.take(self.pairs[w, 0], code[:, :places], axis=0)
                for j in range(2, w - 1, 2):
                    total += np.take(self.pairs[w, j], code[:, j : j + places], axis=0)
                if w % 2:
                    total += np.take(f[w - 1], x[:, w - 1 : w - 1 + places], axis=0)
                pooled.append(total.max(axis=1) + b)
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            parts.append(_softmax(hidden @ self.net.out[:-1] + self.net.out[-1]))
        return np.concatenate(parts)


def fit(docs: DataFrame) -> Net | None:
    """Train on a bounded number of whole texts and of their windows, of each language outside the held-out fold.

    Null ids and languages and empty texts are left out, an id counts once (with its smallest
    language and text). At most MOST_LANGUAGES languages, TRAIN_ROWS texts (LEAST_ROWS of a
    language if they are many) and TRAIN_WINDOWS windows (LEAST_WINDOWS) are learnt from, windows
    drawn from all places of the texts. None if there is nothing to learn.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold(FOLDS) != HELD_OUT))
    known = known.where(F.length("text") > 0)
    known = known.groupBy("doc_id").agg(F.min("lang").cast("string").alias("lang"))
    count = max(known.select("lang").distinct().count(), 1)
    picked = bounded_each(known, "lang", max(TRAIN_ROWS // count, LEAST_ROWS), MOST_LANGUAGES)
    rows = [r for r in picked_texts(docs, picked, TRAIN_BYTES, "lang") if r["text"]]
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    data, offsets = text_bytes(pa.array([r["text"] for r in rows], pa.large_string()))
    windows, owner, _ = _windows(lowered(data), offsets)
    labels = np.array([languages.index(r["lang"]) for r in rows])[owner]
    draw, share = np.random.default_rng(3), max(TRAIN_WINDOWS // count, LEAST_WINDOWS)
    pick = np.concatenate([draw.permutation(np.flatnonzero(labels == k))[:share] for k in range(len(languages))])
    return train(windows[pick], labels[pick], languages)


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; UNKNOWN with score 0 where there is no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kilobytes

    def apply(batches):
        net = shared.value
        scorer = Scorer(net) if net else None
        for batch in batches:
            n = batch.num_rows
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if net:
                data, offsets = text_bytes(batch.column(1))
                windows, owner, used = _windows(lowered(data), offsets)
                chances = scorer.probabilities(windows) * used[:, None]
                mean = np.zeros((n, len(net.languages)))
                np.add.at(mean, owner, chances)
                mean /= np.maximum(np.diff(offsets), 1)[:, None]
                best = mean.argmax(axis=1)
                letters = np.array(batch.column(2).to_pylist(), bool)
                names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
                scores = np.where(letters, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), text, F.rlike(text, F.lit(r"\p{L}")))
    return texts.mapInArrow(apply, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang).

    A text that is null or has no letter is UNKNOWN with score 0, and so is every text where nothing
    could be learnt; of languages with equal chances the first by name counts. Repeated rows come
    out as often as they stand, all alike; an empty table gives no rows; other columns are not read.
    """
    return predict(docs, fit(docs)).select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
