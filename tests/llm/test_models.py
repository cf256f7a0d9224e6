"""Held-out accuracy of the trained models, their gradients, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogq.llm import langid as L
from catalogq.llm import quality_model as M
from catalogq.llm import samples, textbatch
from catalogq.llm import toxicity as T

LETTERS = {"aa": "abcdei", "bb": "rstuvo", "cc": "mnopaê"}


def prose(draw, lang, words):
    return " ".join("".join(draw.choices(LETTERS[lang], k=draw.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="module")
def languages(spark):
    draw = random.Random(1)
    rows = [(i, prose(draw, lang, draw.choice([3, 40, 300])), lang, 1) for i in range(300) for lang in [draw.choice(list(LETTERS))]]
    odd = [(900, None, "aa", 1), (901, "", "bb", 1), (902, "12 + 34!", "cc", 1), (903, "rstu rstu", None, 1), (None, "abcd", "aa", 1)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score long")


def test_language_of_held_out_texts(languages):
    got = L.language_report(languages)
    joined = got.withColumnRenamed("lang_pred", "found").join(languages.select("doc_id", "lang"), "doc_id").where("doc_id < 900")
    held = joined.where("held_out").collect()
    assert len(held) > 30 and sum(r["found"] == r["lang"] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r for r in got.where("doc_id >= 900").collect()}
    assert [odd[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and odd[903]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.collect()) and got.count() == languages.count()


def test_rare_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAIN_ROWS", 60)
    monkeypatch.setattr(L, "TRAIN_WINDOWS", 200)
    draw = random.Random(6)
    rows = [(i, prose(draw, "aa", 60), "aa") for i in range(2000)]
    ids = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % L.FOLDS != L.HELD_OUT]
    rows += [(i, prose(draw, lang, 60), lang) for lang, i in zip(["bb", "cc"] * 2, ids)] + [(ids[9], "", "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = L.fit(docs)
    assert net.languages == ["aa", "bb", "cc"]
    rare = [r["lang_pred"] for r in L.predict(docs.where("lang in ('bb', 'cc')").orderBy("lang"), net).collect()]
    assert rare == ["bb", "bb", "cc", "cc"]


def test_samples_of_each_value_are_bounded(spark):
    ids = spark.range(5000).selectExpr("id AS doc_id", "if(id % 1000 = 7, 'rare', 'usual') AS lang")
    count = {r["lang"]: r["count"] for r in samples.bounded_each(ids, "lang", 100, 50).groupBy("lang").count().collect()}
    assert count == {"rare": 5, "usual": 100}


def test_pair_tables_equal_the_plain_convolution():
    draw = np.random.default_rng(0)
    net = L.train(draw.integers(0, 256, (40, L.WINDOW), dtype=np.uint8), draw.integers(0, 2, 40), ["x", "y"])
    x = draw.integers(0, 256, (100, L.WINDOW), dtype=np.uint8)
    pooled = [L._responses(x, w, f, b).max(axis=1) for w, f, b in zip(L.WIDTHS, net.filters, net.bias)]
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    assert np.allclose(L.Scorer(net).probabilities(x), L._softmax(hidden @ net.out[:-1] + net.out[-1]), atol=1e-5)


def test_every_byte_is_in_one_window():
    data = np.arange(1000, dtype=np.uint64).astype(np.uint8)
    windows, owner, used = L._windows(data, np.array([0, 0, 300, 300, 1000]))
    assert used.sum() == 1000 and [used[owner == k].sum() for k in range(4)] == [0, 300, 0, 700]
    assert np.array_equal(np.concatenate([w[:n] for w, n in zip(windows, used)]), data)


def test_no_labelled_text(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.language_report(docs).first()["lang_pred"] == "und"
    assert L.language_report(docs.limit(0)).count() == 0


INSULTS = ["zogwit", "flarn", "grubok"]


@pytest.fixture(scope="module")
def toxic(spark):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words, bad = prose(draw, "aa", draw.choice([5, 50, 400])).split(), i % 8 == 0
        if bad:
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS) + draw.choice(["", ",", "heit"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "flarn"), (2002, "x " * 50_000 + "Zogwit!")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        labels + [(None, 1), (3000, 1), (1, None), (1, 0)], "doc_id long, toxic int"
    )


def test_toxic_words_are_found_in_held_out_texts(toxic):
    docs, labels = toxic
    got = T.toxicity_report(docs, labels)
    rows = got.join(labels.where("toxic is not null").distinct(), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r["predicted"] == 1 for r in rows if r["toxic"]) >= 0.95 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] == 1 for r in rows if not r["toxic"]) <= 0.02 * len(rows)
    odd = {r["doc_id"]: r["predicted"] for r in got.where("doc_id >= 2000 or doc_id is null").collect()}
    assert odd == {2000: 0, 2001: 0, None: 1, 2002: 1}


def test_risk_on_clean_text_is_not_driven_below_zero():
    draw = random.Random(3)
    positive = [prose(draw, "aa", 20) + " flarn" for _ in range(200)]
    unlabelled = [prose(draw, "aa", 20) + (" flarn" if k % 4 == 0 else "") for k in range(1200)]
    model = T.train(positive, unlabelled, 0.25)
    lookup = T.Lookup(model.features)
    rows, place = T._presence(unlabelled, lookup)
    score = 1 / (1 + np.exp(-(np.bincount(rows, model.weights[place], 1200) + model.bias)))
    clean = np.delete(score, np.s_[::4])
    assert score[::4].min() > 0.5 and (clean >= 0.3).mean() < 0.02


def test_models_without_labels(spark, toxic):
    docs, labels = toxic
    assert {r["predicted"] for r in T.toxicity_report(docs, labels.limit(0)).collect()} == {0}
    assert T.toxicity_report(docs.limit(0), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in M.quality_scores(docs, none).collect()} == {0.5}


def test_quality_of_held_out_texts(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text, good = prose(draw, "aa", draw.choice([8, 80, 300])), i % 5 < 4
        if not good:
            text = draw.choice([text.replace(" ", "*** "), text.upper().replace(" ", "!! "), " ".join(w + " " + w for w in text.split())])
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(700, None), (701, "")], "doc_id long, text string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    held = M.quality_scores(docs, labelled).join(labelled, "doc_id").where("held_out").collect()
    assert len(held) > 80 and sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_sparse_scores_are_dot_products():
    rows, places, values = M.vectors(pa.array(["a b b", None, "x", "a b b"]))
    assert np.allclose(np.bincount(rows, values**2, 4), [1, 0, 1, 1])
    assert np.array_equal(places[rows == 0], places[rows == 3])


def test_vectors_do_not_depend_on_the_next_text():
    alone, followed = (M.vectors(pa.array(texts)) for texts in (["a b c a b"], ["a b c a b", "c d"]))
    assert all(np.array_equal(a, b[followed[0] == 0]) for a, b in zip(alone, followed))


def test_samples_are_bounded_and_repeatable(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    first = [r[0] for r in samples.bounded(ids, 100).collect()]
    assert len(first) == 100 and first == [r[0] for r in samples.bounded(ids.repartition(7), 100).collect()]
    assert samples.bounded(ids, 9000).count() == 5000


def test_an_id_counts_once_and_bytes_are_bounded(spark):
    rows = [(1, "same")] * 300 + [(2, "x" * 100), (3, "y" * 50), (4, None), (5, "é" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = docs.select("doc_id")
    assert samples.bounded(ids, 10).count() == 5
    got = samples.sampled_texts(docs, ids, 10, 1_000)
    assert [(r["doc_id"], r["text"]) for r in got] == [(1, "same"), (2, "x" * 100), (3, "y" * 50), (4, None), (5, "é" * 10)]
    small = samples.sampled_texts(docs, ids, 10, 80)
    assert {r["doc_id"] for r in small} == {1, 3, 4, 5} and len(samples.sampled_texts(docs, ids, 1, 1_000)) == 1
    assert samples.sampled_texts(docs.where("false"), ids.where("false"), 5, 100) == []


def test_values_are_thinned_before_anything_is_shuffled(spark):
    ids = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 > 0, "en").otherwise("de").alias("lang"))
    made = samples.bounded_each(ids, "lang", 100, 10)
    assert {r["lang"]: r["count"] for r in made.groupBy("lang").count().collect()} == {"en": 100, "de": 100}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    dirty = spark.range(5_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"))
    assert samples.bounded_each(dirty, "lang", 100, 20).count() == 20
    assert samples.bounded_each(ids.where("false"), "lang", 100, 20).count() == 0


# Scores written plainly, one text and one word at a time, against the registered queries on a whole table.

FULL = (1 << 64) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mixed(x):
    return int(textbatch.mix(np.array([x & FULL], np.uint64))[0])


def word_hash(word):
    total = sum(int(textbatch._BYTES[b]) * pow(textbatch._BASE, k, 1 << 64) for k, b in enumerate(word))
    return mixed(total + len(word))


def run_hash(hashes):
    return mixed(sum(h * (mixed(k) | 1) for k, h in enumerate(hashes, 1)))


def tables(spark, sf_dir):
    odd = [(None, "zz top"), (-1, None), (-2, ""), (-3, "a b c a b"), (-4, "c d e"), (-5, "12 34!")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang", F.lit("en")))
    return docs.coalesce(1), spark.read.parquet(f"{sf_dir}/labels.parquet")


def logistic(x):
    return 1 / (1 + math.exp(-min(max(x, -50), 50)))


def same_scores(docs, scored, plain):
    texts = [r["text"] or "" for r in docs.collect()]
    got = [r["score"] for r in scored.collect()]
    assert len(got) == len(texts) > 200
    assert np.allclose(sorted(got), sorted(plain(t.encode()) for t in texts), atol=1e-6)


def test_toxicity_equals_plain_scores(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    model = T.fit(docs, labels)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))

    def plain(text):
        names = set()
        for word in set(re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())):
            names.add(word_hash(word))
            names |= {mixed(word_hash(word[:k]) + k) for k in T.BEGINNINGS if len(word) > k}
        return logistic(model.bias + sum(weights.get(x, 0.0) for x in names))

    same_scores(docs, T.score(docs, model), plain)


def test_quality_equals_plain_scores(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    weights, bias = M.fit(docs, labels)
    kinds = [rb"[#*$%&|<>=@^~_\\{}\[\]+/]", rb"[!?]", rb"[.,;:]", rb"[A-Z]", rb"[a-z]", rb"[0-9]"]
    known, made = {}, {}

    def plain(text):
        words = WORD.findall(text)
        low = [w.lower() for w in words]
        runs = Counter(tuple(low[k : k + 3]) for k in range(len(low) - 2))
        tokens = [[], [], []]
        for k, word in enumerate(words):
            shape = sum(1 << bit for bit, kind in enumerate(kinds) if re.search(kind, word))
            shape += 64 * (k > 0 and low[k] == low[k - 1]) + 128 * (runs[tuple(low[k : k + 3])] > 1)
            if low[k] not in known:
                known[low[k]] = word_hash(low[k])
            tokens[0].append(known[low[k]])
            tokens[1].append(("s", shape))
            tokens[2].append(("l", shape, min(len(word) // 3, 8)))
        value = lambda x: x if isinstance(x, int) else mixed(x[1] + (1 << 20) if x[0] == "s" else x[1] + (x[2] << 10) + (1 << 21))
        places = Counter()
        for sequence in tokens:
            for run in [*((x,) for x in sequence), *zip(sequence, sequence[1:])]:
                if run not in made:
                    hashes = [value(x) for x in run]
                    made[run] = (hashes[0] if len(hashes) == 1 else run_hash(hashes)) % M.PLACES
                places[made[run]] += 1
        norm = math.sqrt(sum(n * n for n in places.values())) or 1.0
        return logistic(bias + sum(weights[p] * n for p, n in places.items()) / norm)

    same_scores(docs, M.score(docs, (weights, bias)), plain)


def test_language_equals_plain_convolution(spark, sf_dir):
    docs, _ = tables(spark, sf_dir)
    net = L.fit(docs)
    got = L.predict(docs, net).collect()

    def plain(text):
        if not any(c.isalpha() for c in text):
            return L.UNKNOWN, 0.0
        data = text.encode().lower()
        total = np.zeros(len(net.languages))
        for at in range(0, len(data), L.WINDOW):
            part = data[at : at + L.WINDOW]
            padded = part.ljust(L.WINDOW, b"\0")
            pooled = []
            for width, filters, bias in zip(L.WIDTHS, net.filters, net.bias):
                best = np.full(L.FILTERS, -np.inf)
                for k in range(L.WINDOW - width + 1):
                    best = np.maximum(best, sum(filters[j][padded[k + j]] for j in range(width)))
                pooled += [max(float(x), 0.0) for x in best + bias]
            z = [sum(h * net.out[i, c] for i, h in enumerate([*pooled, 1.0])) for c in range(len(net.languages))]
            e = [math.exp(x - max(z)) for x in z]
            total += len(part) * np.array(e) / sum(e)
        total /= len(data)
        return net.languages[int(total.argmax())], float(total.max())

    # Every text whole; of very long ones a few are enough for loops this plain.
    rows = docs.collect()
    chosen = [k for k, r in enumerate(rows) if len(r["text"] or "") < 3_000]
    chosen += [k for k, r in enumerate(rows) if len(r["text"] or "") >= 3_000][:3]
    by_row = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in got), key=str)
    want = {(rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0): plain(rows[k]["text"] or "") for k in chosen}
    assert len(want) > 150
    for held, doc_id, name, score in by_row:
        if (held, doc_id) in want:
            other, chance = want[held, doc_id]
            assert name == other and abs(score - chance) < 1e-4
