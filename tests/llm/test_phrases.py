"""Phrase mining against counts by plain loops."""

import random
import re
from collections import Counter

import pytest

from catalogq.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, n string, rank int, phrase string"


def brute(rows, least, absorbed=80, top=2000):
    f, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] = f.get((lang, tuple(words[i : i + m])), 0) + 1
    out = {}
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = lambda q: any(q[i : i + len(words)] == words for i in range(len(q) - len(words) + 1))  # noqa: B023, E731
        if any(x == lang and len(q) > len(words) and inside(q) and 100 * b >= absorbed * a for (x, q), b in candidates.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    }


def mined(spark, rows, parts=4, **settings):
    got = P.collocations(spark.createDataFrame(rows, SCHEMA).repartition(parts), **settings).collect()
    keys = [tuple(r) for r in got]
    assert len(set(keys)) == len(keys)
    return set(keys)


def texts(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "New", "york", "city", "é", "漢字", "x", "a-b", "\x00", "it's", "zürich", "new york"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b", "\r\n"]
    rows = []
    for i in range(n):
        body = "".join(draw.choice(vocabulary) + draw.choice(gaps) for _ in range(draw.randrange(0, 60)))
        rows.append((i, body, draw.choice(["en", "en", "de", None, ""]), "n", 1, "p"))
    return rows


@pytest.mark.parametrize("seed, least", [(1, 5), (2, 12), (3, 30)])
def test_equals_plain_loops(spark, seed, least):
    rows = texts(seed)
    want = brute(rows, least)
    assert want and mined(spark, rows, least=least) == want


def test_many_short_pieces_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "WINDOWS_OUT", 7)
    monkeypatch.setattr(P, "RUNS_HELD", 11)
    rows = texts(5, 40)
    assert mined(spark, rows, least=3) == brute(rows, 3)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "BITS", 6)
    rows = texts(6)
    assert mined(spark, rows, least=4) == brute(rows, 4)


def test_nulls_repeats_ties_and_empty_tables(spark):
    rows = [(None, None, "en", None, None, None), (1, "", "en", "", 0, ""), (2, " .,\t", None, "", 0, "")]
    assert mined(spark, rows, least=1) == set()
    assert mined(spark, [], least=1) == set()
    rows += [(3, "b a. a b. c d", "en", "", 0, "")] * 3
    got = mined(spark, rows, least=3)
    assert got == brute(rows, 3) and sorted(r[2] for r in got if r[1] == 1) == ["c d"]
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == ["c d", "a b", "b a"]


def test_ranks_are_cut_per_language(spark):
    rows = texts(7)
    assert mined(spark, rows, least=3, top=5) == brute(rows, 3, top=5)


def test_one_long_text_and_a_phrase_inside_a_longer_one(spark):
    rows = [(1, "alpha beta gamma delta " * 30_000, "en", "", 0, ""), (2, "alpha beta; " * 9_000, "en", "", 0, "")]
    got = mined(spark, rows)
    assert got == brute(rows, 30) and "alpha beta" in {r[2] for r in got}


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    frame = spark.createDataFrame([("en", 1, "a", 2 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big), ("en", 0, "", 4 * big)],
                                  "lang string, size int, phrase string, f long")
    made, P.counts = P.counts, lambda *_: frame
    try:
        got = P.collocations(spark.createDataFrame([], SCHEMA)).collect()
    finally:
        P.counts = made
    assert [(r["phrase"], r["score"], r["n"]) for r in got] == [("a b", 500_000, 4 * big)]
