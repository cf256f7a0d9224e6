"""License scans against counting by plain loops, and notices changed in known ways."""

import random
import re

import pytest

from catalogq.llm import license_scan as L

SCHEMA = "doc_id long, text string, n_words string, labels int, start string"
MIT = dict(L.NOTICES)["mit"]
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    words, places = words_of(text), []
    for label, phrase in BASE.items():
        part = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(part)] == part]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def report(spark, texts, **settings):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in L.license_report(spark.createDataFrame(rows, SCHEMA).repartition(3), **settings).collect()}


def test_base_equals_plain_loops(spark):
    draw = random.Random(1)
    parts = ["GNU", "general", "PUBLIC", "license", "apache", "Apache License", "cc", "by", "MIT", "mit license", "é", "x", "漢", "2"]
    gaps = [" ", " ", "-", ", ", "\n", "__", "\x00", "\x7f"]
    texts = ["".join(draw.choice(parts) + draw.choice(gaps) for _ in range(draw.randrange(0, 60))) for _ in range(300)]
    got = report(spark, texts)
    for i, text in enumerate(texts):
        assert tuple(got[i])[1:6] == base(text), text
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(",")) | {""}


def test_notices_with_changes_are_found_and_others_left_alone(spark):
    words = MIT.split()
    noise = " ".join(f"w{i}" for i in range(300))
    put_in = " ".join([*words[:30], "really", *words[30:]])
    left_out = " ".join([*words[:20], *words[22:50], *words[51:]])
    replaced = " ".join(w if i % 20 else "other" for i, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    mixed = words[:]
    random.Random(2).shuffle(mixed)
    texts = [f"{noise} {t} {noise}" for t in (MIT, MIT.upper(), put_in, left_out, replaced, half, " ".join(mixed), "")]
    got = report(spark, texts)
    assert [got[i]["labels"] for i in range(8)] == ["mit"] * 5 + [""] * 3
    assert got[0]["score"] == got[1]["score"] == 1.0 and 0.8 <= got[4]["score"] < 1
    assert 0.3 < got[5]["score"] < 0.8 and got[6]["score"] < 0.2 and got[7]["score"] == 0.0
    assert all(got[i]["n_base"] == 0 and got[i]["first_word"] is None for i in range(8))


def test_short_notices_and_their_neighbours(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.", "the gnu general public",
    ]
    got = report(spark, texts)
    assert [got[i]["labels"] for i in range(5)] == ["cc-by,cc-by-nc-4.0", "cc-by,cc-by-4.0", "mit", "gpl,gpl-3.0", ""]
    assert [got[i]["n_base"] for i in range(5)] == [1, 1, 1, 1, 0]


def test_spans_say_where(spark):
    rows = [(1, "a b c " + MIT + " d e", "x", 1, "y"), (2, "cc by, cc by", "x", 1, "y")]
    got = {r["doc_id"]: r["_spans"] for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    best = max(got[1], key=lambda s: s["cover"])
    assert (best["label"], best["start"], best["stop"], best["cover"]) == ("mit", 3, 3 + len(words_of(MIT)), 1.0)
    assert sorted((s["start"], s["stop"]) for s in got[2] if s["exact"]) == [(0, 2), (2, 4)]


def test_nulls_empty_repeats_and_long_texts(spark):
    rows = [(None, None, "", 0, ""), (1, "", "", 0, ""), (1, "", "", 0, ""), (2, "cc by", "", 0, ""), (2, "cc by", "", 0, "")]
    rows += [(3, "mit license " * 60_000, "", 0, ""), (4, "x " * 300_000, "", 0, ""), (5, MIT * 300, "", 0, "")]
    got = sorted((tuple(r) for r in L.license_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [r for r in got if r[0] is None] == [(None, 0, 0, None, None, "", "", 0.0)]
    assert got.count((1, 0, 0, None, None, "", "", 0.0)) == 2
    assert got.count((2, 2, 1, 0, 0, "cc-by", "cc-by", 1.0)) == 2
    long = {r[0]: r for r in got}
    assert long[3][1:6] == (120_000, 60_000, 0, 119_998, "mit") and long[4][1:4] == (300_000, 0, None)
    assert long[5][2] == 0 and long[5][6] == "mit"
    assert L.license_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_templates_are_a_parameter(spark):
    known = L.templates((), (("own", "one two three four five six"),))
    got = report(spark, ["One two three four five six", "one two three nine four five six", "cc by"], known=known)
    assert [got[i]["labels"] for i in range(3)] == ["own", "", ""]
    assert report(spark, ["cc by"], known=[])[0]["score"] == 0.0
    with pytest.raises(ValueError):
        L.templates((("long", "a b c d e"),), ())


def test_many_templates_join_without_being_sent(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_SENT", 0)
    assert report(spark, ["x released under the MIT license"])[0]["labels"] == "mit"
