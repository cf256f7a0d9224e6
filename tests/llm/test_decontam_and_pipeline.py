"""Benchmark passages, plain and re-parameterised; the pipeline against its parts."""

import random
import re

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from catalogq.llm import decontam as D
from catalogq.llm import minhash, quality_rules, secret_scan
from catalogq.llm import queries as Q


def leaks(spark, docs, items):
    found = D.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    return sorted((r["doc_id"], r["item_id"]) for r in found.collect())


ITEM = "Tom bought 12 apples for 5 dollars and then Tom gave 3 of the 12 apples to his little sister Eve yesterday"


def test_copies_and_new_parameters_are_caught(spark):
    docs = [
        (1, "Before it. " + ITEM + ". After it."),
        (2, "so " + ITEM.replace("Tom", "Ann").replace("12", "40").replace("Eve", "Zoe").replace("dollars", "euros")),
        (3, "so " + ITEM.lower().replace("tom", "tom,")),
        (4, "so Tom bought 12 apples for 5 dollars and then Bob gave 3 of the 9 apples to his little sister Ann yesterday".replace("12", "7").replace("Tom", "Jim")),
        (5, "Tom bought 12 apples for 5 dollars but kept them"),
        (6, "nothing of the sort is written in this text at all as anyone can see"),
    ]
    # Without capitals some windows differ, and the others are enough.
    assert leaks(spark, docs, [(1, ITEM)]) == [(1, 1), (2, 1), (3, 1)]


def test_added_dropped_and_longer_words_are_caught(spark):
    words = ITEM.split()
    docs = [
        (1, " ".join([*words[:11], "really", *words[11:]])),
        (2, " ".join([*words[:10], *words[11:]])),
        (3, "so " + ITEM.replace("Tom", "Mary Ann").replace("12", "1 000")),
    ]
    assert leaks(spark, docs, [(1, ITEM)]) == [(1, 1), (2, 1), (3, 1)]


def test_copies_in_any_case_are_caught(spark):
    short = "Anna has 3 apples. Anna gets 5 pears. Anna sells 2 plums. Who buys them from Anna?"
    docs = [
        (1, ITEM.upper()), (2, ITEM.title()), (3, ITEM.lower()), (4, "so " + ITEM.upper() + " it is"),
        (5, short.replace("Anna", "Tim").replace("3", "8")),
    ]
    assert leaks(spark, docs, [(1, ITEM), (2, short)]) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]


def test_one_clashing_value_is_no_disagreement(spark):
    item = "there were 3 birds and 5 cats and 7 dogs when Tom came home to feed them all"
    twice = "give me 12 red beads and 12 blue beads so that Sam can make a necklace for a friend"
    docs = [
        (1, item.replace("5", "3").replace("3 birds", "3 birds")),
        (2, item.replace("3", "4").replace("5", "4")),
        (3, twice.replace("12 red", "7 red").replace("12 blue", "9 blue")),
    ]
    assert leaks(spark, docs, [(1, item), (2, twice)]) == [(1, 1), (2, 1), (3, 2)]


def test_names_of_any_script_are_exchanged(spark):
    russian = "Вчера утром Маша купила 12 яблок за 5 рублей и потом Маша отдала 3 яблока своей сестре Оле"
    greek = "χθες το πρωί ο Νίκος πήρε 12 μήλα και μετά ο Νίκος έδωσε 3 από αυτά στην αδελφή του Ελένη"
    docs = [
        (1, "так " + russian.replace("Маша", "Катя").replace("12", "40").replace("Оле", "Ане").replace("3", "8")),
        (2, "να " + greek.replace("Νίκος", "Πέτρος").replace("12", "9").replace("Ελένη", "Άννα")),
        (3, russian.upper()), (4, "Вчера утром Маша купила хлеб и пошла домой"),
        (5, russian.replace("потом Маша", "потом Катя").replace("12", "8").replace("Оле", "Маша").replace("3", "5").replace(" яблок ", " груш ").replace("сестре", "подруге").replace("утром", "днём")),
    ]
    assert leaks(spark, docs, [(1, russian), (2, greek)]) == [(1, 1), (2, 2), (3, 1)]


def test_texts_without_spaces_are_found(spark):
    chinese = "小明昨天买了12个苹果，花了5元钱，然后他把3个苹果送给了妹妹，请问还剩下多少个苹果？"
    thai = "เมื่อวานนี้แม่ซื้อแอปเปิ้ลสิบผลจากตลาดแล้วให้น้องสาวสามผล"
    docs = [
        (1, "前面的话。" + chinese + "后面的话。"), (2, "题目：" + chinese.replace("12", "40").replace("3", "7")),
        (3, "วันนี้" + thai + "ครับ"), (4, "小明昨天去了学校，然后回家吃饭。苹果很好吃。"), (5, "苹果" * 400),
    ]
    assert leaks(spark, docs, [(1, chinese), (2, thai)]) == [(1, 1), (2, 1), (3, 2)]


def test_short_items_are_found_whole_and_kept_in_the_stage(spark):
    items = [(1, "What is two plus"), (2, "Define entropy"), (3, "Zyzzyva!"), (4, "Tom has 3 cats")]
    docs = [
        (1, "he asked: what is two plus, and left"), (2, "please define Entropy now"), (3, "a zyzzyva"), (4, "What is two, plus one"),
        (5, "define the entropy"), (6, "Ann has 4 cats"), (7, "what is two"), (8, "zyzzyvas define"), (9, "so Tom has 3 cats."),
    ]
    assert leaks(spark, docs, items) == [(1, 1), (2, 2), (3, 3), (4, 1), (9, 4)]
    kept = D.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == len(docs)


def test_characters_equal_a_plain_reading():
    draw = random.Random(12)
    some = "aAßẞéÉяЯωΩǅ中ひกاא𝐀𐐀🙂.!1 \n"
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(60))) for _ in range(300)]
    read = D._read(pa.array(texts))
    unspaced = re.compile("[中ひก]")
    plain = []
    for text in texts:
        words = [re.sub(r"[^0-9A-Za-z%\u0080-\U0010ffff]", "", w) for w in re.split(r"[ \n]+", unspaced.sub(r" \g<0> ", text))]
        plain += [w[0].isupper() or w[0].istitle() for w in words if w]
    assert read.capital.tolist() == plain


def test_changed_copies_of_the_benchmark_are_found(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    items = duckdb.sql(f"SELECT DISTINCT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    middle = lambda t, n: t.split()[: len(t.split()) // 2] + n + t.split()[len(t.split()) // 2 :]
    changed = [lambda t: " ".join(middle(t, ["really"])), str.upper, str.lower, str.title]
    docs = [(i * 10 + k, change(t)) for i, t in items for k, change in enumerate(changed)]
    found = set(leaks(spark, docs, items))
    assert items and [d for d, _ in docs if (d, d // 10) not in found] == []


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = [
        (1, None), (2, ""), (3, "x " + item + " y"), (None, item), (4, item), (4, item), (5, "word " * 30_000 + item),
        (6, "alpha beta gamma delta"), (7, (item + " ") * 40),
    ]
    items = [(1, item), (2, None), (3, ""), (None, item), (4, "a b"), (1, item)]
    assert leaks(spark, docs, items) == [(3, 1), (4, 1), (5, 1), (7, 1)]
    assert leaks(spark, docs[:0], items) == [] and leaks(spark, docs, items[:0]) == []


def test_slots_of_words():
    kinds = lambda text: D.templates(pa.array([text]))[1].tolist()
    assert kinds("He gave Anna 12 km, and 3.5 apples. Then Über") == [0, 0, 2, 1, 3, 0, 1, 0, 0, 2]
    assert kinds("km 5 -- km Ärger") == [0, 1, 3, 2]


def brute(docs, items):
    words = lambda t: [w for w in (re.sub(r"[^0-9a-z%\u0080-\U0010ffff]", "", x.lower()) for x in re.split(r"[\x20\x09-\x0D]+", t or "")) if w]
    items = [(i, words(t)) for i, t in items]
    found = []
    for d, text in docs:
        line = " " + " ".join(words(text)) + " "
        found += [(d, i) for i, w in items if len(w) >= D.WINDOW and f" {' '.join(w)} " in line]
    return sorted(found)


def test_whole_items_in_the_tables_are_found(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    read = lambda n, c: duckdb.sql(f"SELECT {c}, text FROM '{sf_dir}/{n}.parquet'").fetchall()
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    got = Q.op5(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == brute(docs, items)


def test_documents_with_leaks_go_with_all_else_kept(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (None, ITEM, "y"), (2, "free", "z")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == ["y", "z"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables with a case for every stage."""
    draw = random.Random(8)
    text = lambda n: " ".join(f"w{draw.randrange(9000)}" for _ in range(n))
    good = [text(60) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    add = lambda t, **k: rows.append((k.get("i", len(rows)), t, k.get("lang", "en"), "s", t and len(t)))
    add(good[0])
    add(good[1] + " tail")
    add("too short")
    add(None)
    add("again " * 60)
    add(text(20) + " " + ITEM + " " + text(20))
    add(text(30) + " token=abcdefgh12345 " + text(30), lang=None)
    add(good[2], i=2)
    add(good[3], i=None)
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_take_effect_one_after_the_other(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in docs.collect())
    everything = sorted(-1 if r[0] is None else r[0] for r in rows)
    assert left["quality_rules"] == [i for i in everything if i not in (32, 33, 34)]
    assert left["near_dedup"] == sorted({*left["quality_rules"]} - {30, 31})
    assert left["decontamination"] == [i for i in left["near_dedup"] if i != 35]
    assert left["secret_scan"] == left["decontamination"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert "[SECRET]" in texts[36] and "abcdefgh" not in texts[36] and texts[0] == rows[0][1]


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_ids"]
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect()) == [-1, *range(30), 36]


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "secret_scan", "sentencepiece",
    ]


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", "item_id long, text string"),
        ("labels", "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
