"""Edit distance of long cells: the same figures as the plain recurrence, in time that follows the change."""

import random
import time

import pytest
from pyspark.sql import functions as F

from catalogq.functions import similarity as S


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def changed(draw, text, edits):
    out = list(text)
    for _ in range(edits):
        at = draw.randrange(len(out) + 1)
        kind = draw.random()
        if kind < 0.4 and out:
            out[min(at, len(out) - 1)] = draw.choice("abcé漢😀")
        elif kind < 0.7:
            out.insert(at, draw.choice("abcé漢😀"))
        elif out:
            del out[min(at, len(out) - 1)]
    return "".join(out)


def pairs(seed):
    draw = random.Random(seed)
    found = [("", ""), ("", "a" * 90), ("a" * 65, "a" * 65), ("a" * 70, "a" * 200), ("é😀" * 50, "é😀" * 51), ("ab" * 60, "ba" * 60)]
    for _ in range(150):
        text = "".join(draw.choice("abcé漢😀") for _ in range(draw.randrange(0, 260)))
        found.append((text, changed(draw, text, draw.randrange(0, 30))))
        found.append((text, "".join(draw.choice("abcé漢😀") for _ in range(draw.randrange(0, 260)))))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_distance_equals_the_plain_recurrence(spark, seed):
    made = pairs(seed)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(made)], "i int, a string, b string").repartition(8)
    got = df.select("i", S.edit_distance(F.col("a"), F.col("b")).alias("d"), S.common_start(F.col("a"), F.col("b")).alias("s"))
    for r in got.collect():
        a, b = made[r["i"]]
        assert r["d"] == plain(a, b), (a, b)
        assert a[: r["s"]] == b[: r["s"]] and (a[r["s"] : r["s"] + 1] != b[r["s"] : r["s"] + 1] or len(a) == len(b) == r["s"])


def test_hundred_thousand_characters_take_seconds(spark):
    draw = random.Random(2)
    text = "".join(draw.choice("abcdefgh ") for _ in range(100_000))
    one = text[:50_000] + "X" + text[50_001:]
    near = text[:70_000] + changed(draw, text[70_000:71_000], 40) + text[71_000:]
    rows = [(0, text, one), (1, text, near), (3, text, text[:40_000]), (4, text, text + "tail"), (5, "", text), (6, text, "é" + text)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    start = time.time()
    got = {r["i"]: r["s"] for r in df.select("i", S.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert time.time() - start < 20
    assert got[0] == 1 - 1 / 100_000 and got[3] == 0.4 and got[4] == 1 - 4 / 100_004 and got[5] == 0
    assert got[6] == 1 - 1 / 100_001 and 1 - 40 / 99_960 <= got[1] < 1
