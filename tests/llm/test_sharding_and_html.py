"""Packing against its guarantees, and page texts against pages made for each case."""

import random
import zlib
from collections import Counter

import pytest

from catalogq.llm import html_main as H
from catalogq.llm import sharding as S


def plain_best_fit(weights, capacity):
    """Bins of a one-by-one best fit, heaviest first."""
    bins = []
    for w in sorted(weights, reverse=True):
        fitting = [(r, k) for k, r in enumerate(bins) if r >= w]
        if fitting:
            bins[min(fitting)[1]] -= w
        else:
            bins.append(max(capacity, w) - w)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_best_fit_one_by_one(seed):
    draw = random.Random(seed)
    weights = [draw.choice([3, 7, 7, 20, 55, draw.randrange(1, 130)]) for _ in range(draw.randrange(1, 400))]
    runs, bins = S.pack(list(Counter(weights).items()), 100)
    left = {}
    for w, a, b, k in runs:
        left[k] = left.get(k, max(100, w)) - w * (b - a)
    assert sorted(left.values()) == plain_best_fit(weights, 100) and len(left) == bins
    for w, n in Counter(weights).items():
        spans = sorted((a, b) for x, a, b, _ in runs if x == w)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == n


def test_tree_splits_and_finds_the_tightest():
    tree, draw, held = S.CapacityTree(), random.Random(1), []
    for k in range(3000):
        entry = (draw.randrange(10_000), k)
        tree.add(*entry)
        held.append(entry)
    assert len(tree.nodes) > 5
    for _ in range(2500):
        least = draw.randrange(10_500)
        want = min((e for e in held if e[0] >= least), default=None)
        assert tree.take_tightest(least) == want
        if want:
            held.remove(want)


def test_shards_are_even_whole_and_gapless(spark):
    draw = random.Random(3)
    texts = ["é" * draw.randrange(1, 900) + str(i) for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i % 5]) for i in range(60)]
    rows += [(2000, None), (2001, ""), (None, texts[3]), (5, texts[5]), (5, texts[5])]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    bytes_, slots, owner = Counter(), {}, {}
    for r in got:
        bytes_[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert owner.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    assert set(bytes_) == set(range(8)) and max(bytes_.values()) < 1.02 * sum(bytes_.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_a_group_above_a_fair_share_stands_alone(spark):
    rows = [(i, "hot" * 400) for i in range(50)] + [(100 + i, f"text {i} " * 30) for i in range(200)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    hot = {r["shard"] for r in got if r["doc_id"] < 50}
    others = [v for k, v in sums.items() if k not in hot]
    assert len(hot) == 1 and len(others) == 4 and max(others) < 1.05 * min(others)


def test_no_rows(spark):
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(500):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(14))] for _ in range(2))
        found = H.common_lines(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and len(found) == common_length(a, b)
        assert all(any(a[i] == y for y in rest) for i in found)


def texts(spark, pages):
    rows = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return sorted((r["page_id"] or 0, r["text"]) for r in rows)


def test_declared_articles_are_whole(spark):
    page = (
        "<html><head><title>T</title><script>x='</p>'</script></head><body class='has-sidebar'><header>H</header>"
        "<nav><ul><li>menu</ul></nav><div class=ad>buy</div><article><h1>Title &amp; more</h1><p>One  <b>bo</b>ld&nbsp;word"
        "<p>Two<br>lines<aside>side</aside><form>send</form><div class='comments'><p>nice</div><p>Three</article>"
        "<footer>&copy; f</footer></body></html>"
    )
    want = "Title & more\nOne bold word\nTwo lines\nThree"
    assert texts(spark, [(1, "http://h/1", page), (2, "http://h/2", page), (2, "http://h/2", page)]) == [(1, want), (2, want), (2, want)]


def test_open_lines_that_neighbours_share_go(spark):
    shell = "<div>Home</div><div>All our news every day</div>{}<div>Imprint</div><div>Contact us here</div>"
    pages = [(i, f"http://h/news/{i}", shell.format(f"<p>Story {i} is told here.</p><p>It ends {i}.</p>")) for i in range(1, 8)]
    pages += [(20 + i, "http://h/news/3", pages[2][2]) for i in range(4)]  # copies say nothing about templates
    pages += [(30, "http://other/", shell.format("<p>alone</p>")), (31, None, None), (32, "::bad[", ""), (None, None, "<p>x")]
    got = dict(texts(spark, pages))
    assert all(got[i] == f"Story {i} is told here.\nIt ends {i}." for i in range(1, 8))
    assert all(got[20 + i] == got[3] for i in range(4))
    assert got[30].startswith("Home\n") and got[31] == got[32] == "" and got[0] == "x"


def test_short_texts_in_a_large_shell_and_runs_of_near_copies(spark):
    shell = "".join(f"<div>Menu entry {w} of the whole site</div>" for w in "abcdefghijklmnopqrst")
    names = ["red", "green", "blue", "white", "black", "brown"]
    pages = [(i, f"http://short/{i}", f"{shell}<p>All about {n}.</p><div>Imprint</div>") for i, n in enumerate(names)]
    story = "".join(f"<p>A long story goes on in part {w}.</p>" for w in "abcdefghijklmnopqrst")
    few = "<div>Home</div>{}<div>Imprint</div>"
    pages += [(100 + i, f"http://runs/b/{i}", few.format(f"{story}<p>Read {i} times</p>")) for i in range(12)]
    pages += [(200 + i, f"http://runs/{p}", few.format(f"<p>{n} is another page.</p>" * 3)) for i, (p, n) in enumerate(zip("acdefg", names))]
    got = dict(texts(spark, pages))
    assert [got[i] for i in range(6)] == [f"All about {n}." for n in names]
    for i in range(12):
        assert got[100 + i].startswith("A long story goes on in part a.") and got[100 + i].endswith(f"part t.\nRead {i} times")
    assert all("Home" not in got[200 + i] and f"{names[i]} is another page." in got[200 + i] for i in range(6))


def test_broken_markup():
    lines = lambda page: [t for t, k in H.page_lines(page) if k != H.OTHER]
    assert lines("<p>a < b <3 c &am <p>d<!-- open") == ["a < b <3 c &am", "d"]
    assert lines("<article><p>x<script>never closed") == ["x"]
    assert lines("<p title=\"a>b\">kept</p><p hidden>gone</p>tail") == ["kept", "tail"]
    assert lines("<DIV><P>Upper</P></DIV>" + "<p>y</p>" * 20_000) == ["Upper"] + ["y"] * 20_000
