"""Shards of near-equal bytes: best-fit-decreasing packing of groups that must stay together.

The plan is made from a histogram: groups (equal texts) are counted by weight, with weights
rounded up to their 12 leading bits, so there are at most 4096 * 52 weights whatever the
corpus. Heaviest first, each group enters the fullest bin it still fits in, found in a balanced
tree of remaining capacities; all groups of one weight are placed run by run. Spark then ranks
the groups inside their weight and joins them with the runs, so no group or row is planned one
by one, and nothing but the histogram comes to the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep
from catalogq.operators.rowindex import with_position

BITS = 12  # leading bits of a weight that count
FULL_NODE = 256
ROW_BYTES = 16  # a row's size besides its text

Run = tuple[int, int, int, int]  # weight, first rank, rank after the last, bin


class CapacityTree:
    """Bins by remaining capacity: sorted nodes under one sorted root, split when full."""

    def __init__(self) -> None:
        self.nodes: list[list[tuple[int, int]]] = [[]]
        self.least: list[tuple[int, int]] = [(-1, -1)]  # the smallest entry that a node may hold

    def add(self, remaining: int, number: int) -> None:
        at = max(0, bisect_left(self.least, (remaining, number + 1)) - 1)
        node = self.nodes[at]
        insort(node, (remaining, number))
        if len(node) > FULL_NODE:
            half = len(node) // 2
            self.nodes[at : at + 1] = [node[:half], node[half:]]
            self.least.insert(at + 1, node[half])

    def take_tightest(self, weight: int) -> tuple[int, int] | None:
        """Remove the bin with the least remaining capacity that is at least weight."""
        at = max(0, bisect_left(self.least, (weight, -1)) - 1)
        for index in range(at, len(self.nodes)):
            node = self.nodes[index]
            place = bisect_left(node, (weight, -1))
            if place < len(node):
                return node.pop(place)
        return None


def pack(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[Run], int]:
    """Best-fit-decreasing runs for (weight, groups) and the number of bins.

    A group heavier than the capacity gets a bin of its own.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for weight, groups in sorted(histogram, reverse=True):
        rank = 0
        while rank < groups:
            found = tree.take_tightest(weight)
            if found is None:
                found, bins = (max(capacity, weight), bins), bins + 1
            remaining, number = found
            # The tightest bin stays the tightest until the next group no longer fits.
            placed = min(groups - rank, remaining // weight)
            runs.append((weight, rank, rank + placed, number))
            tree.add(remaining - placed * weight, number)
            rank += placed
    return runs, bins


def pack_into(histogram: list[tuple[int, int]], shards: int) -> list[Run]:
    """The runs for the smallest capacity, up to one part in a million, that fills at most so many bins."""
    total = sum(w * n for w, n in histogram)
    low, high = max(1, -(-total // shards)), max(1, total)
    if pack(histogram, low)[1] > shards:
        while high - low > max(1, low // 1_000_000):
            middle = (low + high) // 2
            low, high = (low, middle) if pack(histogram, middle)[1] <= shards else (middle, high)
        low = high
    return _levelled(histogram, pack(histogram, low)[0], shards)


def _levelled(histogram: list[tuple[int, int]], runs: list[Run], shards: int) -> list[Run]:
    """Where groups heavier than a fair share fill bins alone, the rest is packed into the other bins."""
    total, ordered = sum(w * n for w, n in histogram), sorted(histogram, reverse=True)
    heavy, left, bins = [], total, shards
    for weight, groups in ordered:
        if bins > groups and weight * bins > left:
            heavy.append((weight, groups))
            left, bins = left - weight * groups, bins - groups
        else:
            break
    if not heavy or not ordered[len(heavy) :]:
        return runs
    alone = [(w, i, i + 1, 0) for w, n in heavy for i in range(n)]
    alone = [(w, a, b, k) for k, (w, a, b, _) in enumerate(alone)]
    rest = pack_into(ordered[len(heavy) :], bins)
    return alone + [(w, a, b, k + len(alone)) for w, a, b, k in rest]


def rounded(weight):
    """A weight rounded up to BITS leading bits (as a column)."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(weight)) - (BITS - 1), F.lit(0))).cast("long")
    return (F.ceil(weight / unit) * unit).cast("long")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text).

    size is the UTF-8 bytes of the text plus 16. Rows with equal texts share a shard; null and
    empty texts are one group. Slots count the rows of a shard from 0 without gaps, by text
    and doc_id; equal rows get different slots.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keep(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("_group"),
        ),
        "rows",
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).select(
        "_group", rounded(F.col("_bytes")).alias("_weight")
    )
    ranked = with_position(groups, ["_weight", "_group"], "_place")
    histogram = sorted((r["_weight"], r["n"]) for r in ranked.groupBy("_weight").agg(F.count("*").alias("n")).collect())
    if not histogram:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    first, start = {}, 0
    for weight, n in histogram:
        first[weight], start = start, start + n
    plan = rows.sparkSession.createDataFrame(
        [(w, first[w] + a, first[w] + b, k) for w, a, b, k in pack_into(histogram, shards)],
        "_weight long, _from long, _to long, shard int",
    )
    # The plan has a few rows per weight, and the number of weights is bounded.
    placed = ranked.join(F.broadcast(plan), "_weight").where("_place >= _from and _place < _to").select("_group", "shard")
    numbered = with_position(rows.join(placed, "_group"), ["shard", "_group", "doc_id"], "_at")
    firsts = numbered.groupBy("shard").agg(F.min("_at").alias("_first"))
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot")
    )
