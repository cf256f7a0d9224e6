"""Narrow keyed tables: finding a key, its overlaps and a sample read these instead of the wide tables.

A key table has one row per row of a table and column that may identify it: the row's place, the
column and the cell's match key. It is written in the only pass that key finding makes over a
table. Columns that cannot be unique never enter it, or leave it before anything is shuffled:

* a value that the first rows read hold twice proves that a column isn't unique (`repeated_early`);
* a distinct-count sketch far below the number of filled cells rules out others (`may_be_unique`);
  only what is left is counted exactly, in one shuffle that also gives all overlaps (`key_figures`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.text import match_keys, with_match_key
from catalogq.operators.keymatch import may_share, value_sketch
from catalogq.operators.profile import cells, header_table, quoted
from catalogq.session import materialize

PROBE_ROWS = 1000
# Size of a distinct-count sketch (2^12 registers: a standard error of 1.6 per cent), and the part of the filled
# cells below which its estimate rules a column out: over ten standard errors.
SKETCH_BITS, SKETCH_PART = 12, 0.8


def repeated_early(df: DataFrame, columns: Sequence[str], rows: int = PROBE_ROWS) -> list[str]:
    """The columns in which one of the first rows that Spark reads repeats the value of another.

    Any rows serve as a proof, so no order is needed and Spark reads as few tasks as it takes. At
    most rows x columns bounded keys come to the driver.
    """
    if not columns:
        return []
    texts = F.expr("array(" + ", ".join(f"CAST({quoted(c)} AS STRING)" for c in columns) + ")")
    seen: list[set] = [set() for _ in columns]
    repeated = set()
    for row in df.select(match_keys(texts).alias("keys")).limit(rows).collect():
        for i, key in enumerate(row["keys"]):
            if key is not None and key in seen[i]:
                repeated.add(i)
            seen[i].add(key)
    return [c for i, c in enumerate(columns) if i in repeated]


def find_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, column): the columns with values of which none repeats, in header order.

    Only the columns that neither the first rows nor the sketch rule out are read again and shuffled.
    """
    repeated = set(repeated_early(df, columns))
    alive = may_be_unique(df, [c for c in columns if c not in repeated])
    header = header_table(df, columns)
    if not alive:
        return header.where("false")
    keys = with_match_key(cells(df, alive), F.col("value"), "key", filled=True)
    counted = keys.groupBy("column", "key").agg(F.count("*").alias("n"))
    single = counted.groupBy("column").agg(F.max("n").alias("most")).where("most = 1")
    return header.join(single.select("column"), "column").select("position", "column").orderBy("position")


@dataclass(frozen=True)
class KeyTable:
    """rows: (place, column, key), key NULL for an empty cell; column is the position in columns."""

    rows: DataFrame
    columns: list[str]

    def of(self, name: str) -> DataFrame:
        """(place, key) of one column."""
        return self.rows.where(F.col("column") == self.columns.index(name)).select("place", "key")


    def places(self) -> DataFrame:
        """(position): the place of every row."""
        return self.rows.where("column = 0").select(F.col("place").alias("position"))


def key_table(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> KeyTable:
    """The key table of a table, written once; at least one column."""
    names = F.array(*[F.lit(i) for i in range(len(columns))])
    values = F.expr("array(" + ", ".join(f"CAST({quoted(c)} AS STRING)" for c in columns) + ")")
    place = F.struct(*[F.col(quoted(c)).alias(c) for c in order]).alias("place")
    rows = df.select(place, F.inline(F.arrays_zip(names.alias("column"), values.alias("value"))))
    keyed = with_match_key(rows, F.col("value"), "key").select("place", "column", "key")
    return KeyTable(materialize(keyed, "keys"), list(columns))


def _distinct(key: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(key, SKETCH_BITS))


def _ruled_out(filled: Column, distinct: Column) -> Column:
    return distinct < SKETCH_PART * filled


def may_be_unique(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with values whose sketch leaves it possible that none repeats; one pass, a few rows are shuffled."""
    if not columns:
        return []
    keys = with_match_key(cells(df, columns), F.col("value"), "key")
    sketched = keys.groupBy("column").agg(F.count("key").alias("filled"), _distinct(F.col("key")).alias("distinct"))
    left = sketched.where((F.col("filled") > 0) & ~_ruled_out(F.col("filled"), F.col("distinct")))
    found = {r["column"] for r in left.select("column").collect()}
    return [c for c in columns if c in found]


def exactly_unique(table: KeyTable) -> list[str]:
    """The columns with values of which none repeats; only those that the sketch leaves are shuffled."""
    sketched = table.rows.groupBy("column").agg(F.count("key").alias("filled"), _distinct(F.col("key")).alias("distinct"))
    left = sketched.where((F.col("filled") > 0) & ~_ruled_out(F.col("filled"), F.col("distinct")))
    alive = [r["column"] for r in left.select("column").collect()]
    values = table.rows.where(F.col("column").isin(alive) & F.col("key").isNotNull())
    counted = values.groupBy("column", "key").agg(F.count("*").alias("n")).groupBy("column").agg(F.max("n").alias("most"))
    found = {r["column"] for r in counted.where("most = 1").collect()}
    return [c for i, c in enumerate(table.columns) if i in found]


@dataclass(frozen=True)
class KeyFigures:
    """Of each side: rows, filled cells by column, unique columns; overlaps of pairs of unique columns.

    Of the candidate, unique columns that share no value with the reference may be missing.
    """

    rows: tuple[int, int]
    filled: tuple[dict[str, int], dict[str, int]]
    unique: tuple[list[str], list[str]]
    overlaps: dict[tuple[str, str], int]


def key_figures(reference: KeyTable, candidate: KeyTable) -> KeyFigures:
    """Uniqueness of all columns and the overlap of every pair of unique ones.

    The sketches are one pass over the key tables; columns that they rule out, and columns of the
    candidate that share nothing with any of the reference, are not shuffled. Then equal keys are counted per column before
    the shuffle, and a key's list has one entry per column at most, so neither a hot value nor
    the number of pairs makes a heavy group.
    """
    sides = (reference, candidate)
    first = len(reference.columns)  # columns of the candidate follow those of the reference
    rows = reference.rows.select("column", "key").unionByName(
        candidate.rows.select((F.col("column") + first).alias("column"), "key")
    )
    sketched = materialize(
        rows.groupBy("column").agg(
            F.count("*").alias("rows"), F.count("key").alias("filled"), _distinct(F.col("key")).alias("distinct"),
            value_sketch(F.col("key")).alias("values"),
        ).withColumn("out", _ruled_out(F.col("filled"), F.col("distinct"))),
        "key-sketches",
    )
    stats = {r["column"]: r for r in sketched.drop("values").collect()}
    alive = [c for c, r in stats.items() if r["filled"] and not r["out"]]
    met = sketched.where(F.col("column").isin(alive))
    pairs = may_share(met.where(F.col("column") < first), met.where(F.col("column") >= first))
    # All columns of the reference are to be known as unique or not; of the candidate those that can be keys.
    alive = [c for c in alive if c < first or any(b == c for _, b in pairs)]
    counted = rows.where(F.col("column").isin(alive) & F.col("key").isNotNull()).groupBy("key", "column").agg(
        F.count("*").alias("n")
    )
    held = counted.groupBy("key").agg(F.collect_list(F.struct("column", "n")).alias("at"))
    left, right = F.filter("at", lambda x: x["column"] < first), F.filter("at", lambda x: x["column"] >= first)
    single = F.transform("at", lambda x: F.struct(x["column"].alias("a"), F.lit(-1).alias("b"), x["n"].alias("n")))
    both = F.flatten(
        F.transform(
            left,
            lambda x: F.transform(
                right, lambda y: F.struct(x["column"].alias("a"), y["column"].alias("b"), F.greatest(x["n"], y["n"]).alias("n"))
            ),
        )
    )
    figures = held.select(F.inline(F.concat(single, both))).groupBy("a", "b").agg(
        F.count("*").alias("values"), F.max("n").alias("most")
    )
    found = {(r["a"], r["b"]): r for r in figures.collect()}
    repeats = {a for (a, b), r in found.items() if b < 0 and r["most"] > 1}
    good = {a for a, b in found if b < 0} - repeats
    name = lambda c: sides[c >= first].columns[c - first * (c >= first)]
    filled = tuple({name(c): r["filled"] for c, r in stats.items() if (c >= first) == side} for side in (False, True))
    unique = tuple([c for c in side.columns if side.columns.index(c) + base in good] for side, base in zip(sides, (0, first)))
    total = tuple(stats[base]["rows"] if base in stats else 0 for base in (0, first))
    overlaps = {(name(a), name(b)): r["values"] for (a, b), r in found.items() if b >= 0 and a in good and b in good}
    return KeyFigures(total, filled, unique, overlaps)
