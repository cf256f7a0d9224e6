"""License notices in texts by diagonal voting.

Every run of words of a text (k-gram) whose hash is one of the templates' meets their positions in
an equi-join. A hit votes for a diagonal, the place in the text minus the place in the template:
an unchanged notice puts all its votes on one, a word put in or left out moves the rest to a
neighbouring one. Votes are summed by diagonal, neighbouring diagonals whose spans lie close
together are merged, and a merged span is a find if equal words (compared as text, not as
hashes) cover COVER of the template.

Short phrases that must stand word for word are templates of one k-gram, so they come out of the
same join. Before the join, each task drops the k-grams that miss a bitmap of fixed size made of
the templates' hashes; a bit shared by chance costs a row of the join and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep
from catalogq.llm.textbatch import (
    byte_ranges,
    lowered,
    mix,
    small_batches,
    spaced_words,
    span_hashes,
    split_words,
    text_bytes,
    window_hashes,
)

GRAM = 4  # words; a shorter template is one k-gram of its own length
DRIFT = 3  # words between neighbouring diagonals
NEAR = 12  # words between the spans of neighbouring diagonals
COVER = 0.8  # of a template's words
FILTER_BITS = 22
MOST_SENT = 100_000  # k-grams of templates up to which their table is sent to all tasks

_WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_GAP = np.zeros(256, bool)
_GAP[:0x30] = _GAP[0x3A:0x61] = _GAP[0x7B:0x80] = True

# Phrases that count wherever they stand word for word, and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Notices of public licenses, and their labels.
NOTICES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "cc0-1.0",
        "waived all copyright and related or neighboring rights to this work",
    ),
)


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    exact: bool  # a phrase: every place counts, and only whole

    @property
    def gram(self) -> int:
        return min(GRAM, len(self.words))


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    """Templates of (label, text) pairs; a phrase has GRAM words at most, so that it is one k-gram."""
    made = []
    for exact, pairs in ((True, phrases), (False, notices)):
        for label, text in pairs:
            words = tuple(_WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
            if not words or exact and len(words) > GRAM:
                raise ValueError(f"{text!r} has no word, or more than a phrase may have")
            made.append(Template(label, words, exact))
    return made


class _Read(NamedTuple):
    words: np.ndarray  # the number of words of each text
    owner: np.ndarray
    hashes: np.ndarray  # of each word
    data: np.ndarray  # all words, one space after each
    starts: np.ndarray
    ends: np.ndarray


def _read(texts: pa.Array) -> _Read:
    data, offsets = text_bytes(texts)
    data = lowered(data)
    gap = _GAP[data]
    found = split_words(data, offsets, gap)
    counts = np.diff(found.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    return _Read(counts, owner, span_hashes(data, found.starts, found.ends), *spaced_words(found, gap))


def _grams(read: _Read, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of so many words inside texts."""
    hashes = mix(window_hashes(read.hashes, size) + np.uint64(size))
    at = np.flatnonzero(read.owner[: len(hashes)] == read.owner[size - 1 : size - 1 + len(hashes)])
    return at, hashes[at]


_HIT = pa.struct([("at", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()), ("gram", pa.string())])


def _hit_batches(batches: Iterator[pa.RecordBatch], sizes: list[int], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All columns of a batch but its last, the text; the number of words, and the k-grams that meet the bitmap."""
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_columns - 1
        read = _read(batch.column(last))
        parts = []
        for size in sizes:
            at, hashes = _grams(read, size)
            meets = bits[hashes >> np.uint64(64 - FILTER_BITS)]
            at, hashes = at[meets], hashes[meets]
            parts.append((at, np.full(len(at), size, np.int32), hashes))
        at, size, hashes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(at, kind="stable")
        at, size, hashes = at[order], size[order], hashes[order]
        first = np.cumsum(read.words) - read.words
        grams = byte_ranges(read.data, read.starts[at], read.ends[at + size - 1])
        hits = pa.StructArray.from_arrays(
            [pa.array(at - first[read.owner[at]]), pa.array(size), pa.array(hashes.view(np.int64)), grams], fields=list(_HIT)
        )
        ends = np.zeros(batch.num_rows + 1, np.int32)
        np.cumsum(np.bincount(read.owner[at], minlength=batch.num_rows), out=ends[1:])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:last], pa.array(read.words), pa.ListArray.from_arrays(pa.array(ends), hits)],
            [*batch.schema.names[:last], "_words", "_hits"],
        )


def _positions(known: list[Template]) -> list[tuple[int, int, int, int, str]]:
    """(hash, size, template, place, gram) of all k-grams of the templates."""
    rows = []
    for number, template in enumerate(known):
        read = _read(pa.array([" ".join(template.words)]))
        at, hashes = _grams(read, template.gram)
        for place, value in zip(at.tolist(), hashes.view(np.int64).tolist()):
            rows.append((value, template.gram, number, place, " ".join(template.words[place : place + template.gram])))
    return rows


def _sent(rows: list, schema: str, spark: SparkSession) -> DataFrame:
    """A table made of a list: sent to all tasks while it is short, else left to a join that shuffles."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_SENT else table


def spans(hits: DataFrame, known: list[Template]) -> DataFrame:
    """(_row, template, start, stop, diagonal, cover) of merged diagonals.

    hits has _row, at, size, hash and gram. cover is the share of the template's words that equal words cover.
    """
    spark = hits.sparkSession
    positions = _sent(_positions(known), "hash long, size int, template int, place long, other string", spark)
    facts = _sent(
        [(i, len(t.words), t.exact) for i, t in enumerate(known)], "template int, length int, exact boolean", spark
    )
    votes = (
        hits.join(positions, ["hash", "size"])
        .where(F.col("gram") == F.col("other"))
        .select("_row", "template", "at", "place", "size", (F.col("at") - F.col("place")).alias("diagonal"))
    )
    # The words of the template that a diagonal covers are few; their number bounds the list.
    lines = votes.groupBy("_row", "template", "diagonal").agg(
        F.min("at").alias("first"), F.max(F.col("at") + F.col("size")).alias("last"),
        F.collect_set(F.struct("place", "size")).alias("places"),
    ).join(facts, "template")
    side = Window.partitionBy("_row", "template").orderBy("diagonal")
    before = lambda c: F.lag(c).over(side)
    apart = F.greatest(F.col("first") - before("last"), before("first") - F.col("last"))
    fresh = F.col("exact") | before("diagonal").isNull() | (F.col("diagonal") - before("diagonal") > DRIFT) | (apart > NEAR)
    numbered = lines.withColumn("fresh", fresh.cast("long")).withColumn("group", F.sum("fresh").over(side))
    merged = numbered.groupBy("_row", "template", "group").agg(
        F.min("first").alias("start"), F.max("last").alias("stop"), F.min("diagonal").alias("diagonal"),
        F.first("length").alias("length"), F.flatten(F.collect_list("places")).alias("places"),
    )
    covered = F.array_distinct(
        F.flatten(F.transform("places", lambda p: F.sequence(p["place"], p["place"] + p["size"] - 1)))
    )
    return merged.select("_row", "template", "start", "stop", "diagonal", (F.size(covered) / F.col("length")).alias("cover"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, known: list[Template] | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns asked for, _words and _spans of every row of docs: label, exact, start, stop and cover of each span.

    Spans of phrases are whole; those of notices are listed whatever they cover. A null text has
    no words. docs is read once; no other columns are read.
    """
    known = templates() if known is None else known
    spark = docs.sparkSession
    small_batches(spark)
    bits = np.zeros(1 << FILTER_BITS, bool)
    rows = _positions(known)
    bits[np.array([r[0] for r in rows], np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    sizes = sorted({t.gram for t in known}) or [GRAM]
    slim = docs.select(F.monotonically_increasing_id().alias("_row"), *columns, F.col("text").cast("string"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    schema = ", ".join([*fields, "_words long", "_hits array<struct<at: bigint, size: int, hash: bigint, gram: string>>"])
    shared = spark.sparkContext.broadcast(bits)  # of fixed size

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _hit_batches(batches, sizes, shared.value)

    # Written: the row numbers must be the same for the table and for its hits.
    read = keep(slim.mapInArrow(hits_of, schema), "license-hits")
    found = spans(read.select("_row", F.inline("_hits")), known)
    names = F.array(*[F.lit(t.label) for t in known]) if known else F.array().cast("array<string>")
    exact = F.array(*[F.lit(t.exact) for t in known]) if known else F.array().cast("array<boolean>")
    span = F.struct(
        F.get(names, F.col("template")).alias("label"), F.get(exact, F.col("template")).alias("exact"), "start", "stop", "cover"
    )
    listed = found.groupBy("_row").agg(F.collect_list(span).alias("_spans"))
    empty = F.array().cast("array<struct<label: string, exact: boolean, start: bigint, stop: bigint, cover: double>>")
    return read.drop("_hits").join(listed, "_row", "left").withColumn("_spans", F.coalesce("_spans", empty)).drop("_row")


def license_report(docs: DataFrame, known: list[Template] | None = None, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    Base are the phrases; the labels add the notices of which at least cover of the words are
    there. The score is the largest share of a template that a span covers, so 1 with a phrase
    and 0 without any equal k-gram. Null and empty texts have no words and empty labels; repeated
    rows and null ids come out as often as they stand; equal finds give one label; an empty table gives no rows.
    """
    found = scan(docs, known)
    base = F.filter("_spans", lambda s: s["exact"])
    good = F.filter("_spans", lambda s: s["exact"] | (s["cover"] >= cover))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        _joined(base["label"]).alias("base_labels"),
        _joined(good["label"]).alias("labels"),
        F.coalesce(F.array_max(F.col("_spans")["cover"]), F.lit(0.0)).alias("score"),
    )
