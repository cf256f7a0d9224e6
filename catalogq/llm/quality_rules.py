"""Quality rules whose cutoffs carry a guarantee on the good documents they reject.

Base rules are fixed: too few words, or too many words inside repeated 8-word windows. The
method adds one cutoff per rule and stratum (the language). All cutoffs of a rule's grid are
tested on the labelled documents, from the mildest to the strictest, until the first that
fails: the test's hypothesis "this cutoff rejects more than RISK / rules of the good documents
of the stratum" is refused if the exact binomial tail P(X <= rejected good) is at most
LEVEL / (strata * rules). Testing in a fixed order needs no further correction, so with
probability 1 - LEVEL every cutoff that passed keeps its bound in every stratum, and all rules
together reject at most RISK of the good documents of any stratum. Among the cutoffs that
passed, the one with the largest difference of rejected shares (bad - good) is used; a rule
that catches nothing, or a stratum with too few labels, gets none.

Everything is DataFrame functions. 8-word windows are compared by 64-bit hashes within a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogq.llm.scratch import keep

RISK = 0.05  # of the good documents of a stratum, over all rules
LEVEL = 0.05  # chance that any bound fails
WINDOW = 8  # words
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[^#*$%&|<>]+"

# rule: (measure, cutoffs from mild to strict); a document at or above its cutoff is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("_symbols / greatest(_chars, 1)", (0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.06, 0.03)),
    "capitals": ("_capitals / greatest(_chars, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "shouts": ("_shouts / greatest(_words, 1)", (2.0, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1)),
    "stutter": ("_stutter / greatest(_words, 1)", (0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "dup_lines": ("_dup_lines / greatest(_lines, 1)", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("_repeats / greatest(_words, 1)", (0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times inside one expression, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _neighbours(items: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """pair(x, next) for all neighbours of an array with at least one element."""
    last = F.size(items) - 1
    return F.zip_with(F.slice(items, F.lit(1), last), F.slice(items, F.lit(2), last), pair)


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs more than once."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = _let(
        ordered,
        lambda s: _neighbours(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array())),
    )
    places = F.sort_array(F.array_distinct(F.flatten(twins)))
    steps = _let(places, lambda p: _neighbours(p, lambda a, b: F.least(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(WINDOW), lambda n, x: n + x)


def measured(docs: DataFrame) -> DataFrame:
    """The rows with _words, _chars, _symbols, _dup_lines, _repeats and the measures of the other rules.

    A null text counts as empty; all measures are then 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = docs.withColumns(
        {
            "_list": F.filter(F.split(text, _GAP, -1), lambda w: w != ""),
            "_rows": F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(_WORD))),
            "_chars": F.length(F.regexp_replace(text, _GAP, "")).cast("long"),
            "_symbols": F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long"),
            "_capitals": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
            "_shouts": F.length(F.regexp_replace(text, "[^!]+", "")).cast("long"),
        }
    )
    words = F.size("_list")
    window = lambda i: F.xxhash64(F.slice("_list", i, WINDOW))
    parts = parts.withColumns(
        {
            "_words": words.cast("long"),
            "_lines": F.size("_rows").cast("long"),
            "_dup_lines": (F.size("_rows") - F.size(F.array_distinct("_rows"))).cast("long"),
            "_stutter": F.when(
                words > 1, F.size(F.filter(_neighbours(F.col("_list"), lambda a, b: a == b), lambda same: same))
            ).otherwise(0).cast("long"),
            "_windows": F.when(
                words > WINDOW, F.transform(F.sequence(F.lit(1), words - (WINDOW - 1)), window)
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    repeats = F.when(unique, 0).otherwise(_repeated_words(F.col("_windows"))).cast("long")
    return parts.withColumn("_repeats", repeats).drop("_list", "_rows", "_windows")


MEASURES = ("_words", "_chars", "_symbols", "_capitals", "_shouts", "_lines", "_dup_lines", "_stutter", "_repeats")


def _tail(rejected: Column, n: Column, risk: float) -> Column:
    """P(X <= rejected) for X binomial (n, risk), summed in logarithms."""
    odds = F.lit(risk / (1 - risk))
    start = F.struct((n * F.log1p(F.lit(-risk))).alias("term"), (n * F.log1p(F.lit(-risk))).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(s["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(s["total"], term) - top))).alias("total"))

    terms = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<bigint>"))
    whole = F.aggregate(terms, start, step, lambda s: F.exp(s["total"]))
    return F.when(rejected >= n * risk, 1.0).otherwise(whole)  # at or above the mean the tail is never small


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(_stratum, _cut_<rule> ...): the certified cutoffs; null where there is none.

    measures has doc_id, _stratum and the measures; labels has doc_id and quality (1 good, 0 bad).
    Of several labels of a document the worst counts. Null labels and ids are left out.
    """
    spark = measures.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("_quality")
    )
    level_of = lambda name: F.size(
        F.filter(F.array(*[F.lit(c) for c in RULES[name][1]]), lambda c: c <= F.expr(RULES[name][0]))
    )
    rated = measures.join(known, "doc_id").select(
        "_stratum",
        (F.col("_quality") >= 1).alias("good"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), level_of(n).alias("level")) for n in RULES])).alias("x"),
    )
    # At most strata x rules x cutoffs x 2 rows from here on.
    counted = keep(rated.groupBy("_stratum", "x.rule", "x.level", "good").agg(F.count("*").alias("n")), "rated")
    tests = counted.where("good").select("_stratum").distinct().count() * len(RULES)
    cells = [(name, i + 1, c, len(cs) - i) for name, (_, cs) in RULES.items() for i, c in enumerate(cs)]
    names = ("rule", "place", "cutoff", "least")
    listed = [F.struct(*[F.lit(x).alias(n) for x, n in zip(cell, names)]) for cell in cells]
    grid = spark.range(1).select(F.inline(F.array(*listed)))
    hit = F.when(F.col("level") >= F.col("least"), F.col("n")).otherwise(0)
    good = F.when(F.col("good"), 1).otherwise(0)
    tested = counted.join(F.broadcast(grid), "rule").groupBy("_stratum", "rule", "place", "cutoff").agg(
        F.sum(good * F.col("n")).alias("good"),
        F.sum(good * hit).alias("good_hit"),
        F.sum((1 - good) * F.col("n")).alias("bad"),
        F.sum((1 - good) * hit).alias("bad_hit"),
    )
    tail = _tail(F.col("good_hit"), F.col("good"), risk / len(RULES))
    in_order = Window.partitionBy("_stratum", "rule").orderBy("place")
    passed = (
        tested.withColumn("ok", (F.col("good") > 0) & (tail <= level / max(tests, 1)))
        .withColumn("ok", F.min("ok").over(in_order))
        .where(F.col("ok") & (F.col("bad_hit") > 0))
    )
    gain = F.col("bad_hit") / F.col("bad") - F.col("good_hit") / F.col("good")
    best = passed.groupBy("_stratum", "rule").agg(
        F.max_by("cutoff", F.struct(gain, -F.col("place"))).alias("cutoff")
    )
    return best.groupBy("_stratum").agg(
        *[F.max(F.when(F.col("rule") == n, F.col("cutoff"))).alias(f"_cut_{n}") for n in RULES]
    )


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of measured() with _stratum, and _base_failed and _kept."""
    failed = (F.col("_words") < LEAST_WORDS) | (100 * F.col("_repeats") > MOST_REPEATED * F.col("_words"))
    beyond = F.lit(False)
    for name, (measure, _) in RULES.items():
        beyond = beyond | F.coalesce(F.expr(measure) >= F.col(f"_cut_{name}"), F.lit(False))
    return rows.join(found, "_stratum", "left").withColumns({"_base_failed": failed, "_kept": ~failed & ~beyond})


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_stratum")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base measures, base_failed and kept of every row of docs (doc_id, text, lang).

    Null texts have no words and fail the base rule; a null lang is a stratum of its own;
    repeated rows are judged alike; empty tables give an empty result.
    """
    slim = keep(measured(docs.select("doc_id", "text", _stratum(docs))).select("doc_id", "_stratum", *MEASURES), "measures")
    # Written, so that the size of the table of cutoffs is known before it may be broadcast.
    found = keep(cutoffs(slim, labels), "cutoffs")
    return judged(slim, found).select(
        "doc_id",
        F.col("_words").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.col("_dup_lines").alias("n_dup_lines"),
        F.col("_repeats").alias("n_repeat_words"),
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names."""
    row = F.struct(*docs.columns).alias("_row")
    # Written with the measures: those are long expressions, and both steps read them.
    rows = keep(measured(docs.select(row, "doc_id", "text", _stratum(docs))).drop("text"), "measured")
    found = keep(cutoffs(rows.select("doc_id", "_stratum", *MEASURES), labels), "cutoffs")
    return judged(rows, found).where("_kept").select("_row.*")
