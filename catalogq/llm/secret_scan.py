"""Secrets in whole texts, found through an inverted index of trigrams.

Each rule is a regular expression. From it follows a Boolean query over trigrams: an OR of
clauses, each an AND of the trigrams that any match of that alternative must contain. The
index holds (trigram, row key) for the trigrams that some query asks for; the postings of a
clause are intersected by counting them per row, and only rows that satisfy a clause of a
rule are run through its expression. A rule without mandatory trigrams is run on all rows.

Everything is DataFrame functions. The index is of lower-cased text, so it serves rules with
and without case. A row's key is a hash of doc_id and text: a collision or a repeated row can
only add candidates, and every span comes from the expression itself.
"""

from __future__ import annotations

from re import _constants as kinds
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep

ALTERNATIVES = 64  # beyond so many clauses, a part of an expression counts as a gap


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # code points of that group


# The three base kinds, in the order of their listing. A run of the last class is
# as long as it can be, so the least length can stand in the expression of access and hex; a
# short value of assign still uses up its text, so there it is checked afterwards.
BASE = (
    Rule(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Spans that the index adds to the base ones.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # All starts inside one run of such characters match or fail together, so only the first is tried.
    Rule("jwt", r"eyJ(?<!eyJ[A-Za-z0-9_-]{0,500}eyJ)[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("login_url", r"(?<![a-z])[a-z]++://[A-Za-z0-9._-]++:[A-Za-z0-9._-]++@[A-Za-z0-9.-]+"),
)
RULES = BASE + ADDED
# For masking, a private key is all from its BEGIN line through its END line, and without END the
# headers and base64 lines that follow. The report has the BEGIN line alone, as its SQL does.
_NEXT = r"(?:\s|\\[nr])*+"
_BODY = (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_NEXT}(?:Proc-Type|DEK-Info|[A-Z][A-Za-z-]*+): ?[A-Za-z0-9, -]++(?=\s|\\|$))*+"
    rf"(?:{_NEXT}[A-Za-z0-9+/=]{{16,}}+)++(?:{_NEXT}(?=[A-Za-z]*[0-9+/=]|[A-Za-z]++\s*+(?:\n|\\n|$))[A-Za-z0-9+/=]++)?+)?+"
)
MASKED = tuple(r._replace(pattern=r.pattern + _BODY) if r.kind == "private_key" else r for r in RULES)
GAP = None


def _literals(tree) -> list[tuple]:
    """The alternatives of a parsed expression, each a tuple of characters and gaps."""
    found: list[tuple] = [()]
    for op, value in tree:
        if op is kinds.LITERAL:
            part = [(chr(value).lower(),)]
        elif op is kinds.IN and {k for k, _ in value} == {kinds.LITERAL}:
            letters = {chr(v).lower() for _, v in value}
            part = [(x,) for x in sorted(letters)] if len(letters) <= 5 else [(GAP,)]
        elif op is kinds.SUBPATTERN:
            part = _literals(value[-1])
        elif op is kinds.BRANCH:
            part = [x for branch in value[1] for x in _literals(branch)]
        elif op is kinds.MAX_REPEAT and value[:2] == (0, 1) and len(value[2]) == 1 and value[2][0][0] is kinds.LITERAL:
            part = [(), *_literals(value[2])]
        elif op is kinds.MAX_REPEAT and value[0] >= 1:
            part = [(*x, GAP) for x in _literals(value[2])]
        else:
            part = [(GAP,)]
        product = [a + b for a in found for b in part]
        found = product if len(product) <= ALTERNATIVES else [(*a, GAP) for a in found]
    return found


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Clauses of trigrams of which a match has all of at least one; None if a match may have none."""
    clauses = set()
    for alternative in _literals(parser.parse(pattern)):
        grams = {
            "".join(alternative[i : i + 3]) for i in range(len(alternative) - 2) if GAP not in alternative[i : i + 3]
        }
        if not grams:
            return None
        clauses.add(frozenset(grams))
    least = [c for c in clauses if not any(d < c for d in clauses)]
    return sorted(sorted(c) for c in least)


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, _key) for every row and every listed trigram that its text contains."""
    low = rows.select("_key", F.lower("_text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("_key", F.explode(held).alias("gram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(_key, _rules): the rules with mandatory trigrams whose query a row satisfies."""
    terms = []
    for rule in rules:
        for number, clause in enumerate(trigram_query(rule.pattern) or []):
            terms += [(rule.kind, number, gram, 1 << i, (1 << len(clause)) - 1) for i, gram in enumerate(clause)]
    if not terms:
        return None
    names = ("rule", "clause", "gram", "bit", "whole")
    listed = [F.struct(*[F.lit(x).alias(n) for x, n in zip(t, names)]) for t in terms]
    clauses = rows.sparkSession.range(1).select(F.inline(F.array(*listed)))
    met = (
        postings(rows, sorted({t[2] for t in terms}))
        .join(F.broadcast(clauses), "gram")  # one row per trigram of a rule
        .groupBy("_key", "rule", "clause", "whole")
        .agg(F.bit_or(F.col("bit").cast("long")).alias("bits"))
        .where("bits = whole")
    )
    return met.groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches that don't overlap, from the texts between them; short ones are then dropped."""
    between = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.transform(
        F.arrays_zip(
            F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"), sized.alias("part")
        ),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")
        ),
    )
    none = F.lit(None).cast("array<struct<start:int,rank:int,stop:int,size:int>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array()).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        span = F.struct(
            begin.alias("start"), F.lit(order).alias("rank"), (begin + x["hit"]).alias("stop"), x["part"].alias("size")
        )
        return F.struct((begin + x["hit"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(lengths, start, step, lambda state: F.filter(state["spans"], lambda s: s["size"] >= rule.least))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_row (all columns of docs, whatever their names), _text, and _spans: [(start, rank, stop, size)] by start and rule.

    Offsets are code points, the end exclusive; rank is the rule's place in rules. A null text
    counts as empty; rows may repeat, and doc_id may be null.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
        F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("_key"),
    )
    scanned = [r.kind for r in rules if trigram_query(r.pattern) is None]
    chosen = candidates(rows, rules)
    if chosen is not None:
        # Written first: few rows have any, so Spark sees that the list is short and leaves the texts where they are.
        chosen = keep(chosen, "candidates")
    no_rules = F.array().cast("array<string>").alias("_rules")
    rows = rows.select("*", no_rules) if chosen is None else rows.join(chosen, "_key", "left")
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,size:int>>")
    text, found = F.col("_text"), []
    for order, rule in enumerate(rules):
        wanted = F.rlike(text, F.lit(rule.pattern))
        if rule.kind not in scanned:
            # Never NULL: with NULL on its left, AND would run the expression on every text.
            wanted = F.coalesce(F.array_contains("_rules", rule.kind), F.lit(False)) & wanted
        found.append(F.when(wanted, _spans(text, rule, order)).otherwise(empty))
    return rows.select("_row", "_text", F.sort_array(F.concat(*found)).alias("_spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kind = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))
        ),
        ",",
    )


def scan_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each document."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("_spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "_row.doc_id",
        *[count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE)],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("_spans")).alias("spans"),
    )


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap give one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        added = F.concat(F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(state["out"], added)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(
        spans, start, step, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text)))
    )
