"""Quality rules as a short-circuit cascade of native expressions.

Each rule rejects a document. On a sample of rows the operator measures what
each rule costs and how many rows it rejects, and applies the rules in the
order of rejection per cost, so that most bad rows meet one cheap rule only.
The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """reject: SQL condition over the text column and the base measures."""

    name: str
    reject: str


#: Conditions on `_text` (never null) and the base measures. Limits are loose: ordinary prose is far from them.
DEFAULT_RULES = (
    Rule("symbols", "n_symbols > 0.4 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 0.3 * size(split(_text, '\\n'))"),
    Rule("exclamations", "length(_text) - length(replace(_text, '!', '')) > 0.5 * n_words"),
    Rule("digits", "length(_text) - length(translate(_text, '0123456789', '')) > 0.3 * word_chars"),
    Rule("capitals", "length(_text) - length(translate(_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) > 0.4 * word_chars"),
    Rule("letters", "length(regexp_replace(_text, '[^\\\\p{L}]', '')) < 0.5 * word_chars"),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser does around it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, from the words' hashes."""
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    windows = F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window))

    def covered(win: Column) -> Column:
        ranked = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(y["h"] == x["h"], F.lit(False))
        again = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        starts = F.array_sort(F.transform(_let(ranked, again), lambda x: x["i"]))
        step = lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"))
        n = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]
        return F.when(F.size(F.array_distinct(win)) < F.size(win), n)

    return F.coalesce(_let(windows, covered), F.lit(0)).cast("long")


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, and `_text` (the text, null as empty). A null or empty text
    has zero of everything and fails the base."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hashes = F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    measures = F.struct(
        _let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).alias("n_repeat_words"))).alias("words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        # Not deterministic, so a filter on a result is not pushed below and the measures are not computed again for it.
        F.monotonically_increasing_id().alias("row"),
    )
    inner = fresh("_measures", docs.columns)
    df = docs.withColumns({inner: measures, "_text": text})
    m = F.col(inner)
    df = df.withColumns({
        "n_words": m["words"]["n_words"],
        "word_chars": m["word_chars"],
        "n_symbols": m["n_symbols"],
        "n_dup_lines": m["n_dup_lines"],
        "n_repeat_words": m["words"]["n_repeat_words"],
    }).drop(inner)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = 2000, seed: int = 11) -> list[Rule]:
    """The rules in an order found on a sample of about sample_rows rows of docs that pass
    the base: the next is the one that rejects most, for its cost, of the rows that those
    before it leave. A rule's cost is the least of three timings."""
    total = docs.select().count()
    if not total or len(rules) < 2:
        return list(rules)
    sample = docs.select(F.col(f"`{text_col}`").alias("text")).sample(fraction=min(1.0, sample_rows / total), seed=seed)
    sample = base_measures(sample).filter(~F.col("base_failed")).persist()
    try:
        sample.count()
        empty = _seconds(sample, F.lit(False))
        cost = [max(_seconds(sample, F.expr(r.reject)) - empty, 1e-3) for r in rules]
        # Which rules reject a row: a number of as many bits, so as many groups at most as there are combinations.
        mask = sum((F.when(F.expr(r.reject), 2**k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
        groups = {r.mask: r.n for r in sample.groupBy(mask.alias("mask")).agg(F.count("*").alias("n")).collect()}
    finally:
        sample.unpersist()
    return [rules[k] for k in cascade_order(groups, cost)]


def cascade_order(groups: dict[int, int], cost: Sequence[float]) -> list[int]:
    """Indices of rules: greedily by rejected rows per cost, given those before. groups: rows
    by the set of rules (as bits) that reject them."""
    left, out = set(range(len(cost))), []
    groups = dict(groups)
    while left:
        best = max(left, key=lambda k: (sum(n for m, n in groups.items() if m >> k & 1) / cost[k], -cost[k], -k))
        left.remove(best)
        out.append(best)
        groups = {m: n for m, n in groups.items() if not m >> best & 1}
    return out


def _seconds(sample: DataFrame, reject: Column) -> float:
    least = float("inf")
    for _ in range(3):
        began = time.perf_counter()
        sample.agg(F.count(F.when(reject, 1))).first()
        least = min(least, time.perf_counter() - began)
    return least


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text_col: str = "text", sample_rows: int = 2000, order: Sequence[str] | None = None) -> DataFrame:
    """All rows and columns of docs, the base measures, kept, and rejected_by:
    the first rule of the cascade that rejects the row, `base`, or null.

    Nulls and empty texts fail the base. Repeated rows are judged alike. Columns
    of docs that bear the name of a result are replaced. order: names of the
    rules in the order to apply them; by default plan_cascade() finds it.
    """
    mine = fresh("_text", docs.columns)
    own = docs.withColumnRenamed("_text", mine) if "_text" in docs.columns else docs
    measured = base_measures(own, mine if text_col == "_text" else text_col)
    ranked = [next(r for r in rules if r.name == n) for n in order] if order else plan_cascade(docs, rules, text_col, sample_rows)
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ranked:
        chain = chain.when(F.expr(rule.reject), F.lit(rule.name))
    out = measured.withColumn("rejected_by", chain)
    out = out.withColumn("kept", F.col("rejected_by").isNull()).drop("_text")
    return out.withColumnRenamed(mine, "_text") if "_text" in docs.columns else out
