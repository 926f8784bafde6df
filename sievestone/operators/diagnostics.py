"""Rule engines over block measures: signal and noise, roles, proposals, winners, guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line classes, the first that fits; a line is matched as a whole. Lines of a docstring are none of them.
LINE_CLASSES = (
    ("comment", "^[ \\t]*(#|//|\\*|--)"),
    ("imports", "^[ \\t]*(import|from|using|include|#include|require)[ (]"),
    ("signature", "^[ \\t]*((async )?def|class|func|function|public|private|interface|struct)[ ]|^[ \\t]*@"),
    ("error", "^[ \\t]*(try|except|catch|raise|throw|finally)([ :({]|$)"),
    ("logging", "^[ \\t]*(log|logger|logging|console|print)[.(]"),
    ("control", "^[ \\t]*(if|else|elif|for|while|switch|case|return|match|with)([ :({]|$)"),
)
QUOTES = "\"\"\"|'''"
FUNCTION, CLASS = "^[ \\t]*(async )?(def|func|function)[ ]", "^[ \\t]*(class|interface|struct)[ ]"

# Action types, the smallest wins; and the rules that propose them.
ACTIONS = {"PROTECT": 1, "KEEP": 2, "COMPACT": 3, "DEDUPE": 4, "DOWNWEIGHT": 5, "DROP": 6}


@dataclass(frozen=True)
class ActionRule:
    name: str
    action: str
    confidence: float
    when: str


ACTION_RULES = (
    ActionRule("noise_drop", "DROP", 0.8, "noise > 0.45"),
    ActionRule("logging_compact", "COMPACT", 0.7, "logging_pct > 20"),
    ActionRule("docstring_compact", "COMPACT", 0.6, "docstring_pct > 30"),
    ActionRule("redundancy_dedupe", "DEDUPE", 0.75, "boilerplate > 0.7"),
    ActionRule("role_define_protect", "PROTECT", 0.9, "definitions > 0 and noise < 0.2"),
    ActionRule("role_implement_keep", "KEEP", 0.8, "functions > 0 and signal > 0.3"),
    ActionRule("role_noise_downweight", "DOWNWEIGHT", 0.6, "noise > 0.3 and signal < 0.4"),
)


def line_class(line: Column) -> Column:
    out = None
    for name, pattern in LINE_CLASSES:
        hit = line.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("code")


def line_kinds(lines: Column) -> Column:
    """The class of each line, read in order: from a line that opens a docstring to the one that
    closes it all are docstring; a line with both is by itself."""

    def step(state: Column, line: Column) -> Column:
        quotes = F.size(F.regexp_extract_all(line, F.lit(f"({QUOTES})"), F.lit(1)))
        opens = line.rlike(f"^[ \\t]*[rRbBuU]?({QUOTES})")
        inside = state["inside"]
        kind = F.when(inside | opens, "docstring").otherwise(line_class(line))
        after = F.when(inside, quotes == 0).otherwise(opens & (quotes < 2))
        return F.struct(after.alias("inside"), F.concat(state["kinds"], F.array(kind)).alias("kinds"))

    return F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kinds")), step)["kinds"]


def composition(blocks: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, n_lines, and the percentage of each class of line with text; boilerplate is the
    share of lines over 20 characters that repeat an earlier one of the block."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    long = F.filter(lines, lambda x: F.length(F.trim(x)) > 20)
    x = blocks.select(key, *keep, lines.alias("l"), long.alias("long"))
    x = x.withColumn("kinds", line_kinds(F.col("l")))
    n = F.size("l")
    share = lambda name: F.when(n == 0, 0.0).otherwise(F.size(F.filter("kinds", lambda k: k == name)) * 100.0 / n)
    out = {f"{name}_pct": share(name) for name in ("comment", "logging", "imports", "signature", "error", "control", "code", "docstring")}
    m = F.size("long")
    of = F.arrays_zip("kinds", "l")
    count = lambda pattern: F.size(F.filter(of, lambda z: (z["kinds"] == "signature") & z["l"].rlike(pattern)))
    measures = F.struct(
        n.alias("n_lines"), *[c.alias(k) for k, c in out.items()],
        F.when(m == 0, 0.0).otherwise((m - F.size(F.array_distinct("long"))) / m).alias("boilerplate"), count(FUNCTION).alias("functions"), count(CLASS).alias("classes"),
        # Not deterministic, so no filter on a measure is pushed below, where the lines would be read again for it.
        F.monotonically_increasing_id().alias("row"),
    )
    names = ("n_lines", *out, "boilerplate", "functions")
    return x.select(key, *keep, measures.alias("_m")).select(key, *keep, *[F.col(f"_m.{c}") for c in names], (F.col("_m.functions") + F.col("_m.classes")).alias("definitions"))


def warnings(measured: DataFrame) -> Column:
    """What stands out in a block."""
    c = F.col
    all_ = (
        F.when(c("signal") < 0.3, "noise"), F.when(c("comment_pct") > 40, "comments"), F.when(c("logging_pct") > 20, "logging"),
        F.when(c("error_pct") > 30, "error_handling"), F.when(c("boilerplate") > 0.3, "repeats"),
    )
    return F.array_compact(F.array(*all_))


def signal_noise(measures: DataFrame) -> DataFrame:
    """Add signal and noise, each a share of 1; half each for a block with neither."""
    s = F.col("code_pct") + F.col("control_pct") + 0.5 * F.col("signature_pct")
    n = 0.5 * F.col("comment_pct") + F.col("logging_pct") + F.col("imports_pct") + 0.3 * F.col("docstring_pct") + 20 * F.col("boilerplate")
    none = (s + n) == 0
    # Rounded in binary: 0.575 is a little less than that.
    cap = lambda c: F.floor(F.least(F.lit(1.0), c / 100) * 100 + 0.5) / 100
    return measures.withColumns({"signal": F.when(none, 0.5).otherwise(cap(s)), "noise": F.when(none, 0.5).otherwise(cap(n))})


def propose(measured: DataFrame, key: str, rules=ACTION_RULES) -> DataFrame:
    """(key, rule, action, priority, confidence): what each rule proposes for each block."""
    all_rules = F.array(*[F.when(F.expr(r.when), F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(ACTIONS[r.action]).alias("priority"), F.lit(r.confidence).alias("confidence"))) for r in rules])
    return measured.select(key, F.explode(F.filter(all_rules, lambda x: x.isNotNull())).alias("p")).select(key, "p.*")


def propose_plans(measured: DataFrame, target: str, plans: tuple[tuple[ActionRule, ...], ...]) -> DataFrame:
    """(action, target, priority, confidence, plan): what the rules of several plans propose, by one reading of the measures."""
    each = [F.when(F.expr(r.when), F.struct(F.lit(r.action).alias("action"), F.lit(ACTIONS[r.action]).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(i).alias("plan"))) for i, rules in enumerate(plans) for r in rules]
    return measured.select(target, F.explode(F.array(*each)).alias("p")).filter("p is not null").select("p.action", target, "p.priority", "p.confidence", "p.plan")


def winners(proposals: DataFrame, key: str) -> DataFrame:
    """Of each block the action of the smallest type, then the greatest confidence, then by rule."""
    best = F.min_by(F.struct("rule", "action", "confidence"), F.struct("priority", -F.col("confidence"), "rule"))
    return proposals.groupBy(key).agg(best.alias("w"), F.count("*").alias("n_proposals")).select(key, "w.*", "n_proposals")


def apply_actions(blocks: DataFrame, actions: DataFrame, key: str, most_removed: float = 0.8) -> DataFrame:
    """Blocks without those to DROP or DEDUPE; if that were more than most_removed of all, all stay."""
    gone = actions.filter(F.col("action").isin("DROP", "DEDUPE")).select(key).distinct()
    total = blocks.agg(F.count("*").alias("_n"))
    out = gone.join(blocks.select(key), key, "left_semi").agg(F.count("*").alias("_gone"))
    # Two rows of one number each: the size of these broadcasts is fixed.
    guard = total.join(F.broadcast(out)).select((F.col("_gone") <= most_removed * F.col("_n")).alias("_ok"))
    marked = blocks.join(gone.withColumn("_drop", F.lit(True)), key, "left").join(F.broadcast(guard))
    return marked.filter(~(F.coalesce("_drop", F.lit(False)) & F.col("_ok"))).drop("_drop", "_ok")


def roles(measured: DataFrame, key: str) -> DataFrame:
    """key, role, score: the explanatory role with the highest score; of equal ones the first
    of DEFINE, IMPLEMENT, EXPLAIN, SUPPORT, NOISE."""
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    c = F.col
    scores = {
        "DEFINE": one(c("definitions") > 0, 0.5) + one(c("signature_pct") > 20, 0.3),
        "IMPLEMENT": one(c("code_pct") > 40, 0.5) + one(c("control_pct") > 10, 0.2),
        "EXPLAIN": one(c("docstring_pct") > 30, 0.5) + one(c("comment_pct") > 20, 0.3),
        "SUPPORT": one(c("error_pct") > 15, 0.4),
        "NOISE": one(c("logging_pct") > 20, 0.5) + one(c("noise") > 0.4, 0.3) + one(c("signal") < 0.3, 0.2),
    }
    listed = F.array(*[F.struct(F.round(s, 3).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("role")) for i, (n, s) in enumerate(scores.items())])
    return measured.select(key, F.array_max(listed).alias("r")).select(key, "r.role", "r.score")


def sufficiency(counts: DataFrame, key: str, candidates: str, blocks: str, min_candidates: int, min_blocks: int) -> DataFrame:
    """key, sufficient, score, missing (sorted reasons)."""
    c, b = F.col(candidates), F.col(blocks)
    missing = F.filter(F.array(F.when(c == 0, "empty_evidence"), F.when(c < min_candidates, "insufficient_candidates"), F.when(b < min_blocks, "insufficient_context_blocks")), lambda x: x.isNotNull())
    score = (F.least(c / max(min_candidates, 1), F.lit(1.0)) + F.least(b / max(min_blocks, 1), F.lit(1.0))) / 2
    return counts.select(key, (F.size(missing) == 0).alias("sufficient"), F.round(score, 3).alias("score"), F.array_join(missing, ",").alias("missing"))


def repeated_headings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, heading, n): # headings that a text holds more than once, letter case aside."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("^#{1,6}[ ]+[^ ]"))
    each = texts.select(key, F.explode(F.transform(lines, lambda x: F.lower(F.trim(F.regexp_replace(x, "^#+", ""))))).alias("heading"))
    return each.groupBy(key, "heading").agg(F.count("*").alias("n")).filter("n > 1")


def missing_items(required: DataFrame, present: DataFrame, key: str, item: str) -> DataFrame:
    """Required (key, item) rows that are not present."""
    return required.join(present.select(key, item).distinct(), [key, item], "left_anti")
