"""Rule classifiers of queries: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import portable

# The patterns of each class, in the order in which the classes are tried.
INTENT_RULES = (
    ("refactor", ("\\brefactor\\b", "\\brestructure\\b", "\\brename\\b", "\\bextract\\b", "\\bclean\\s*up\\b")),
    ("implement", ("\\bimplement\\b", "\\badd\\b", "\\bbuild\\b", "\\bcreate\\b", "\\bwrite\\b", "\\bdesign\\b", "\\bhow\\s+should\\b", "\\bwhat\\s+should\\b")),
    ("search", ("\\bcompare\\b", "\\bversus\\b", "\\bvs\\.?\\b", "\\bdifference(?:s)?\\b", "\\bwhere\\s+is\\b", "\\bwhere\\s+are\\b", "\\blocate\\b", "\\bfind\\b", "\\bwhich\\s+file\\b")),
    ("debug", ("\\bwhy\\s+does\\b", "\\bwhat\\s+causes\\b", "\\bdebug\\b", "\\berror\\b", "\\bexception\\b", "\\bbug\\b", "\\bfail(?:s|ed|ure)?\\b", "\\bmissing\\b", "\\bmismatch(?:ed)?\\b", "\\btimeout\\b", "\\btime\\s*out\\b", "\\bnan\\b", "\\binvalid\\b")),
    ("explain", ("\\bhow\\b", "\\bwhat\\b", "\\bwhy\\b", "\\bdescribe\\b", "\\btrace\\b", "\\bsummarize\\b", "\\blifecycle\\b", "\\bflow\\b", "\\bsequence\\b")),
)
QUERY_TYPE_RULES = (
    ("trace", ("\\b(trace|execution flow|lifecycle|step.by.step|flow|propagat|sequence)\\b",)),
    ("comparison", ("\\b(compare|tradeoff|trade.off|versus|vs\\.?|difference|when to use|which|pros.and.cons)\\b",)),
    ("error_handling", ("\\b(error|exception|fail|bug|handle|edge.case|what.happens.when|nan|missing|invalid)\\b",)),
)
SUFFICIENCY_RULES = (
    ("ARCHITECTURAL", ("\\b(how\\s+do(es)?\\s+.*\\s+combine|all\\s+\\d+\\s+rules?|lifecycle|execution\\s+flow|trace\\s+.*\\s+flow|layers?|priority\\s+order|conflict(s)?\\s+between|optimization\\s+rules?|plan\\s+caching|execution\\s+timing)\\b",)),
    ("BEHAVIORAL", ("\\b(behave|behavior|when\\s+all\\s+connections?\\s+(are\\s+)?in\\s+use|wait\\s+or\\s+time\\s+out|time\\s+out|callers?\\s+wait)\\b",)),
    ("IMPLEMENTATION", ("\\b(how\\s+does\\s+\\w+\\s+work|what\\s+happens\\s+when|method|function|implement|resolve|handle\\s+partial|at-least-once|semantics?)\\b",)),
)
HIGH_COMPLEXITY = ("\\btrace\\b", "\\bflow\\b", "\\bacross\\b", "\\bend[-\\s]*to[-\\s]*end\\b", "\\bchain\\b", "\\bsequence\\b", "\\bpipeline\\b", "\\bmulti[-\\s]*hop\\b", "\\ball\\s+\\d+\\b")
MEDIUM_COMPLEXITY = ("\\ball\\b", "\\bcompare\\b", "\\bbetween\\b", "\\bwhen\\b", "\\bhow\\s+do(?:es)?\\b", "\\bcombine\\b")
NAMED_COMPONENT = "\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\\b|\\b[a-z]+_[a-z]+\\b|\\b[A-Z]+_[A-Z0-9_]+\\b|\\bL\\d+\\b"
COMPLEX_MARKERS = (" through all ", " all layers ", " including ", " trace ", " debug ", " failure ", " failures ", " fallback ", " fallbacks ", " lifecycle ", " end-to-end ", " interaction ", " interactions ", " combine ", " combines ")
MANDATORY_AXES = {
    "ARCHITECTURAL": ("STRUCTURAL", "SEMANTIC"),
    "BEHAVIORAL": ("RULE", "SEMANTIC"),
    "IMPLEMENTATION": ("RULE", "STRUCTURAL", "SEMANTIC"),
    "UNKNOWN": ("RULE", "STRUCTURAL", "SEMANTIC"),
}


def first_rule(text: Column, rules, default: str) -> Column:
    """The name of the first class any of whose patterns is found, letter case aside."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, patterns in rules:
        found = lowered.rlike(portable("|".join(f"(?:{p})" for p in patterns)))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(default)


def retrieval_intent(query: Column) -> Column:
    return first_rule(query, INTENT_RULES, "unknown")


def query_type(query: Column) -> Column:
    return first_rule(query, QUERY_TYPE_RULES, "explanation")


def sufficiency_intent(query: Column) -> Column:
    return first_rule(query, SUFFICIENCY_RULES, "UNKNOWN")


def mandatory_axes(intent: Column) -> Column:
    out = None
    for name, axes in MANDATORY_AXES.items():
        value = F.array(*map(F.lit, axes))
        out = F.when(intent == name, value) if out is None else out.when(intent == name, value)
    return out


def pattern_count(text: Column, patterns) -> Column:
    """How many of the patterns are found."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(lowered.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))


def named_components(query: Column) -> Column:
    """Distinct camel-case, snake-case, upper-case and L<number> names, letter case aside."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(f"({NAMED_COMPONENT})"), F.lit(1))
    return F.size(F.array_distinct(F.transform(found, F.lower)))


def required_k(query: Column) -> Column:
    """How many rows to retrieve: 80 for synthesis, 65 for medium queries, else 50."""
    named, high, medium = named_components(query), pattern_count(query, HIGH_COMPLEXITY), pattern_count(query, MEDIUM_COMPLEXITY)
    return F.when((named >= 3) | (high >= 2) | ((high >= 1) & (medium >= 1)), 80).when((high >= 1) | (medium >= 2) | (named >= 2), 65).otherwise(50)


def looks_complex(query: Column) -> Column:
    """18 words or more, or a marker of a broad question."""
    q = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(query, F.lit("")))), F.lit(" "))
    words = F.size(F.filter(F.split(q, "\\s+"), lambda x: x != ""))
    marked = F.lit(False)
    for m in COMPLEX_MARKERS:
        marked = marked | q.contains(m)
    return (words >= 18) | marked


# Patterns of the depth that a question asks for, and the label of each class.
DEPTH_RULES = (
    ("ILLUSTRATIVE", ("\\b(show\\s+me|example|sample\\s+code|illustrate|demonstrate|give\\s+an?\\s+example|code\\s+sample|concrete\\s+example)\\b",)),
    ("EXPLANATORY", ("\\b(why\\b|how\\s+does|how\\s+do\\b|how\\s+do\\s+we|explain|reason\\s+why|step\\s+by\\s+step|step-by-step|causal|because\\s+of|what\\s+causes|why\\s+does|mechanism|underlying|execution\\s+flow|trace\\s+.*\\s+flow|through\\s+all\\s+layers?|lifecycle)\\b",)),
    ("DEBUGGING", ("\\b(error|exception|fails?|happens\\s+when|execution\\s+path|edge\\s+case|failure\\s+mode|debug|traceback|stack)\\b",)),
)
DEPTH_LABELS = {"ILLUSTRATIVE": "EXAMPLE_RECOMMENDED", "EXPLANATORY": "DETAILED_REQUIRED", "DEBUGGING": "DETAILED_REQUIRED", "FACTUAL": "SHALLOW_OK"}


def depth_intent(query: Column) -> Column:
    return first_rule(query, DEPTH_RULES, "FACTUAL")


def depth_label(depth: Column) -> Column:
    out = None
    for name, label in DEPTH_LABELS.items():
        out = F.when(depth == name, label) if out is None else out.when(depth == name, label)
    return out


def route(intent: Column, complex_: Column) -> Column:
    """Tasks that change code, and broad explanations, are worked on in several read-only
    passes; all else in one."""
    several = intent.isin("implement", "refactor", "debug") | ((intent == "explain") & complex_)
    return F.when(several, "read_only_agentic").otherwise("single_pass")
