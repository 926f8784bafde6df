"""Column functions for questions, identifiers, claims and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell nothing of a claim, of a concept, of a rule; names that are no identifiers.
CLAIM_STOPWORDS = "the a an and or to of in on for with how what when where which does do is are all through between across from that this system handle handles check checks exist exists work works".split()
CONCEPT_STOPWORDS = "what when where which who whom why how does do did is are was were be been the a an and or but if then than this that these those with without about into from to of for in on at by all any each every some most many few".split()
RULE_STOPWORDS = "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare to of in for on with at by from as into through during before after above below how what when where which who and or but".split()
SECTION_STOPWORDS = "a an and are as at be by for from in is it of on or that the this to with will would should when what which who whom whose why how where there their they them its it's not no nor but so if then else than too very all any both each few more most other some such only own same your you we us our".split()
GENERIC_TERMS = "compare comparison contrast difference differences tradeoff tradeoffs interaction interactions".split()
NOT_IDENTIFIERS = "how what when where why which who".split()

# Patterns of identifiers; suffixes in the order in which the first that fits is cut; terms that a claim's term brings along.
IDENTIFIER_HINT = "\\b[A-Z][A-Za-z0-9_]+(?:\\.[A-Za-z0-9_]+)?\\b|\\b[A-Z][A-Z0-9_]{2,}\\b|\\b[a-z]+_[a-z0-9_]+\\b|\\b[A-Za-z0-9_]+\\.py\\b"
QUERY_IDENTIFIER = "\\b[A-Z][a-zA-Z0-9]+\\b|\\b[a-z]+_[a-z0-9_]+\\b|\\b[A-Z][A-Z0-9_]{2,}\\b"
SUFFIXES = "ations ation ments ment ings ing ized izer izers ers er ed es s".split()
TERM_EXPANSIONS = {"pool": ("connection",), "latency": ("duration", "timing"), "percentil": ("p50", "p95", "p99"), "cache": ("hit", "miss", "eviction"), "distribution": ("hit", "miss")}

# Claim intents with the words that mark them, their terms and their priority; the last is the default.
CLAIM_INTENTS = (
    ("ERROR_FALLBACK", ("error", "fallback", "retry", "fail", "miss"), ("error", "fallback", "failure"), 3),
    ("TRACE", ("trace", "flow", "sequence", "pipeline", "end-to-end"), ("flow", "sequence", "step"), 0),
    ("COMPARE", ("compare", "contrast", "vs", "difference"), ("compare", "difference", "tradeoff"), 2),
    ("ORDER_PRIORITY", ("priority", "order", "precedence", "resolve conflict"), ("order", "priority", "before", "after"), 2),
    ("HOW_IT_WORKS", ("how",), ("implementation", "behavior", "logic"), 1),
    ("BEHAVIOR_EXISTS", (), ("implementation", "behavior"), 1),
)
CLAIM_SPLIT = "(?i)\\s*(?:,|;|\\band\\b|\\bor\\b)\\s*"

# Shapes of questions by what they contain, and the domains with their keywords.
SHAPES = (
    ("comparison", ("compare", "contrast", " vs ", " versus ")),
    ("flow", ("trace", "flow", "sequence", "pipeline", "through all layers", "end-to-end")),
    ("system_scope", ("across the system", "across components", "across layers", "across adapters", "across the stack")),
)
SYSTEM_MARKERS = ("fallback", "fallbacks", "checks", "missing", "handle")
INTERACTION_MARKERS = ("combine", "interact", "interaction", "priority", "order", "precedence", "resolve conflict")
DOMAINS = (
    ("database", ("database", "db", "sql", "sqlite", "postgres", "pool", "connection")),
    ("cache", ("cache", "redis", "ttl", "lru", "lfu")),
    ("monitoring", ("metrics", "histogram", "percentile", "latency", "p95", "p99", "timer", "trace", "tracing")),
    ("optimization", ("optimizer", "optimization", "plan", "planner", "join", "cost")),
    ("security", ("auth", "jwt", "token", "permission")),
    ("async_jobs", ("job", "queue", "worker", "retry", "batch")),
    ("search", ("search", "ranking", "rerank", "similarity", "embedding", "index")),
    ("api", ("api", "endpoint", "route", "http")),
)
LEVEL3_INTENTS = (
    ("compare", ("\\bcompare\\b", "\\bdifference\\s+between\\b", "\\bvs\\.?\\b", "\\bversus\\b", "\\bor\\b.*\\bor\\b")),
    ("why", ("\\bwhy\\s+does\\b", "\\bwhy\\s+do\\b", "\\bwhy\\s+is\\b", "\\breason\\b", "\\bpurpose\\b", "\\bcause\\b")),
    ("how", ("\\bhow\\s+does\\b", "\\bhow\\s+do\\b", "\\bhow\\s+to\\b", "\\bhow\\s+can\\b", "\\bprocess\\b", "\\bmechanism\\b")),
    ("what", ("\\bwhat\\s+is\\b", "\\bwhat\\s+does\\b", "\\bwhat\\s+are\\b", "\\bdefine\\b", "\\bdescribe\\b")),
    ("trace", ("trace", "flow", "follow", "call")),
    ("resolve", ("fix", "debug", "resolve", "error", "bug")),
)
BROAD_SCOPE = "system across lifecycle expected outcomes end stress".split()
BROAD_BEHAVIOUR = "handle handles happens combine combines interact interacts fallback fallbacks flow summary summarize".split()

# What counts as evidence, contradiction and hedging in an answer.
EVIDENCE = ("(?i)\\bline\\s*\\d+", "`\\w+`", "\\b\\w+\\.\\w{1,4}\\b", "```")
CONTRADICTIONS = (("(?is)\\b(?:however|but)\\s+(?:.*?)\\b(?:actually|in fact|contrary|wrong|incorrect|not true)\\b", 1.0), ("(?i)\\b(?:does not|doesn't|cannot|can't)\\b.*?\\b(?:does|can|will)\\b", 1.0), ("(?i)\\b(?:might|perhaps|possibly|arguably|unclear|uncertain|not sure|speculation)\\b", 0.5))
ANSWER_NAMES = ("`(\\w+)`", "\\b([a-z_][a-z0-9_]*(?:_[a-z0-9]+)+)\\b", "\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b")


def _among(words) -> Column:
    return F.array(*map(F.lit, words))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, or of one of its groups, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def first_of_each(names: Column) -> Column:
    """names without those that came before in another letter case."""
    lowered = F.transform(names, F.lower)
    return F.filter(names, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def words(text: Column) -> Column:
    return found(F.lower(text), "\\b[a-z0-9_]+\\b")


def contains_any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def identifier_hints(text: Column) -> Column:
    """Identifiers in a text, in order, each once whatever its case; words that ask are none."""
    none = _among(NOT_IDENTIFIERS)
    return first_of_each(F.filter(found(text, IDENTIFIER_HINT), lambda x: ~F.array_contains(none, F.lower(x))))


def query_identifiers(text: Column) -> Column:
    """Sorted lower-case identifiers of four characters or more."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(found(text, QUERY_IDENTIFIER), F.lower), lambda x: F.length(x) >= 4)))


def holds_identifier(names: Column, *places: Column) -> Column:
    """Whether any of the names is found in the places, letters and digits only."""
    hay = F.regexp_replace(F.lower(F.concat_ws(" ", *places)), "[^a-z0-9]+", "")
    return F.exists(names, lambda x: (F.regexp_replace(x, "[^a-z0-9]+", "") != "") & hay.contains(F.regexp_replace(x, "[^a-z0-9]+", "")))


def concepts(text: Column) -> Column:
    """Distinct lower-case words of two characters or more that are no stopwords, in order."""
    stop = _among(CONCEPT_STOPWORDS)
    return F.array_distinct(F.filter(words(text), lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x)))


def significant_tokens(text: Column) -> Column:
    """Sorted distinct words of three characters or more that start with no digit and are no stopwords."""
    stop = _among(SECTION_STOPWORDS)
    return F.array_sort(F.array_distinct(F.filter(found(F.lower(text), "[a-z_][a-z0-9_]*"), lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, x))))


def name_terms(text: Column) -> Column:
    """Sorted parts of the names in a text: each part between dots and underscores, and its camel-case and digit runs."""
    runs = F.filter(F.flatten(F.transform(found(text, "[A-Za-z0-9_.]+"), lambda r: F.split(r, "[._]"))), lambda x: x != "")
    subs = F.flatten(F.transform(runs, lambda x: F.regexp_extract_all(x, F.lit("[A-Z]+(?=[A-Z][a-z]|[0-9]|\\b)|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(F.concat(runs, subs), F.lower)))


def is_broad(text: Column) -> Column:
    """Whether a question is about the system: a word of scope and one of behaviour, or two of
    behaviour among eight or more."""
    terms = name_terms(text)
    scope, behaviour = F.size(F.array_intersect(terms, _among(BROAD_SCOPE))), F.size(F.array_intersect(terms, _among(BROAD_BEHAVIOUR)))
    return ((scope >= 1) & (behaviour >= 1)) | ((behaviour >= 2) & (F.size(terms) >= 8))


def query_shape(text: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(q == "", "default")
    for name, parts in SHAPES:
        out = out.when(contains_any(q, parts), name)
    return out.when(q.contains("system") & contains_any(q, SYSTEM_MARKERS), "system_scope").when(contains_any(q, INTERACTION_MARKERS), "interaction").otherwise("default")


def query_domains(text: Column) -> Column:
    q = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(contains_any(q, keys), name) for name, keys in DOMAINS]))


def claim_term(token: Column) -> Column:
    """A term without its plural or verbal ending, where it is long enough."""
    n, t = F.length(token), F.lower(token)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(n <= 4, t).when(t.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y"))).when(t.endswith("ing") & (n > 6), cut(3))
        .when(t.endswith("ed") & (n > 5), cut(2)).when(t.endswith("es") & (n > 5), cut(2)).when(t.endswith("s"), cut(1)).otherwise(t)
    )


def claim_terms(text: Column, intent: Column) -> Column:
    """Terms of a claim in order: its own, each followed by what it brings along, then its intent's."""
    stop = _among(CLAIM_STOPWORDS)
    own = F.array_distinct(F.filter(F.transform(words(text), claim_term), lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x)))
    bring = F.create_map(*[y for k, v in TERM_EXPANSIONS.items() for y in (F.lit(k), F.array(*map(F.lit, (k, *v))))])
    own = F.flatten(F.transform(own, lambda x: F.coalesce(F.element_at(bring, x), F.array(x))))
    of_intent = F.create_map(*[y for name, _, terms, _ in CLAIM_INTENTS for y in (F.lit(name), F.array(*map(F.lit, terms)))])
    return F.array_distinct(F.concat(own, F.transform(F.element_at(of_intent, intent), claim_term)))


def claim_intent(query: Column, segment: Column) -> Column:
    """The first intent whose marks stand in the segment, or (but for errors) in the whole query."""
    out = None
    for name, marks, _, _ in CLAIM_INTENTS[:-1]:
        pattern = "\\b(?:" + "|".join(m if " " in m or "-" in m else m + "s?" for m in marks) + ")\\b"
        hit = F.lower(segment).rlike(pattern)
        if name != "ERROR_FALLBACK":
            hit = hit | F.lower(query).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(CLAIM_INTENTS[-1][0])


def _stems(text: Column, begin: str, char: str, end: str) -> Column:
    """A lower-case text with its words cut to their stems, a pattern for each rule: of the suffixes that
    leave four characters those that fit end in each other, so the longest is the first of SUFFIXES."""
    t = text
    for old in ("deserialise", "serialise", "deserialisation", "serialisation"):
        t = F.replace(t, F.lit(old), F.lit(old.replace("lis", "liz")))
    t = F.regexp_replace(t, f"{begin}((?:de)?serializ){char}*{end}", "$1")
    # Most texts hold none of these, and what is cut there makes none of the next.
    t = F.when(text.contains("seriali"), t).otherwise(text)
    t = F.when(text.contains("ies"), F.regexp_replace(t, f"{begin}({char}{{2,}})ies{end}", "$1y")).otherwise(t)
    first = "".join(sorted({s[0] for s in SUFFIXES}))
    return F.regexp_replace(t, f"{begin}({char}{{4,}}?)(?=[{first}])(?:{'|'.join(SUFFIXES)}){end}", "$1")


def lexeme(token: Column) -> Column:
    """A token's stem for comparing claims and blocks."""
    return _stems(F.lower(token), "(?s)\\A", ".", "\\z")


def lexemes(*places: Column) -> Column:
    """The distinct stems of a text's words, which are cut in the text: no word is handled by itself."""
    return F.array_distinct(found(_stems(F.lower(F.concat_ws(" ", *places)), "\\b", "[a-z0-9_]", "\\b"), "\\b[a-z0-9_]+\\b"))


def scoring_terms(terms: Column) -> Column:
    generic = _among(GENERIC_TERMS)
    return F.array_distinct(F.filter(F.transform(terms, lexeme), lambda x: (x != "") & ~F.array_contains(generic, x)))


def truncate(text: Column, max_tokens: int) -> Column:
    """The text, or its first 4 * max_tokens characters up to a blank line, a definition or a
    line's end, if one of these (tried in this order) stands beyond 60 % of them."""
    most = 4 * max_tokens
    head = F.substring(text, 1, most)
    tail = F.lit("\n# ... truncated")
    out = F.when(F.length(text) <= most, text)
    for mark in ("\n\n", "\ndef ", "\nclass ", "\n"):
        last = F.length(head) - F.length(F.substring_index(head, mark, -1)) - len(mark)
        out = out.when(head.contains(mark) & (last > most * 0.6), F.concat(F.substring(head, F.lit(1), last), tail))
    return out.otherwise(F.concat(head, tail))


def answer_entities(text: Column) -> Column:
    """Sorted lower-case names in an answer: in backticks, with underscores, in camel case."""
    names = F.concat(*[F.transform(found(text, p, 1), F.lower) for p in ANSWER_NAMES])
    return F.array_sort(F.array_distinct(names))


def context_entities(symbol: Column, content: Column) -> Column:
    """Lower-case names of a block: the parts of its symbol, what it defines, its decorators."""
    parts = F.transform(F.split(F.replace(F.coalesce(symbol, F.lit("")), F.lit("::"), F.lit(".")), "[.]"), lambda x: F.regexp_replace(x, "[^a-zA-Z0-9_]", ""))
    parts = F.filter(parts, lambda x: (F.length(x) >= 3) & ~x.startswith("__"))
    defined = F.filter(found(content, "(?:def|class|function)\\s+(\\w+)", 1), lambda x: F.length(x) >= 3)
    return F.array_distinct(F.transform(F.concat(parts, defined, decorators(content)), F.lower))


def decorators(content: Column) -> Column:
    return F.array_distinct(F.transform(found(content, "@(\\w+)", 1), F.lower))


def evidence_density(text: Column) -> Column:
    """References to lines, functions, files and code, of twenty."""
    return F.least(F.lit(1.0), sum((F.size(found(text, p)) for p in EVIDENCE), F.lit(0)) / 20.0)


def contradiction(text: Column) -> Column:
    """Turns, reversals and (by half) hedges, of five."""
    return F.least(F.lit(1.0), sum((F.size(found(text, p)) * w for p, w in CONTRADICTIONS), F.lit(0.0)) / 5.0)


def answer_depth(text: Column, context_tokens: Column) -> Column:
    """1 where the answer's words are 0.3 to 1.5 of the context's tokens (500 where that is not known), else 0.6."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda x: x != ""))
    ratio = n / F.when(context_tokens <= 0, 500).otherwise(context_tokens)
    return F.when((ratio >= 0.3) & (ratio <= 1.5), 1.0).otherwise(0.6)


def max_severity(a: Column, b: Column) -> Column:
    """The more severe of two depth labels; null is less than any."""
    rank = lambda x: F.when(x == "EXAMPLE_RECOMMENDED", 0).when(x == "DETAILED_REQUIRED", 1).when(x == "SHALLOW_OK", 2).otherwise(3)
    return F.when(rank(a) <= rank(b), a).otherwise(b)
