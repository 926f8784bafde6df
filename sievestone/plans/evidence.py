"""Queries of claims, sufficiency, profiles, block scores and answers, over code and questions
made from the relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import classify as cl
from ..functions import evidence as ev
from ..functions import text as tx
from ..operators import evidence as op
from ._base import table
from ._code import candidate_blocks, code_blocks, code_candidates, code_names, code_pairs, code_sizes, questions, with_code
from .textual import _rules_sql

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R6 = lambda c: F.round(c, 6).alias(c)
joined = lambda c: F.array_join(c, ",").alias(c)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in words) + "]"


def _any(text: str, parts) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _found(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


_WORDS = lambda t: _found(f"lower({t})", "\\b[a-z0-9_]+\\b")
_ONCE = lambda t: f"list_filter({t}, lambda x, i: list_position(list_transform({t}, lambda y: lower(y)), lower(x)) = i)"
_HINTS = lambda t: _ONCE(f"list_filter({_found(t, ev.IDENTIFIER_HINT)}, lambda x: not list_contains({_list(ev.NOT_IDENTIFIERS)}, lower(x)))")
_SHAPE = "case when lower(trim(q)) = '' then 'default' " + " ".join(f"when {_any('lower(q)', p)} then '{n}'" for n, p in ev.SHAPES) + f" when contains(lower(q), 'system') and {_any('lower(q)', ev.SYSTEM_MARKERS)} then 'system_scope' when {_any('lower(q)', ev.INTERACTION_MARKERS)} then 'interaction' else 'default' end"


@query("query_shape", with_code(f"select query_id, {_SHAPE} as shape from questions"))
def query_shape(spark, d):
    return questions(spark, d).select("query_id", ev.query_shape(F.col("q")).alias("shape"))


@query("query_domains", with_code("select query_id, array_to_string(list_sort(list(domain)), ',') as domains from (" + " union all ".join(f"select query_id, '{n}' as domain from questions where {_any('lower(q)', k)}" for n, k in ev.DOMAINS) + ") group by 1"))
def query_domains(spark, d):
    x = questions(spark, d).select("query_id", F.array_sort(ev.query_domains(F.col("q"))).alias("domains"))
    return x.filter(F.size("domains") > 0).select("query_id", joined("domains"))


@query("level3_intent", with_code("select query_id, " + "case " + " ".join(f"when regexp_matches(lower(q), '{'|'.join(f'(?:{x})' for x in p)}') then '{n}'" for n, p in ev.LEVEL3_INTENTS) + " else 'unknown' end as intent from questions"))
def level3_intent(spark, d):
    return questions(spark, d).select("query_id", cl.first_rule(F.col("q"), ev.LEVEL3_INTENTS, "unknown").alias("intent"))


@query("query_concepts", with_code(f"select query_id, array_to_string(c, ',') as concepts, len(c) as n from (select query_id, list_filter({_WORDS('q')}, lambda x: length(x) >= 2 and not list_contains({_list(ev.CONCEPT_STOPWORDS)}, x)) as w, list_filter(w, lambda x, i: list_position(w, x) = i) as c from questions)"))
def query_concepts(spark, d):
    return questions(spark, d).select("query_id", ev.concepts(F.col("q")).alias("concepts")).select("query_id", joined("concepts"), F.size("concepts").alias("n"))


@query("query_identifiers", with_code(f"""select query_id, array_to_string(ids, ',') as ids, cast(n as bigint) as n_blocks from (select query_id, list_sort(list_distinct(list_filter(list_transform({_found('q', ev.QUERY_IDENTIFIER)}, lambda x: lower(x)), lambda x: length(x) >= 4))) as ids from questions)
join (select c.query_id, count(case when len(list_filter(ids, lambda x: contains(hay, regexp_replace(x, '[^a-z0-9]+', '', 'g')))) > 0 then 1 end) as n from cand c join (select block_id, regexp_replace(lower(file || ' ' || symbol), '[^a-z0-9]+', '', 'g') as hay from code) using (block_id)
join (select query_id, list_filter(list_transform({_found('q', ev.QUERY_IDENTIFIER)}, lambda x: lower(x)), lambda x: length(x) >= 4) as ids from questions) i on i.query_id = c.query_id group by 1) using (query_id)"""))
def query_identifiers(spark, d):
    q = questions(spark, d).select("query_id", ev.query_identifiers(F.col("q")).alias("ids"))
    hit = candidate_blocks(spark, d).join(q, "query_id").groupBy("query_id").agg(F.count(F.when(ev.holds_identifier(F.col("ids"), F.col("file"), F.col("symbol")), 1)).alias("n_blocks"))
    return q.join(hit, "query_id").select("query_id", joined("ids"), "n_blocks")


@query("significant_tokens", with_code(f"select query_id, array_to_string(list_sort(list_distinct(list_filter({_found('lower(q)', '[a-z_][a-z0-9_]*')}, lambda x: length(x) >= 3 and not list_contains({_list(ev.SECTION_STOPWORDS)}, x)))), ',') as tokens from questions"))
def significant_tokens(spark, d):
    return questions(spark, d).select("query_id", ev.significant_tokens(F.col("q")).alias("tokens")).select("query_id", joined("tokens"))


_NAMES = lambda t: f"list_filter(flatten(list_transform({_found(t, '[A-Za-z0-9_.]+')}, lambda r: regexp_split_to_array(r, '[._]'))), lambda x: x <> '')"


@query("name_terms", with_code(f"select block_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(r, flatten(list_transform(r, lambda x: regexp_extract_all(regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')))), lambda x: lower(x)))), ',') as terms from (select block_id, {_NAMES('symbol')} as r from code where symbol <> '')"))
def name_terms(spark, d):
    return code_blocks(spark, d).filter("symbol <> ''").select("block_id", ev.name_terms(F.col("symbol")).alias("terms")).select("block_id", joined("terms"))


_TERMS = f"list_distinct(list_transform(list_concat({_NAMES('q')}, flatten(list_transform({_NAMES('q')}, lambda x: regexp_extract_all(regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')))), lambda x: lower(x)))"


@query("broad_queries", with_code(f"select query_id, (s >= 1 and b >= 1) or (b >= 2 and n >= 8) as broad from (select query_id, {_TERMS} as t, len(t) as n, len(list_intersect(t, {_list(ev.BROAD_SCOPE)})) as s, len(list_intersect(t, {_list(ev.BROAD_BEHAVIOUR)})) as b from questions)"))
def broad_queries(spark, d):
    return questions(spark, d).select("query_id", ev.is_broad(F.col("q")).alias("broad"))


def _claim_term_sql(x: str) -> str:
    return f"case when length({x}) <= 4 then {x} when {x} like '%ies' and length({x}) > 5 then {x}[:-4] || 'y' when {x} like '%ing' and length({x}) > 6 then {x}[:-4] when {x} like '%ed' and length({x}) > 5 then {x}[:-3] when {x} like '%es' and length({x}) > 5 then {x}[:-3] when {x} like '%s' then {x}[:-2] else {x} end"


def _lexeme_sql(x: str) -> str:
    y = f"(case when {x} like '%ies' and length({x}) > 4 then {x}[:-4] || 'y' else {x} end)"
    cuts = " ".join(f"when {y} like '%{s}' and length({y}) - {len(s)} >= 4 then {y}[:-{len(s) + 1}]" for s in ev.SUFFIXES)
    return f"case when {x} like 'deserializ%' then 'deserializ' when {x} like 'serializ%' then 'serializ' {cuts} else {y} end"


def _marks(name: str, marks) -> str:
    pattern = "\\b(?:" + "|".join(m if " " in m or "-" in m else m + "s?" for m in marks) + ")\\b"
    return f"when regexp_matches(lower(segment), '{pattern}')" + ("" if name == "ERROR_FALLBACK" else f" or regexp_matches(lower(q), '{pattern}')") + f" then '{name}'"


_INTENT = "case " + " ".join(_marks(n, m) for n, m, _, _ in ev.CLAIM_INTENTS[:-1]) + f" else '{ev.CLAIM_INTENTS[-1][0]}' end"
_BRING = "case x " + " ".join(f"when '{k}' then {_list((k, *v))}" for k, v in ev.TERM_EXPANSIONS.items()) + " else [x] end"
_OF_INTENT = "case intent " + " ".join(f"when '{n}' then {_list(t)}" for n, _, t, _ in ev.CLAIM_INTENTS) + " end"
_UNIQUE = lambda x: f"list_filter({x}, lambda y, j: list_position({x}, y) = j)"
_CLAIMS = f""", seg as (select query_id, trim(q) as q, list_filter(list_transform(regexp_split_to_array(trim(q), '{ev.CLAIM_SPLIT}'), lambda x: trim(x)), lambda x: x <> '')[1:8] as parts from questions),
sg as (select query_id, q, unnest(parts) as segment, unnest(range(1, len(parts) + 1)) as i from seg),
si as (select *, {_INTENT} as intent, list_filter(list_transform({_WORDS('segment')}, lambda x: {_claim_term_sql('x')}), lambda x: length(x) >= 2 and not list_contains({_list(ev.CLAIM_STOPWORDS)}, x)) as w from sg),
st as (select *, list_concat(flatten(list_transform(w, lambda x: {_BRING})), list_transform({_OF_INTENT}, lambda x: {_claim_term_sql('x')})) as tt from si),
claims as (select query_id, q, 'C' || i as claim_id, segment, intent, {_UNIQUE('tt')} as terms, {_HINTS('segment')} as hints from st)"""
_COVERAGE = _CLAIMS + f""", bl as (select block_id, lower(file || ' ' || symbol) as name, list_distinct(list_transform({_WORDS('content')}, lambda x: {_lexeme_sql('x')})) as c, list_distinct(list_transform({_WORDS("file || ' ' || symbol")}, lambda x: {_lexeme_sql('x')})) as n from code),
cs as (select *, list_filter(list_distinct(list_transform(terms, lambda x: {_lexeme_sql('x')})), lambda x: x <> '' and not list_contains({_list(ev.GENERIC_TERMS)}, x)) as s from claims),
x as (select cs.query_id, claim_id, rank, len(list_filter(s, lambda t: list_contains(c, t) or list_contains(n, t))) / greatest(len(s), 1) as lexical, len(list_filter(s, lambda t: list_contains(c, t) and list_contains(n, t))) / greatest(len(s), 1) as structure,
  case when len(hints) = 0 then 0 else len(list_filter(hints, lambda h: contains(name, lower(h)))) / len(hints) end as symbol from cs join cand on cand.query_id = cs.query_id join bl using (block_id)),
y as (select *, 0.5 * lexical + 0.3 * symbol + 0.2 * structure as score from x),
z as (select *, row_number() over (partition by query_id, claim_id order by round(score, 9) desc, rank) as r, count(case when score > 0 then 1 end) over (partition by query_id, claim_id) as anchors from y),
cov_ as (select claims.query_id, claim_id, intent, case when score > 0 then score else 0 end as score, case when score > 0 then lexical else 0 end as lexical, case when score > 0 then symbol else 0 end as symbol, case when score > 0 then structure else 0 end as structure, least(coalesce(anchors, 0), 5) as n_anchors from claims left join (select * from z where r = 1) using (query_id, claim_id)),
cov as (select *, n_anchors > 0 and (score >= 0.55 or lexical >= 0.75 or (symbol >= 0.5 and lexical >= 0.4) or (n_anchors >= 3 and lexical >= 0.33 and score >= 0.2)) as covered from cov_),
gate as (select query_id, count(*) as n_claims, count(case when covered then 1 end) as n_covered, n_covered / n_claims as ratio, array_to_string(list_sort(list(claim_id) filter (not covered)), ',') as unresolved from cov group by 1)"""


def _claims(spark, d):
    return op.claim_packets(questions(spark, d))


def _coverage(spark, d):
    # Candidates are ranked by price, then by number: of equal blocks the first needs no rank.
    return op.claim_coverage(_claims(spark, d), code_pairs(spark, d), op.block_lexemes(code_blocks(spark, d)), first=F.struct("bm", -F.col("block_id")))


@query("claim_packets", with_code(_CLAIMS) + " select query_id, claim_id, segment, intent, array_to_string(terms, ',') as terms, array_to_string(hints, ',') as hints from claims")
def claim_packets(spark, d):
    return _claims(spark, d).select("query_id", "claim_id", "segment", "intent", joined("terms"), joined("hints"))


@query("claim_anchor_scores", with_code(_COVERAGE) + " select query_id, claim_id, intent, covered, round(score, 6) as score, round(lexical, 6) as lexical, round(symbol, 6) as symbol, round(structure, 6) as structure, n_anchors from cov")
def claim_anchor_scores(spark, d):
    return _coverage(spark, d).select("query_id", "claim_id", "intent", "covered", R6("score"), R6("lexical"), R6("symbol"), R6("structure"), "n_anchors")


@query("claim_gate", with_code(_COVERAGE) + " select query_id, n_claims, n_covered, round(ratio, 6) as ratio, coalesce(unresolved, '') as unresolved, case when ratio >= 0.7 then 'PASS' else 'SOFT_RECOVERY' end as action from gate")
def claim_gate(spark, d):
    return op.claim_gate(_coverage(spark, d)).select("query_id", "n_claims", "n_covered", R6("ratio"), joined("unresolved"), "action")


_PRIORITY = "case intent " + " ".join(f"when '{n}' then {p}" for n, _, _, p in ev.CLAIM_INTENTS) + " end"


@query("recovery_queries", with_code(_COVERAGE) + f""", o as (select query_id, q, claim_id, segment, {_PRIORITY} as p, concat_ws(' | ', segment, case when len(hints) > 0 then array_to_string(hints[1:4], ' ') end, case when len(terms) > 0 then array_to_string(terms[1:8], ' ') end) as one from claims join (select query_id, claim_id from cov where not covered) using (query_id, claim_id)),
u as (select query_id, any_value(q) || ' | unresolved focus: ' || string_agg(segment, ' ; ' order by p, claim_id) as text, -1 as p, '' as claim_id from o group by 1 union all select query_id, one, p, claim_id from o),
v as (select query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, row_number() over (partition by query_id order by p, claim_id) as r from u),
f as (select query_id, text, r, row_number() over (partition by query_id, lower(text) order by r) as again from v)
select query_id, rank, text from (select query_id, text, row_number() over (partition by query_id order by r) as rank from f where again = 1) where rank <= 4""")
def recovery_queries(spark, d):
    x = op.recovery_queries(questions(spark, d), _claims(spark, d), _coverage(spark, d))
    return x.select("query_id", F.posexplode("queries").alias("rank", "text")).withColumn("rank", F.col("rank") + 1)


_STRUCTURAL = f"""stru as (select query_id, least(1.0, round(0.3 + case when count(*) >= 2 then 0.2 else 0 end + case when max(symbol) <> '' then 0.3 else 0 end + 0.1 + case when count(distinct file) >= 2 then 0.1 else 0 end + case when count(case when regexp_matches(file, '({'|'.join(e.replace('.', '[.]') for e in op.CODE_ENDINGS)})$') then 1 end) > 0 then 0.2 else 0 end, 6)) as score from cand join code using (block_id) group by 1)"""
_RULE = f"""rt as (select query_id, unnest(list_distinct(list_filter({_found('q', chr(92) + 'b[A-Za-z_][A-Za-z0-9_]*' + chr(92) + 'b')}, lambda x: length(x) > 1 and not list_contains({_list(ev.RULE_STOPWORDS)}, lower(x))))) as term from questions),
rh as (select rt.query_id, term, max(case when contains(lower(content), lower(term)) then 1 else 0 end) as hit from rt left join cand using (query_id) left join code using (block_id) group by 1, 2),
rul as (select query_id, coalesce(avg(hit), 0) as score from questions left join rh using (query_id) group by 1)"""


@query("structural_signal", with_code(f", {_STRUCTURAL} select query_id, score::double as score, case when score >= 0.5 then 'SUFFICIENT' else 'INSUFFICIENT' end as label from stru"))
def structural_signal(spark, d):
    return op.structural_signal(candidate_blocks(spark, d))


@query("rule_signal", with_code(f", {_RULE} select query_id, round(score, 6) as score, case when score >= 0.3 then 'SUFFICIENT' else 'INSUFFICIENT' end as label from rul"))
def rule_signal(spark, d):
    return op.rule_signal(questions(spark, d), candidate_blocks(spark, d)).select("query_id", R6("score"), "label")


_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


@query("semantic_signal", f"""with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e, sqrt({_DOT('e', 'e')}) as n from embeddings),
p as (select a.label, avg(1 - {_DOT('a.e', 'b.e')} / (a.n * b.n)) as spread from v a join v b on a.label = b.label and a.vec_id < b.vec_id group by 1),
m as (select label, dim, avg(x) as m from (select label, unnest(range(1, len(e) + 1)) as dim, unnest(e) as x from v) group by 1, 2), c as (select label, list(m order by dim) as c from m group by 1),
s as (select label, vec_id as query, greatest(0, least(1, 0.7 * ({_DOT('e', 'c')} / (n * sqrt({_DOT('c', 'c')})) + 1) / 2 + 0.3 * least(1, coalesce(spread, 0)))) as score from v join c using (label) left join p using (label) where vec_id % 50 = 0)
select label, query, round(score, 6) as score, case when score >= 0.8 then 'SUFFICIENT' else 'INSUFFICIENT' end as signal from s""")
def semantic_signal(spark, d):
    v = table(spark, d, "embeddings")
    return op.semantic_signal(v, v.filter("vec_id % 50 = 0")).select("label", "query", R6("score"), "signal")


def _verdicts(spark, d):
    s = op.structural_signal(candidate_blocks(spark, d)).select("query_id", F.when(F.col("score") > 0.8, F.col("label")).otherwise("INSUFFICIENT").alias("structural"))
    r = op.rule_signal(questions(spark, d), candidate_blocks(spark, d)).select("query_id", F.col("label").alias("rule"))
    q = questions(spark, d).select("query_id", cl.sufficiency_intent(F.col("q")).alias("intent"), F.when(F.col("query_id") % 3 == 0, "INSUFFICIENT").otherwise("SUFFICIENT").alias("semantic"))
    return op.veto(s.join(r, "query_id").join(q, "query_id"), cl.mandatory_axes(F.col("intent")))


_AXES = "case intent " + " ".join(f"when '{k}' then {_list(v)}" for k, v in cl.MANDATORY_AXES.items()) + " end"
_VERDICT = f""", {_STRUCTURAL}, {_RULE}, vs as (select query_id, case when stru.score > 0.8 then 'SUFFICIENT' else 'INSUFFICIENT' end as structural, case when rul.score >= 0.3 then 'SUFFICIENT' else 'INSUFFICIENT' end as rule, case when query_id % 3 = 0 then 'INSUFFICIENT' else 'SUFFICIENT' end as semantic, {_rules_sql(cl.SUFFICIENCY_RULES, 'UNKNOWN').replace('text', 'q')} as intent from stru join rul using (query_id) join questions using (query_id)),
vb as (select *, list_contains({_AXES}, 'STRUCTURAL') and structural = 'INSUFFICIENT' as s, list_contains({_AXES}, 'RULE') and rule = 'INSUFFICIENT' as r, list_contains({_AXES}, 'SEMANTIC') and semantic = 'INSUFFICIENT' as m from vs),
vd as (select *, case when s or r then 'INSUFFICIENT' when m then 'PROBABLY_SUFFICIENT' else 'SUFFICIENT' end as verdict, case when s then 'STRUCTURAL' when r then 'RULE' when m then 'SEMANTIC' end as deciding from vb)"""


@query("sufficiency_verdict", with_code(_VERDICT) + " select query_id, intent, structural, rule, semantic, verdict, deciding from vd")
def sufficiency_verdict(spark, d):
    return _verdicts(spark, d).select("query_id", "intent", "structural", "rule", "semantic", "verdict", "deciding")


@query("remediation_actions", with_code(_VERDICT) + """ select query_id, case verdict when 'SUFFICIENT' then 'ALIGNED' when 'PROBABLY_SUFFICIENT' then 'PARTIALLY_ALIGNED' else 'MISALIGNED' end as final,
case when verdict = 'SUFFICIENT' then '' else concat_ws(',', case when structural = 'INSUFFICIENT' then 'RETRIEVAL_EXPANSION' end, case when rule = 'INSUFFICIENT' then 'RETRIEVAL_RE_TARGET' end, case when semantic = 'INSUFFICIENT' then 'TOKEN_BUDGET_INCREASE' end, case when query_id % 7 = 0 then 'RETRY_ESCALATION' end) end as actions from vd""")
def remediation_actions(spark, d):
    return op.remediation(_verdicts(spark, d), F.col("query_id") % 7 == 0).select("query_id", "final", joined("actions"))


_ENTROPY = lambda name, source, value: f"{name} as (select query_id, case when count(*) <= 1 then 0 else sum(-p * ln(p)) / ln(count(*)) end as {name} from (select query_id, {value} / sum({value}) over (partition by query_id) as p from {source} where {value} > 0) group by 1)"
_PROFILE = f""", ck as (select cand.*, file, symbol, content, start_line, end_line, case when length(content) < 120 then 'fine' when length(content) < 240 then 'medium' else 'coarse' end as level from cand join code using (block_id)),
{_ENTROPY('score_entropy', 'ck', 'base')}, fe as (select query_id, file, count(*) as n from ck group by 1, 2), {_ENTROPY('file_entropy', 'fe', 'n')}, le as (select query_id, level, count(*) as n from ck group by 1, 2), {_ENTROPY('level_entropy', 'le', 'n')},
rk as (select *, row_number() over (partition by query_id order by base desc, block_id) as r, row_number() over (partition by query_id order by vec desc, block_id) as rv from ck),
pr as (select query_id, case when count(*) < 2 then 1.0 else (max(case when r = 1 then base end) - max(case when r = 2 then base end)) / max(case when r = 1 then base end) end as margin, var_pop(base) as score_variance, case when count(*) < 2 then 0 else 1 - 6.0 * sum((rank - rv) * (rank - rv)) / (count(*) * (count(*) * count(*) - 1)) end as correlation, count(distinct file) as unique_files from rk group by 1)"""


def _leveled(spark, d):
    n = F.col("n_chars")
    return candidate_blocks(spark, d, "file", F.when(n < 120, "fine").when(n < 240, "medium").otherwise("coarse").alias("level"), blocks=code_sizes(spark, d))


@query("signal_profile", with_code(_PROFILE) + " select query_id, round(margin, 6) as margin, round(score_entropy, 6) as score_entropy, round(score_variance, 6) as score_variance, round(correlation, 6) as correlation, round(file_entropy, 6) as file_entropy, round(level_entropy, 6) as level_entropy, unique_files, margin > 0.3 as confident, file_entropy > 0.6 as dispersed from pr join score_entropy using (query_id) join file_entropy using (query_id) join level_entropy using (query_id)")
def signal_profile(spark, d):
    x = op.signal_profile(_leveled(spark, d), score="base", at="rank")
    return x.select("query_id", R6("margin"), R6("score_entropy"), R6("score_variance"), R6("correlation"), R6("file_entropy"), R6("level_entropy"), "unique_files", "confident", "dispersed")


@query("adaptive_weights", with_code(_PROFILE) + " select query_id, 0.4::double as w_base, (case when query_id % 4 = 0 then 0.4 when query_id % 4 = 3 then 0.2 else case query_id % 4 when 1 then 0.4 else 0.3 end end)::double as w_struct, (case when query_id % 5 = 0 then 0 when margin > 0.2 then 0.4 else 0.5 end)::double as w_rerank, (case when file_entropy > 0.7 then 0.3 when file_entropy >= 0.4 then 0.1 else 0 end)::double as w_diversity from pr join file_entropy using (query_id)")
def adaptive_weights(spark, d):
    x = op.adaptive_weights(op.signal_profile(_leveled(spark, d), score="base", at="rank"), 0.4, 0.2, 0.4, (F.col("query_id") % 4).cast("double"), F.col("query_id") % 5 != 0)
    return x.select("query_id", "w_base", R6("w_struct"), "w_rerank", "w_diversity")


_CONCEPTS = f"qc as (select query_id, list_distinct(list_filter({_WORDS('q')}, lambda x: length(x) >= 2 and not list_contains({_list(ev.CONCEPT_STOPWORDS)}, x))) as c from questions)"
_CURVE = f""", {_CONCEPTS}, cc as (select cand.query_id, rank, len(c) as n, unnest(c) as t, lower(file || ' ' || symbol || ' ' || content[1:300]) as hay from cand join code using (block_id) join qc using (query_id) where rank <= 20 and len(c) > 0),
cf as (select query_id, t, min(case when contains(hay, t) then rank end) as first from cc group by 1, 2), cr as (select distinct query_id, rank, n from cc),
curve as (select cr.query_id, cr.rank, count(first) / any_value(n) as coverage from cr left join cf on cf.query_id = cr.query_id and first <= cr.rank group by 1, 2)"""


@query("coverage_curve", with_code(_CURVE) + " select query_id, rank, round(coverage, 6) as coverage from curve")
def coverage_curve(spark, d):
    return op.coverage_curve(candidate_blocks(spark, d), questions(spark, d)).select("query_id", "rank", R6("coverage"))


_SLOPE = "slp as (select query_id, least(1, greatest(0, case when count(*) = 1 then max(coverage) else (arg_max(coverage, case when rank <= 6 then rank end) - max(case when rank = 1 then coverage end)) / least(count(*) - 1, 5) end)) as slope from curve group by 1)"


@query("early_slope", with_code(_CURVE) + f", {_SLOPE} select query_id, round(slope, 6) as slope from slp")
def early_slope(spark, d):
    return op.early_slope(op.coverage_curve(candidate_blocks(spark, d), questions(spark, d))).select("query_id", R6("slope"))


_INTEGRATION = _CURVE + f""", {_SLOPE}, hd as (select cand.*, file, start_line, end_line from cand join code using (block_id) where rank <= 20),
prs as (select a.query_id, sum(case when a.file = b.file and greatest(a.start_line, b.start_line) <= least(a.end_line, b.end_line) then (least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1) / least(a.end_line - a.start_line + 1, b.end_line - b.start_line + 1) else 0 end) / count(*) as overlap from hd a join hd b on a.query_id = b.query_id and a.rank < b.rank group by 1),
dsp as (select query_id, count(distinct file) / count(*) as dispersion from hd group by 1), {_ENTROPY('entropy', 'hd', 'base')},
itg as (select query_id, dispersion, coalesce(slope, 0) as slope, coalesce(overlap, 0) as overlap, entropy, 0.35 * (1 - dispersion) + 0.25 * (1 - coalesce(slope, 0)) + 0.2 * coalesce(overlap, 0) + 0.2 * entropy as pressure from dsp left join slp using (query_id) left join prs using (query_id) join entropy using (query_id))"""


@query("integration_profile", with_code(_INTEGRATION) + " select query_id, round(dispersion, 6) as dispersion, round(slope, 6) as slope, round(overlap, 6) as overlap, round(entropy, 6) as entropy, round(least(1, greatest(0, pressure)), 6) as pressure from itg")
def integration_profile(spark, d):
    texts = code_candidates(spark, d).filter("rank <= 6").select("query_id", "block_id", "rank").join(code_blocks(spark, d).select("block_id", "file", "symbol", F.substring("content", 1, 300).alias("content")), "block_id")
    x = op.integration_profile(candidate_blocks(spark, d, "file", "start_line", "end_line"), questions(spark, d), "base", texts=texts)
    return x.select("query_id", R6("dispersion"), R6("slope"), R6("overlap"), R6("entropy"), R6("pressure"))


@query("synthesis_profile", with_code(f""", {_CONCEPTS}, hd as (select cand.*, file from cand join code using (block_id) where rank <= 50), {_ENTROPY('entropy', 'hd', 'base')},
dsp as (select query_id, count(distinct file) / count(*) as dispersion from hd group by 1), rv as (select *, row_number() over (partition by query_id order by vec desc, block_id) as rv from cand),
dis as (select query_id, case when count(*) < 2 then 0 else greatest(0, least(1, 6.0 * sum((rank - rv) * (rank - rv)) / (count(*) * (count(*) * count(*) - 1)))) end as disagreement from rv group by 1)
select query_id, round(least(len(c) / 8.0, 1), 6) as density, round(dispersion, 6) as dispersion, round(entropy, 6) as entropy, round(disagreement, 6) as disagreement, round(0.3 * least(len(c) / 8.0, 1) + 0.25 * dispersion + 0.25 * entropy + 0.2 * disagreement, 6) as synthesis from dsp join qc using (query_id) join entropy using (query_id) join dis using (query_id)"""))
def synthesis_profile(spark, d):
    w = W.partitionBy("query_id").orderBy(F.desc("vec"), "block_id")
    n = F.count("*")
    c = candidate_blocks(spark, d, "file", blocks=code_names(spark, d)).withColumn("rv", F.row_number().over(w))
    far = F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), 6.0 * F.sum((F.col("rank") - F.col("rv")) * (F.col("rank") - F.col("rv"))) / (n * (n * n - 1))))
    x = op.synthesis_profile(c, questions(spark, d), "base", far)
    return x.select("query_id", R6("density"), R6("dispersion"), R6("entropy"), R6("disagreement"), R6("synthesis"))


_SCORED = """, sb as (select cand.query_id, block_id, rank, file, symbol, base + rerank as raw, case when contains(file, '.py') then 0.1 else 0 end as struct, list_distinct(regexp_split_to_array(lower(q), '\\s+')) as asked from cand join code using (block_id) join questions using (query_id)),
ss as (select *, case when max(raw) over w > min(raw) over w then (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) else 0.5 end as semantic, case when symbol = '' then 0 else len(list_intersect(asked, list_distinct(string_split(lower(symbol), '_')))) / greatest(len(asked), len(list_distinct(string_split(lower(symbol), '_')))) end as name from sb window w as (partition by query_id)),
sf as (select *, 0.4 * semantic + 0.2 * name + 0.2 * struct as final from ss)"""


def _scored(spark, d):
    return op.score_blocks(candidate_blocks(spark, d), questions(spark, d), F.col("base") + F.col("rerank"), F.when(F.col("file").contains(".py"), 0.1).otherwise(0.0))


@query("block_scores", with_code(_SCORED) + """, t as (select *, row_number() over (partition by query_id, file order by round(final, 9) desc, rank) - 1 as turn from sf)
select query_id, block_id, round(semantic, 6) as semantic, round(name, 6) as name, round(final, 6) as final, row_number() over (partition by query_id order by round(final / (1 + 0.2 * turn), 9) desc, rank) as position from t""")
def block_scores(spark, d):
    return _scored(spark, d).select("query_id", "block_id", R6("semantic"), R6("name"), R6("final"), "position")


@query("rerank_geometry", with_code(""", g as (select *, base + 0.37 * rerank as final, case when rerank <> 0 then rerank end as r from cand)
select query_id, round(var_pop(base), 6) as base_variance, round(coalesce(avg(r), 0), 6) as rerank_mean, round(coalesce(stddev_pop(r), 0), 6) as rerank_std, round(coalesce(min(r) - avg(r), 0), 6) as delta_min, round(coalesce(max(r) - avg(r), 0), 6) as delta_max, round(var_pop(final), 6) as final_variance, round(avg(0.37 * rerank), 10) as mean_abs_part,
round(case when var_pop(final) < 1e-15 then 0 else least(1, var_pop(0.37 * rerank) / var_pop(final)) end, 6) as influence from g group by 1"""))
def rerank_geometry(spark, d):
    x = op.geometry(code_candidates(spark, d).withColumn("final", F.col("base") + 0.37 * F.col("rerank")), 0.37)
    return x.select("query_id", *[R6(c) for c in ("base_variance", "rerank_mean", "rerank_std", "delta_min", "delta_max", "final_variance", "influence")], F.round("mean_abs_part", 10).alias("mean_abs_part"))


@query("overlap_guard", with_code(""", a as (select query_id, block_id from cand where rank <= 20), b as (select query_id, block_id from (select *, row_number() over (partition by query_id order by vec desc, block_id) as r from cand) where r <= 20),
n as (select query_id, count(*) as n from a group by 1), o as (select query_id, round(count(b.block_id) / least(any_value(n), 20), 3) as overlap from a join n using (query_id) left join b using (query_id, block_id) group by 1)
select query_id, overlap, overlap >= 0.8 and query_id % 2 <> 0 as repeated from o"""))
def overlap_guard(spark, d):
    c = code_candidates(spark, d)
    other = c.drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("vec"), "block_id")))
    return op.overlap_guard(c, other, F.col("query_id") % 2 == 0)


_STEPS = lambda n: f"case when {n} >= 5 then 1.0 when {n} >= 3 then 0.7 when {n} >= 1 then 0.4 else 0.1 end"
_NAMES_OF = " , ".join(f"list_transform({_found('answer', p, 1)}, lambda x: lower(x))" for p in ev.ANSWER_NAMES)


@query("answer_validation", with_code(f""", ent as (select query_id, list_distinct(list(e)) as names from (select query_id, unnest(list_transform(list_concat(list_filter([regexp_replace(symbol, '[^a-zA-Z0-9_]', '', 'g')], lambda x: length(x) >= 3), list_filter({_found('content', '(?:def|class|function)[ ]+(' + chr(92) + 'w+)', 1)}, lambda x: length(x) >= 3), {_found('content', '@(' + chr(92) + 'w+)', 1)}), lambda x: lower(x))) as e from cand join code using (block_id)) group by 1),
tag as (select query_id, list_distinct(list(e)) as tags from (select query_id, unnest(list_transform({_found('content', '@(' + chr(92) + 'w+)', 1)}, lambda x: lower(x))) as e from cand join code using (block_id)) group by 1),
av as (select query_id, {_rules_sql(cl.QUERY_TYPE_RULES, 'explanation').replace('text', 'q')} as kind, answer, names, tags, list_distinct(list_concat({_NAMES_OF})) as said, len(regexp_extract_all(lower(answer), '({an.STEP})', 1)) as n_steps, len(regexp_extract_all(lower(answer), '({an.CONTRAST})', 1)) as n_contrasts,
  len({_found('answer', ev.EVIDENCE[0])}) + len({_found('answer', ev.EVIDENCE[1])}) + len({_found('answer', ev.EVIDENCE[2])}) + len({_found('answer', ev.EVIDENCE[3])}) as refs, len({_found('answer', ev.CONTRADICTIONS[0][0])}) + len({_found('answer', ev.CONTRADICTIONS[1][0])}) + 0.5 * len({_found('answer', ev.CONTRADICTIONS[2][0])}) as against,
  len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) / 40.0 as ratio from questions left join ent using (query_id) left join tag using (query_id)),
s as (select query_id, kind, case when coalesce(len(names), 0) = 0 then 1 else len(list_intersect(names, said)) / len(names) end as entity_coverage, case when kind <> 'trace' then 1.0 else {_STEPS('n_steps')} end as steps, case when kind <> 'comparison' then 1.0 when n_contrasts >= 6 then 1.0 when n_contrasts >= 3 then 0.7 when n_contrasts >= 1 then 0.4 else 0.1 end as contrasts,
  case when coalesce(len(tags), 0) = 0 then 1 else len(list_filter(tags, lambda t: contains(lower(answer), t))) / len(tags) end as decorators, least(1, refs / 20.0) as evidence, least(1, against / 5.0) as contradiction, case when ratio between 0.3 and 1.5 then 1.0 else 0.6 end as depth from av)
select query_id, kind, round(entity_coverage, 6) as entity_coverage, steps::double as steps, contrasts::double as contrasts, round(decorators, 6) as decorators, round(evidence, 6) as evidence, round(contradiction, 6) as contradiction, depth::double as depth,
round(greatest(0, least(1, (entity_coverage + steps + contrasts + decorators + evidence + depth) / 6 - 0.3 * contradiction)), 6) as structure from s"""))
def answer_validation(spark, d):
    q, a = F.col("q"), F.col("answer")
    kind = cl.query_type(q)
    x = op.validate_answers(questions(spark, d), candidate_blocks(spark, d), F.lit(40), kind, an.step_score(a, kind), an.contrast_score(a, kind))
    return x.select("query_id", "kind", R6("entity_coverage"), "steps", "contrasts", R6("decorators"), R6("evidence"), R6("contradiction"), "depth", R6("structure"))


@query("truncated_content", with_code("""select block_id, case when length(content) <= 120 then content
when contains(h, chr(10) || chr(10)) and length(h) - position(reverse(chr(10) || chr(10)) in reverse(h)) - 1 > 72 then h[:length(h) - position(reverse(chr(10) || chr(10)) in reverse(h)) - 1] || chr(10) || '# ... truncated'
when contains(h, chr(10) || 'def ') and length(h) - position(reverse(chr(10) || 'def ') in reverse(h)) - 4 > 72 then h[:length(h) - position(reverse(chr(10) || 'def ') in reverse(h)) - 4] || chr(10) || '# ... truncated'
when contains(h, chr(10)) and length(h) - position(chr(10) in reverse(h)) > 72 then h[:length(h) - position(chr(10) in reverse(h))] || chr(10) || '# ... truncated' else h || chr(10) || '# ... truncated' end as content from (select block_id, content, content[:120] as h from code)"""))
def truncated_content(spark, d):
    return code_blocks(spark, d).select("block_id", ev.truncate(F.col("content"), 30).alias("content"))


@query("utilization_class", with_code(""", b as (select query_id, count(*) as n, cast(sum(greatest(1, length(content) // 4)) as bigint) as offered, cast(sum(least(greatest(1, length(content) // 4), 40)) as bigint) as used from cand join code using (block_id) group by 1),
u as (select query_id, n, offered, least(used, 1000) as used, offered - used as capped, greatest(0, used - 1000) as over from b)
select query_id, offered, used, case when n <= 3 and offered < 500 then 'Candidate Scarcity' when capped > over and capped > offered * 0.1 then 'Cap-Limited' when over > 0 then 'Budget-Limited' when used / 1000 * 100 >= 60 then 'Healthy' else 'Candidate Scarcity' end as class from u"""))
def utilization_class(spark, d):
    t = tx.tokens_quarter_min1(F.col("content"))
    b = candidate_blocks(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(t).alias("offered"), F.sum(F.least(t, F.lit(40))).alias("fit"))
    x = b.select("query_id", "n", "offered", F.least("fit", F.lit(1000)).alias("used"), (F.col("offered") - F.col("fit")).alias("capped"), F.greatest(F.lit(0), F.col("fit") - 1000).alias("over"))
    return x.select("query_id", "offered", "used", op.utilization_class(F.col("n"), F.col("offered"), F.col("capped"), F.col("over"), F.col("used"), 1000).alias("class"))


@query("depth_history", """with c as (select conv_id, count(*) as runs, avg(case when length(text) > 400 then 1.0 else 0.0 end) as expanded, avg(case when turn % 5 = 4 then 1.0 else 0.0 end) as complaints from conversations group by 1)
select conv_id, runs, case when runs >= 2 and (expanded >= 0.3 or complaints >= 0.3) then 'DETAILED_REQUIRED' else 'SHALLOW_OK' end as label from c""")
def depth_history(spark, d):
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("runs"), one(F.length("text") > 400).alias("expanded"), one(F.col("turn") % 5 == 4).alias("complaints"))
    return c.select("conv_id", "runs", op.escalate_depth(F.lit("SHALLOW_OK"), F.col("runs"), F.col("expanded"), F.col("complaints")).alias("label"))


@query("depth_refinement", f"""with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e, sqrt({_DOT('e', 'e')}) as n from embeddings),
m as (select label, dim, avg(x) as m from (select label, unnest(range(1, len(e) + 1)) as dim, unnest(e) as x from v where label < 3) group by 1, 2), c as (select label, list(m order by dim) as c from m group by 1),
s as (select vec_id, max(case when c.label = 0 then {_DOT('e', 'c')} / (n * sqrt({_DOT('c', 'c')})) end) as ill, max(case when c.label = 1 then {_DOT('e', 'c')} / (n * sqrt({_DOT('c', 'c')})) end) as exp, max(case when c.label = 2 then {_DOT('e', 'c')} / (n * sqrt({_DOT('c', 'c')})) end) as fact from v, c group by 1)
select vec_id, case when ill >= 0.1 and ill >= exp and ill >= fact then 'EXAMPLE_RECOMMENDED' when exp >= 0.1 and exp >= fact then 'DETAILED_REQUIRED' else 'SHALLOW_OK' end as label from s""")
def depth_refinement(spark, d):
    v = table(spark, d, "embeddings")
    dims = v.filter("label < 3").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    three = c.agg(*[F.first(F.when(F.col("label") == k, F.col("c")), ignorenulls=True).alias(n) for k, n in enumerate(("ill", "exp", "fact"))])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = F.transform("embedding", lambda x: x.cast("double"))
    cosine = lambda n: dot(e, F.col(n)) / (F.sqrt(dot(e, e)) * F.sqrt(dot(F.col(n), F.col(n))))
    # One row of three vectors: the size of this broadcast is fixed.
    x = v.join(F.broadcast(three)).select("vec_id", *[cosine(n).alias(n) for n in ("ill", "exp", "fact")])
    return x.select("vec_id", op.refine_depth(F.lit("SHALLOW_OK"), F.col("ill"), F.col("exp"), F.col("fact"), 0.1).alias("label"))
