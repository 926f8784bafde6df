"""Queries of recovery, ranking, balance, evidence and rendering, over code made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import text as tx
from ..operators import context as cx
from ..operators import diagnostics as dg
from ..operators import evidence as op
from ._base import table
from ._code import candidate_blocks, code_blocks, code_candidates, questions, with_code
from .diagnostics import _MEASURED, _measured
from .evidence import _CONCEPTS, _COVERAGE, _coverage, _found, _list

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R6 = lambda c: F.round(c, 6).alias(c)
_TOP = "top10 as (select cand.*, file, symbol, content from cand join code using (block_id) where rank <= 10)"
_B = chr(92) + "b"


def _top(spark, d, k=10):
    return candidate_blocks(spark, d).filter(F.col("rank") <= k)


@query("precision_recovery", with_code(f""", {_TOP}, wa as (select query_id, lower(unnest({_found('q', '[A-Za-z_]' + chr(92) + 'w*')})) as identifier from questions union select query_id, lower(unnest({_found('content', cx.CALL, 1)})) from top10 where rank <= 5),
ow as (select query_id, lower(unnest({_found('content', cx.DEFINITION, 1)})) as identifier from top10 union select query_id, lower(symbol) from top10),
wi as (select * from (select *, row_number() over (partition by query_id order by identifier) as i from (select distinct * from wa where length(identifier) >= 3 and not list_contains({_list(cx.NEVER)}, identifier) and not exists (select 1 from ow where ow.query_id = wa.query_id and ow.identifier = wa.identifier))) where i <= 12),
de as (select distinct block_id, lower(unnest({_found('content', cx.DEFINITION, 1)})) as identifier, lower(content) as c from code),
dt as (select block_id, identifier, len(regexp_split_to_array(c, '[^a-z0-9_]+')) - len(list_filter(regexp_split_to_array(c, '[^a-z0-9_]+'), lambda x: x <> identifier)) as n, length(c) as size from de),
dr as (select *, n / size as tf, max(n / size) over (partition by identifier) as most from dt),
me as (select wi.query_id, i, identifier, block_id, greatest(0.85, tf / most) as confidence, row_number() over (partition by wi.query_id, identifier order by round(tf, 9) desc, block_id) as r from wi join dr using (identifier) where not exists (select 1 from top10 t where t.query_id = wi.query_id and t.block_id = dr.block_id)),
nn as (select query_id, least(3, floor(count(*) * 0.5)) as cap from top10 group by 1),
pk as (select *, row_number() over (partition by query_id order by i) as k from me where r = 1)
select query_id, block_id, identifier, round(confidence, 6) as confidence from pk join nn using (query_id) where k <= cap"""))
def precision_recovery(spark, d):
    return cx.precision_recovery(questions(spark, d), _top(spark, d), code_blocks(spark, d), own_most=10).select("query_id", "block_id", "identifier", R6("confidence"))


_CALLS = "calls as (select o_orderkey as caller, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as callee from orders union all select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) from orders)"


def _calls(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("next"), F.lag("o_orderkey").over(w).alias("last"))
    o = o.select("o_orderkey", F.explode(F.array("next", "last")).alias("callee"))
    return o.filter("callee is not null").select(F.col("o_orderkey").alias("caller"), "callee")


@query("structural_expand", with_code(f""", {_CALLS}, fw as (select caller, callee from (select *, row_number() over (partition by caller order by callee) as r from calls where callee is not null) where r <= 2),
t as (select * from cand where rank <= 10), m as (select t.query_id, callee, rank, caller from t join fw on caller = block_id where not exists (select 1 from t x where x.query_id = t.query_id and x.block_id = callee)),
f as (select query_id, callee as block_id, arg_min(caller, rank) as via, min(rank) as rank from m group by 1, 2)
select query_id, block_id, via, position from (select *, row_number() over (partition by query_id order by rank, block_id) as position from f) where position <= 8"""))
def structural_expand(spark, d):
    return cx.expand(code_candidates(spark, d).filter(F.col("rank") <= 10), _calls(spark, d))


_RANKED = """, rb as (select cand.*, file, symbol, row_number() over (partition by query_id order by round(base, 9) desc, block_id) as b from cand join code using (block_id)),
rf as (select *, b <= 10 or rank <= 3 as reranked, base + case when b <= 10 or rank <= 3 then 0.5 * rerank else 0 end as final from rb),
rs as (select *, row_number() over (partition by query_id, file, case when symbol = '' then cast(block_id as varchar) else symbol end order by round(final, 9) desc, block_id) as s from rf),
ranked as (select * from (select *, row_number() over (partition by query_id order by round(final, 9) desc, block_id) as position from rs where s = 1) where position <= 12)"""


def _ranked(spark, d):
    return cx.rank_candidates(candidate_blocks(spark, d))


@query("rank_pipeline", with_code(_RANKED) + " select query_id, block_id, round(final, 6) as final, reranked, position from ranked")
def rank_pipeline(spark, d):
    return _ranked(spark, d).select("query_id", "block_id", R6("final"), "reranked", "position")


_ROLE = """, rsc as (select block_id, 0 as o, 'DEFINE' as role, (case when definitions > 0 then 0.5 else 0 end + case when signature_pct > 20 then 0.3 else 0 end) as score from meas
union all select block_id, 1, 'IMPLEMENT', (case when code_pct > 40 then 0.5 else 0 end + case when control_pct > 10 then 0.2 else 0 end) from meas
union all select block_id, 2, 'EXPLAIN', (case when docstring_pct > 30 then 0.5 else 0 end + case when comment_pct > 20 then 0.3 else 0 end) from meas union all select block_id, 3, 'SUPPORT', (case when error_pct > 15 then 0.4 else 0 end) from meas
union all select block_id, 4, 'NOISE', (case when logging_pct > 20 then 0.5 else 0 end + case when noise > 0.4 then 0.3 else 0 end + case when signal < 0.3 then 0.2 else 0 end) from meas),
rol as (select block_id, role from (select *, row_number() over (partition by block_id order by round(score, 3) desc, o) as r from rsc) where r = 1)"""
_BALANCE = f", {_MEASURED}{_ROLE}" + """, rbl as (select query_id, count(*) as n, count(case when role = 'DEFINE' then 1 end) as define, count(case when role = 'IMPLEMENT' then 1 end) as implement, count(case when role = 'EXPLAIN' then 1 end) as explain, count(case when role = 'SUPPORT' then 1 end) as support, count(case when role = 'NOISE' then 1 end) as noise from (select query_id, block_id from cand where rank <= 5) join rol using (block_id) group by 1),
bal as (select *, case when define = 0 and implement > 0 then 'insufficient' else 'ok' end as define_status, case when implement > n * 0.7 then 'dominant' else 'ok' end as implement_status, case when explain = 0 and n > 3 then 'insufficient' else 'ok' end as explain_status from rbl)"""


def _balance(spark, d):
    roles = dg.roles(_measured(spark, d), "block_id")
    return cx.role_balance(code_candidates(spark, d).filter(F.col("rank") <= 5).join(roles, "block_id"))


@query("role_balance", with_code(_BALANCE) + " select query_id, n, define, implement, explain, support, noise, define_status, implement_status, explain_status, define_status = 'ok' and implement_status = 'ok' and explain_status = 'ok' as balanced, round(least(1, (explain + define) / n), 6) as completeness from bal")
def role_balance(spark, d):
    return _balance(spark, d).select("query_id", "n", "define", "implement", "explain", "support", "noise", "define_status", "implement_status", "explain_status", "balanced", R6("completeness"))


@query("failure_mode", with_code(_COVERAGE + _BALANCE) + """ select query_id, case when ratio >= 0.8 and query_id % 6 = 0 then 'HIGH_COGNITIVE_LOAD' when ratio >= 0.8 then 'NONE' when define_status <> 'ok' then 'MISSING_DEFINITION' when explain_status <> 'ok' then 'MISSING_EXPLANATION' when implement_status <> 'ok' then 'IMPLEMENTATION_ONLY' when n_claims > n_covered then 'LOW_COVERAGE' when query_id % 6 = 0 then 'HIGH_COGNITIVE_LOAD' else 'NONE' end as mode from gate join bal using (query_id)""")
def failure_mode(spark, d):
    x = op.claim_gate(_coverage(spark, d)).join(_balance(spark, d), "query_id")
    return x.select("query_id", cx.failure_mode(F.col("ratio"), F.col("query_id") % 6 == 0, F.col("n_claims") - F.col("n_covered")).alias("mode"))


@query("cognitive_load", with_code(f", {_MEASURED}{_ROLE}" + f""", nm as (select block_id, {_found('content', '[A-Za-z_][A-Za-z0-9_]*')} as w, list_max(list_transform(string_split(content, chr(10)), lambda x: (length(x) - length(ltrim(x))) // 4)) as depth from code),
nu as (select block_id, depth, len(list_distinct(w)) as u, len(w) as t, len(list_filter(list_distinct(w), lambda y: len(list_filter(w, lambda z: z = y)) > 1)) as again from nm),
ls as (select block_id, depth, u / t as density, round(case when depth >= 2 then least(1, depth / 5) else 0 end * 0.25 + case when control_pct > 25 then least(1, control_pct / 40) else 0 end * 0.25 + case when u / t > 0.5 then u / t else 0 end * 0.2 + case when u > 10 and again < 3 then 0.5 else 0 end * 0.15 + case when role = 'IMPLEMENT' then 0.3 else 0 end * 0.15, 9) as score from nu join meas using (block_id) join rol using (block_id))
select block_id, depth, round(density, 6) as density, round(score, 6) as score, case when score > 0.5 then 'HIGH' when score > 0.25 then 'MEDIUM' else 'LOW' end as level from ls"""))
def cognitive_load(spark, d):
    m = _measured(spark, d)
    return cx.cognitive_load(code_blocks(spark, d), m, dg.roles(m, "block_id")).select("block_id", "depth", R6("density"), R6("score"), "level")


@query("entity_confidence", with_code("""select block_id, least(1.0, 0.3 + case when contains(content, '\"\"\"') then 0.4 else 0 end + case when file like '%.py' then 0.2 else 0 end + case when contains(content, '):') then 0.1 else 0 end)::double as confidence from code where symbol <> ''"""))
def entity_confidence(spark, d):
    c = code_blocks(spark, d).filter("symbol <> ''")
    return c.select("block_id", cx.entity_confidence(F.col("symbol"), F.col("content").contains('"""'), F.col("file").endswith(".py"), F.col("content").contains("):")).alias("confidence"))


_MARKS = lambda marks: " + ".join(f"case when contains(lower(content), '{m}') then 1 else 0 end" for m in marks)
_EVIDENCE = f""", {_CONCEPTS}, qi as (select query_id, list_sort(list_distinct(list_filter(list_transform({_found('q', ev.QUERY_IDENTIFIER)}, lambda x: lower(x)), lambda x: length(x) >= 4))) as h from questions),
es_ as (select cand.query_id, block_id, content, case when rank <= 5 then 30 else greatest(0, 12 - rank) end + case when file like '%.md' then -10 else 12 end + case when symbol <> '' then 5 else 0 end + least(8, len(list_filter(c, lambda t: contains(lower(content), t) or contains(lower(file || ' ' || symbol), t)))) + 4 * len(list_filter(h, lambda t: contains(lower(content), t) or contains(lower(file || ' ' || symbol), t))) as s from cand join code using (block_id) join qc using (query_id) join qi using (query_id)),
es as (""" + " union all ".join(f"select query_id, block_id, {i} as o, '{n}' as role, s + 5 * ({_MARKS(m)}) as score from es_" for i, (n, m) in enumerate(cx.ROLES)) + ")"


def _evidence(spark, d):
    return cx.evidence_scores(candidate_blocks(spark, d, *cx.evidence_columns()), questions(spark, d))


@query("evidence_scores", with_code(_EVIDENCE) + " select query_id, block_id, role, score from es")
def evidence_scores(spark, d):
    return _evidence(spark, d).select("query_id", "block_id", "role", "score")


_BEST = lambda i, used: f"p{i} as (select query_id, role, block_id, score from (select *, row_number() over (partition by query_id order by score desc, block_id) as r from es where o = {i}{''.join(f' and not exists (select 1 from p{j} where p{j}.query_id = es.query_id and p{j}.block_id = es.block_id)' for j in used)}) where r = 1)"


@query("evidence_picks", with_code(_EVIDENCE) + f", {_BEST(0, [])}, {_BEST(1, [0])}, {_BEST(2, [0, 1])} select * from p0 union all select * from p1 union all select * from p2")
def evidence_picks(spark, d):
    return cx.evidence_picks(_evidence(spark, d))


@query("support_surface", with_code("select query_id, block_id, case when rank % 3 = 0 and rank <= 30 then 'final_context' else 'ranked_surface' end as source, case when rank % 3 = 0 and rank <= 30 then -1 else rank end as rank from cand where rank <= 40"))
def support_surface(spark, d):
    c = code_candidates(spark, d)
    return cx.support_surface(c, c.filter("rank % 3 = 0 and rank <= 30"))


@query("merged_plans", with_code(f", {_MEASURED}, pa as (" + " union all ".join(f"select block_id, '{r.action}' as action, {dg.ACTIONS[r.action]} as priority, {r.confidence} as confidence, 0 as p from meas where {r.when}" for r in dg.ACTION_RULES) + """ union all select block_id, 'KEEP', 2, 0.5, 1 from meas where signal > 0.6)
select action, file, min(priority) as priority, max(confidence)::double as confidence, count(distinct p) as n_plans from pa join code using (block_id) group by 1, 2"""))
def merged_plans(spark, d):
    plans = (dg.ACTION_RULES, (dg.ActionRule("signal_keep", "KEEP", 0.5, "signal > 0.6"),))
    return cx.best_actions(dg.propose_plans(_measured(spark, d, "file"), "file", plans), "file", len(plans))


@query("simple_paths", """with e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 'o' || l_orderkey from lineitem),
f as (select src, dst from (select *, row_number() over (partition by src order by dst) as r from e) where r <= 5), pr as (select src, dst from f where src like 's%' union select distinct 's' || l_suppkey, 'o' || l_orderkey from lineitem)
select src, dst, src || '>' || dst as path from f join pr using (src, dst) union all select a.src, b.dst, a.src || '>' || a.dst || '>' || b.dst from f a join f b on a.dst = b.src join pr on pr.src = a.src and pr.dst = b.dst""")
def simple_paths(spark, d):
    from pyspark.sql import Window as W

    li = table(spark, d, "lineitem").select(*[F.concat(F.lit(p), c).alias(p) for p, c in (("s", "l_suppkey"), ("p", "l_partkey"), ("o", "l_orderkey"))])
    edges = li.select(F.col("s").alias("src"), F.col("p").alias("dst")).union(li.select("p", "o")).distinct()
    few = edges.filter("src like 's%'").withColumn("_r", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter("_r <= 5").select("src", "dst")
    x = cx.simple_paths(edges, few.union(li.select("s", "o")).distinct())
    return x.select("src", "dst", F.array_join("path", ">").alias("path"))


_STITCH = _RANKED + """, stc as (select query_id, string_agg('### ' || code.file || case when code.symbol <> '' then ' :: ' || code.symbol else '' end || chr(10) || content, chr(10) || chr(10) order by position) as context, count(*) as n_blocks from ranked join code using (block_id) where position <= 4 group by 1)"""


def _stitched(spark, d):
    return cx.stitch(_ranked(spark, d).filter("position <= 4").join(code_blocks(spark, d), "block_id"), "query_id", "position")


@query("stitched_context", with_code(_STITCH) + " select query_id, md5(context) as digest, length(context) as n_chars, n_blocks from stc")
def stitched_context(spark, d):
    return _stitched(spark, d).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").alias("n_chars"), "n_blocks")


_TEMPLATE = "Answer from the context only.\\nContext:\\n{context}\\nQuestion: {question}\\n"


@query("token_attribution", with_code(_STITCH) + """ select query_id, length('Answer from the context only.' || chr(10) || 'Context:' || chr(10) || context || chr(10) || 'Question: ' || q || chr(10)) // 4 as total, length(context) // 4 as visible, length(q) // 4 as question, length('Answer from the context only.' || chr(10) || 'Context:' || chr(10) || context || chr(10) || 'Question: ' || q || chr(10)) // 4 - length(context) // 4 - length(q) // 4 as template from stc join questions using (query_id)""")
def token_attribution(spark, d):
    x = _stitched(spark, d).join(questions(spark, d), "query_id")
    x = x.withColumn("prompt", cx.render(_TEMPLATE.replace("\\n", "\n"), context=F.col("context"), question=F.col("q")))
    n = {c: tx.tokens_quarter(F.col(c)) for c in ("prompt", "context", "q")}
    return x.select("query_id", n["prompt"].alias("total"), n["context"].alias("visible"), n["q"].alias("question"), (n["prompt"] - n["context"] - n["q"]).alias("template"))


@query("kernel_metrics", with_code(""", k as (select cand.*, file, base + 0.37 * rerank as final, greatest(1, length(content) // 4) as tokens from cand join code using (block_id)),
fe as (select query_id, file, count(*) as n from k group by 1, 2), en as (select query_id, case when count(*) <= 1 then 0 else sum(-p * log2(p)) end as h from (select query_id, n / sum(n) over (partition by query_id) as p from fe) group by 1)
select query_id, round(avg(rerank), 8) as m1, round(any_value(h), 6) as m3, round(max(final) - min(final), 6) as m5, round(case when var_pop(final) < 1e-15 then 0 else least(1, var_pop(0.37 * rerank) / var_pop(final)) end, 6) as m6, round(sum(tokens) / 4000, 6) as m7 from k join en using (query_id) group by 1"""))
def kernel_metrics(spark, d):
    from pyspark.sql import Window as W

    k = candidate_blocks(spark, d, "file", tx.tokens_quarter_min1(F.col("content")).alias("tokens")).withColumn("final", F.col("base") + 0.37 * F.col("rerank"))
    h, _ = op.group_entropy(F.col("held"), F.log2)
    more = (F.avg("rerank").alias("m1"), h.alias("m3"), (F.max("final") - F.min("final")).alias("m5"), (F.sum("tokens") / 4000).alias("m7"))
    x = op.geometry(k.withColumn("held", F.count("*").over(W.partitionBy("query_id", "file"))), 0.37, more=more)
    return x.select("query_id", F.round("m1", 8).alias("m1"), R6("m3"), R6("m5"), F.round("influence", 6).alias("m6"), R6("m7"))


@query("query_summaries", """select c.conv_id, c.turn, length(c.text) // 4 as tokens, e.n as n_events, l.quality, coalesce(l.toxic, 0) as toxic from conversations c left join (select user_id, count(*) as n from events group by 1) e on e.user_id = c.conv_id left join (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by 1) l on l.doc_id = c.conv_id where role = 'assistant'""")
def query_summaries(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.count("*").alias("n_events"))
    b = table(spark, d, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return c.join(e, "conv_id", "left").join(b, "conv_id", "left").select("conv_id", "turn", tx.tokens_quarter(F.col("text")).alias("tokens"), "n_events", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))
