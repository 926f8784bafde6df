"""Diagnostic queries: block measures, roles, actions, sufficiency and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import classify as cl
from ..operators import diagnostics as dg
from ._base import table, with_corpus
from ._code import code_blocks, with_code
from .textual import _rules_sql

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_KIND = "case " + " ".join(f"when regexp_matches(x, '{p}') then '{n}'" for n, p in dg.LINE_CLASSES).replace("\\t", "\t") + " else 'code' end"
_PCT = ", ".join(f"count(case when k = '{c}' then 1 end) * 100.0 / count(*) as {c}_pct" for c in ("comment", "logging", "imports", "signature", "error", "control", "code", "docstring"))
# A line is within a docstring if an odd number of lines before it hold one mark alone.
_MEASURED = f"""li as (select block_id, unnest(l) as x, unnest(range(1, len(l) + 1)) as i from (select block_id, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') as l from code)),
lq as (select *, len(regexp_extract_all(x, '\"\"\"')) as q from li), lo as (select *, coalesce(sum(case when q = 1 then 1 else 0 end) over (partition by block_id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from lq),
lk as (select *, case when inside or regexp_matches(x, '^ *\"\"\"') then 'docstring' else {_KIND} end as k from lo),
m as (select block_id, count(*) as n, {_PCT}, case when count(case when length(trim(x)) > 20 then 1 end) = 0 then 0 else (count(case when length(trim(x)) > 20 then 1 end) - count(distinct case when length(trim(x)) > 20 then x end)) / count(case when length(trim(x)) > 20 then 1 end) end as boilerplate,
  count(case when k = 'signature' and regexp_matches(x, '^ *(def) ') then 1 end) as functions, count(case when k = 'signature' and regexp_matches(x, '^ *(def|class) ') then 1 end) as definitions from lk group by 1),
sn as (select *, code_pct + control_pct + 0.5 * signature_pct as s, 0.5 * comment_pct + logging_pct + imports_pct + 0.3 * docstring_pct + 20 * boilerplate as z from m),
meas as (select *, case when s + z = 0 then 0.5 else round(least(1.0, s / 100), 2) end as signal, case when s + z = 0 then 0.5 else round(least(1.0, z / 100), 2) end as noise from sn)"""
_PROPOSED = "prop as (" + " union all ".join(f"select block_id, '{r.name}' as rule, '{r.action}' as action, {dg.ACTIONS[r.action]} as priority, {r.confidence} as confidence from meas where {r.when}" for r in dg.ACTION_RULES) + ")"


def _measured(spark, d, *keep):
    return dg.signal_noise(dg.composition(code_blocks(spark, d), "block_id", "content", keep))


@query("code_composition", with_code(f", {_MEASURED} select block_id, n as n_lines, " + ", ".join(f"round({c}_pct, 4) as {c}_pct" for c in ("comment", "logging", "imports", "signature", "error", "control", "code", "docstring")) + ", functions, definitions from meas"))
def block_composition(spark, d):
    x = _measured(spark, d)
    return x.select("block_id", "n_lines", *[F.round(f"{c}_pct", 4).alias(f"{c}_pct") for c in ("comment", "logging", "imports", "signature", "error", "control", "code", "docstring")], "functions", "definitions")


@query("block_signal_noise", with_code(f", {_MEASURED} select block_id, n as n_lines, round(code_pct, 4) as code_pct, round(boilerplate, 6) as boilerplate, cast(signal as double) as signal, cast(noise as double) as noise from meas"))
def block_signal_noise(spark, d):
    return _measured(spark, d).select("block_id", "n_lines", F.round("code_pct", 4).alias("code_pct"), F.round("boilerplate", 6).alias("boilerplate"), "signal", "noise")


@query("block_warnings", with_code(f", {_MEASURED} select block_id, concat_ws(',', case when signal < 0.3 then 'noise' end, case when comment_pct > 40 then 'comments' end, case when logging_pct > 20 then 'logging' end, case when error_pct > 30 then 'error_handling' end, case when boilerplate > 0.3 then 'repeats' end) as warnings from meas"))
def block_warnings(spark, d):
    m = _measured(spark, d)
    return m.select("block_id", F.array_join(dg.warnings(m), ",").alias("warnings"))


@query("action_proposals", with_code(f", {_MEASURED}, {_PROPOSED} select block_id, rule, action, cast(priority as bigint) as priority, cast(confidence as double) as confidence from prop"))
def action_proposals(spark, d):
    return dg.propose(_measured(spark, d), "block_id")


_WIN = "win as (select * from (select *, count(*) over (partition by block_id) as n_proposals, row_number() over (partition by block_id order by priority, confidence desc, rule) as r from prop) where r = 1)"


@query("action_winner", with_code(f", {_MEASURED}, {_PROPOSED}, {_WIN} select block_id, rule, action, cast(confidence as double) as confidence, n_proposals from win"))
def action_winner(spark, d):
    return dg.winners(dg.propose(_measured(spark, d), "block_id"), "block_id")


@query("apply_actions", with_code(f", {_MEASURED}, {_PROPOSED}, {_WIN}, gone as (select block_id from win where action in ('DROP', 'DEDUPE')) select block_id, file from code where not (block_id in (select block_id from gone) and (select count(*) from gone) <= 0.8 * (select count(*) from code))"))
def apply_actions(spark, d):
    actions = dg.winners(dg.propose(_measured(spark, d), "block_id"), "block_id")
    return dg.apply_actions(code_blocks(spark, d).select("block_id", "file"), actions, "block_id")


@query("role_scores", with_code(f""", {_MEASURED}, s as (select block_id, 0 as o, 'DEFINE' as role, (case when definitions > 0 then 0.5 else 0 end + case when signature_pct > 20 then 0.3 else 0 end) as score from meas
union all select block_id, 1, 'IMPLEMENT', (case when code_pct > 40 then 0.5 else 0 end + case when control_pct > 10 then 0.2 else 0 end) from meas
union all select block_id, 2, 'EXPLAIN', (case when docstring_pct > 30 then 0.5 else 0 end + case when comment_pct > 20 then 0.3 else 0 end) from meas union all select block_id, 3, 'SUPPORT', (case when error_pct > 15 then 0.4 else 0 end) from meas
union all select block_id, 4, 'NOISE', (case when logging_pct > 20 then 0.5 else 0 end + case when noise > 0.4 then 0.3 else 0 end + case when signal < 0.3 then 0.2 else 0 end) from meas)
select block_id, role, cast(score as double) as score from (select *, row_number() over (partition by block_id order by round(score, 3) desc, o) as r from s) where r = 1"""))
def role_scores(spark, d):
    return dg.roles(_measured(spark, d), "block_id")


@query("sufficiency_decision", with_corpus(""", c as (select item_id as query_id, coalesce(n, 0) as n, coalesce(f, 0) as f from benchmark left join (select query_id, count(*) as n, count(distinct file) as f from fused join docx using (doc_id) group by 1) on item_id = query_id)
select query_id, n > 0 and n >= 18 and f >= 12 as sufficient, round((least(n / 18, 1.0) + least(f / 12, 1.0)) / 2, 3) as score, concat_ws(',', case when n = 0 then 'empty_evidence' end, case when n < 18 then 'insufficient_candidates' end, case when f < 12 then 'insufficient_context_blocks' end) as missing from c"""))
def sufficiency_decision(spark, d):
    from ._base import bench_queries, candidates

    c = candidates(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("file").alias("f"))
    c = bench_queries(spark, d).select("query_id").join(c, "query_id", "left").fillna(0)
    return dg.sufficiency(c, "query_id", "n", "f", 18, 12)


_STEP = an.STEP.replace("(?m:^\\s*\\d+[.):])", "(?m:^\\s*\\d+[.):])")


@query("answer_scores", f"""with q as (select conv_id, {_rules_sql(cl.QUERY_TYPE_RULES, 'explanation')} as kind from (select conv_id, text, row_number() over (partition by conv_id order by turn) as r from conversations where role = 'user') where r = 1),
a as (select conv_id, turn, coalesce(kind, 'explanation') as kind, len(regexp_extract_all(lower(text), '({_STEP})', 1)) as steps, len(regexp_extract_all(lower(text), '({an.CONTRAST})', 1)) as contrasts from conversations left join q using (conv_id) where role = 'assistant')
select conv_id, turn, kind, steps, contrasts, cast(case when kind <> 'trace' then 1.0 when steps >= 5 then 1.0 when steps >= 3 then 0.7 when steps >= 1 then 0.4 else 0.1 end as double) as step_score, cast(case when kind <> 'comparison' then 1.0 when contrasts >= 6 then 1.0 when contrasts >= 3 then 0.7 when contrasts >= 1 then 0.4 else 0.1 end as double) as contrast_score from a""")
def answer_scores(spark, d):
    c = table(spark, d, "conversations")
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked")).select("conv_id", cl.query_type(F.col("asked")).alias("kind"))
    a = c.filter("role = 'assistant'").join(q, "conv_id", "left").withColumn("kind", F.coalesce("kind", F.lit("explanation")))
    t, k = F.col("text"), F.col("kind")
    return a.select("conv_id", "turn", "kind", an._count(t, an.STEP).alias("steps"), an._count(t, an.CONTRAST).alias("contrasts"), an.step_score(t, k).alias("step_score"), an.contrast_score(t, k).alias("contrast_score"))


@query("missing_sources", "select l.lang, s.source from (select distinct lang from documents where lang is not null) l, (select distinct source from documents) s where not exists (select 1 from documents d join labels b on d.doc_id = b.doc_id where b.toxic = 1 and d.lang = l.lang and d.source = s.source)")
def missing_sources(spark, d):
    """Sources without a document of a language that is labelled toxic: distinct languages and sources are few."""
    docs = table(spark, d, "documents")
    langs = docs.select("lang").distinct().agg(F.collect_list("lang").alias("langs"))
    required = docs.select("source").distinct().join(F.broadcast(langs)).select(F.explode("langs").alias("lang"), "source")
    toxic = docs.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return dg.missing_items(required, toxic, "lang", "source").select("lang", "source")


@query("repeated_headings", with_code(""", l as (select block_id, unnest(string_split(content, chr(10))) as x from code) select block_id, heading, count(*) as n from (select block_id, lower(trim(regexp_replace(trim(x), '^#+', ''))) as heading from l where regexp_matches(trim(x), '^#{1,6}[ ]+[^ ]')) group by 1, 2 having count(*) > 1"""))
def repeated_headings(spark, d):
    flat = F.regexp_replace("content", "(^|\n)[ ]+", "$1")
    return dg.repeated_headings(code_blocks(spark, d).select("block_id", flat.alias("text")), "block_id")
