"""Feature-score and context-packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import packing as pk
from ._base import TOKENS, bench_queries, bm25, candidates, fused, tf, with_corpus

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R6 = lambda c: F.round(c, 6).alias(c)
_ROWS = ", rows_ as (select f.query_id, f.doc_id, f.score, f.rank, file, n_chars, case when length(text) = 0 then 0 else cast(greatest(1, floor(length(text) / 3.5)) as bigint) end as tokens from fused f join docx using (doc_id))"


def _rows(spark, d):
    return candidates(spark, d).withColumn("tokens", tx.tokens_by_length(F.col("text")).cast("long")).select("query_id", "doc_id", "score", "rank", "file", "n_chars", "tokens")


@query("feature_scores", with_corpus(f""", x as (select f.query_id, f.doc_id, coalesce(bm.score, 0) as b, coalesce(tfr.score, 0) as v, docx.file from fused f join docx using (doc_id) left join bm on bm.query_id = f.query_id and bm.doc_id = f.doc_id left join tfr on tfr.query_id = f.query_id and tfr.doc_id = f.doc_id),
y as (select *, case when max(b) over w > 0 then b / max(b) over w else 0 end as bn, case when max(v) over w > 0 then v / max(v) over w else 0 end as vn from x window w as (partition by query_id)),
z as (select y.query_id, doc_id, bn, vn, len(list_intersect(qt, [file])) / greatest(len(qt), 1) as name from y join (select item_id as query_id, list_distinct({TOKENS.format('text')}) as qt from benchmark) q on q.query_id = y.query_id)
select query_id, doc_id, round(0.4 * bn + 0.4 * vn + 0.2 * name, 6) as base, round(0.5 * (0.4 * bn + 0.4 * vn + 0.2 * name) + 0.1 * least(0.2, 0.05 * bn), 6) as final from z"""))
def feature_scores(spark, d):
    b, v = bm25(spark, d).select("query_id", "doc_id", F.col("score").alias("b")), tf(spark, d).select("query_id", "doc_id", F.col("score").alias("v"))
    q = bench_queries(spark, d).select("query_id", F.array_distinct(tx.tokens(F.col("text"))).alias("qt"))
    x = candidates(spark, d).select("query_id", "doc_id", "file").join(b, ["query_id", "doc_id"], "left").join(v, ["query_id", "doc_id"], "left").join(q, "query_id")
    x = pk.max_normalized(pk.max_normalized(x.fillna(0.0, ["b", "v"]), "b", "bn"), "v", "vn")
    base = pk.base_score(F.col("bn"), F.col("vn"), pk.name_match(F.col("qt"), F.array("file")))
    struct = pk.struct_bonus(F.lit(False), F.lit(False), F.col("bn"))
    return x.select("query_id", "doc_id", F.round(base, 6).alias("base"), F.round(pk.final_score(base, F.lit(None).cast("double"), struct), 6).alias("final"))


@query("budget_guard", with_corpus(_ROWS + " select query_id, doc_id, rank, cast(used as bigint) as used from (select *, sum(tokens) over (partition by query_id order by rank) as used from rows_) where used <= 4000"))
def budget_guard(spark, d):
    return pk.budget_guard(_rows(spark, d), 4000).select("query_id", "doc_id", "rank", "used")


@query("precision_filter", with_corpus(_ROWS + " select query_id, doc_id from (select *, n_chars >= 1000 as k, sum(case when n_chars >= 1000 then 1 else 0 end) over (partition by query_id) as n from rows_) where k or n < 8"))
def precision_filter(spark, d):
    return pk.filter_with_floor(_rows(spark, d), F.col("n_chars") >= 1000, 8).select("query_id", "doc_id")


@query("sparse_backfill", with_corpus(_ROWS + """, chosen as (select * from rows_ where rank <= 2), used as (select query_id, sum(tokens) as u from chosen group by 1),
rest as (select r.*, sum(tokens) over (partition by query_id order by rank) as upto from rows_ r where rank > 2)
select query_id, doc_id, rank, false as added from chosen union all select query_id, doc_id, rank, true from rest join used using (query_id) where upto + u <= 4000"""))
def sparse_backfill(spark, d):
    rows = _rows(spark, d)
    return pk.backfill(rows.filter("rank <= 2"), rows, 4000).select("query_id", "doc_id", "rank", "added")


@query("tail_density", with_corpus(_ROWS + """, n as (select *, score / greatest(tokens, 1) as density, count(*) over (partition by query_id) as n from rows_)
select query_id, round(avg(case when rank > n - 3 then density end) / greatest(avg(case when rank <= 3 then density end), 1e-9), 6) as ratio from n group by 1"""))
def tail_density(spark, d):
    rows = _rows(spark, d).withColumn("density", F.col("score") / F.greatest("tokens", F.lit(1)))
    return pk.tail_density_ratio(rows, "density").select("query_id", R6("ratio"))


@query("relevance_gate", with_corpus(" select query_id, round(max(score), 6) as best, max(score) < 0.15 as triggered from fused where rank <= 5 group by 1"))
def relevance_gate(spark, d):
    return pk.relevance_gate(fused(spark, d), "score", 5, 0.15).select("query_id", R6("best"), "triggered")


@query("count_reorders", with_corpus(", b as (select f.query_id, f.rank as r1, bm.rank as r0 from fused f join bm using (query_id, doc_id)), l as (select *, lag(r0) over (partition by query_id order by r1) > r0 as falls from b) select query_id, sum(case when falls then 1 else 0 end)::bigint as reorders from l group by 1"))
def count_reorders(spark, d):
    return pk.count_reorders(bm25(spark, d), fused(spark, d))


@query("elimination_ledger", with_corpus(_ROWS + ", u as (select *, sum(tokens) over (partition by query_id order by rank) as used from rows_) select query_id, doc_id, case when rank > 12 then 'cut' when used > 4000 then 'budget' else 'kept' end as eliminated_at from u"))
def elimination_ledger(spark, d):
    rows = _rows(spark, d)
    return pk.elimination_ledger([("fused", rows), ("cut", rows.filter("rank <= 12")), ("budget", pk.budget_guard(rows, 4000))])


@query("file_target", with_corpus(f""", s as (select query_id, file, sum(score) as s from fused join docx using (doc_id) group by 1, 2),
t as (select s.query_id, file, s + 0.2 * len(list_intersect(qt, [file])) as score from s join (select item_id as query_id, list_distinct({TOKENS.format('text')}) as qt from benchmark) q on q.query_id = s.query_id),
r as (select *, row_number() over w as r, lead(score) over w as nxt from t window w as (partition by query_id order by round(score, 9) desc, file))
select query_id, file, round(score, 6) as score, coalesce(score - nxt < 0.1, false) as ambiguous from r where r = 1"""))
def file_target(spark, d):
    q = bench_queries(spark, d).select("query_id", F.array_distinct(tx.tokens(F.col("text"))).alias("qt"))
    rows = _rows(spark, d).join(q, "query_id").withColumn("pt", F.array("file"))
    return pk.file_target(rows, "qt", "pt").select("query_id", "file", R6("score"), "ambiguous")
