"""Retrieval, fusion and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup, fusion, lexical, metrics, ranking, selection
from ..operators import vector as vec
from ._base import TOKENS, bench_queries, bm25, candidates, doc_columns, fused, table, tf, with_corpus

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R6 = lambda c: F.round(c, 6).alias(c)


@query("term_stats_idf", f"""with p as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS.format('text')}) as term from documents) group by 1, 2)
select term, count(*) as df, cast(sum(tf) as bigint) as cf, round(1 + ln((select count(*) from documents) / (1 + count(*))), 6) as idf from p group by term""")
def term_stats_idf(spark, d):
    return lexical.term_stats(table(spark, d, "documents")).select("term", "df", "cf", R6("idf"))


@query("bm25_topk", with_corpus("select query_id, doc_id, round(score, 6) as score, rank from bm"))
def bm25_topk(spark, d):
    return bm25(spark, d).select("query_id", "doc_id", R6("score"), "rank")


@query("bm25_relaxed_fallback", with_corpus(f"""
, need as (select query_id, count(*) as need from qt group by 1),
strict as (select query_id, doc_id, score, false as relaxed from bm_all join need using (query_id) where n_terms = need),
sq as (select item_id as query_id, {TOKENS.format('text')}[1:12] as t from benchmark where item_id not in (select query_id from strict)),
st as (select distinct query_id, term from (select query_id, unnest(t) as term from sq)),
loose as (select query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) as score, true as relaxed
  from st join post using (term) join dfs using (term), corpus group by 1, 2),
u as (select * from strict union all select * from loose)
select query_id, doc_id, round(score, 6) as score, relaxed, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from u) where rank <= 10"""))
def bm25_relaxed_fallback(spark, d):
    return lexical.bm25_with_fallback(table(spark, d, "documents"), bench_queries(spark, d)).select("query_id", "doc_id", R6("score"), "relaxed", "rank")


@query("tf_topk", with_corpus("select query_id, doc_id, round(score, 6) as score, rank from tfr"))
def tf_topk(spark, d):
    return tf(spark, d).select("query_id", "doc_id", R6("score"), "rank")


_DIST = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (cast(a.embedding[i] as double) - b.embedding[i]) ** 2))"


def _vector_sql(sim: str) -> str:
    return f"""select query_id, vec_id, round(distance, 6) as distance, round({sim}, 6) as similarity, rank from (
select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank from (
select b.vec_id as query_id, a.vec_id, {_DIST} as distance from embeddings a, embeddings b where b.vec_id % 50 = 0 and a.vec_id <> b.vec_id)) where rank <= 10"""


@query("vector_topk_l2", _vector_sql("1 / (1 + distance)"))
def vector_topk_l2(spark, d):
    v = table(spark, d, "embeddings")
    return vec.vector_topk(v, v.filter("vec_id % 50 = 0")).select("query_id", "vec_id", R6("distance"), R6("similarity"), "rank")


@query("vector_topk_calibrated", _vector_sql("1 / (1 + distance * distance)"))
def vector_topk_calibrated(spark, d):
    v = table(spark, d, "embeddings")
    return vec.vector_topk(v, v.filter("vec_id % 50 = 0"), mode="calibrated_v1").select("query_id", "vec_id", R6("distance"), R6("similarity"), "rank")


@query("vector_cosine_threshold", """with n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
m as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from n)
select * from (select b.vec_id as query_id, a.vec_id, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm), 6) as cosine
from m a, m b where b.vec_id % 50 = 0 and a.vec_id <> b.vec_id) where cosine >= 0.3""")
def vector_cosine_threshold(spark, d):
    v = table(spark, d, "embeddings")
    return vec.cosine_matches(v, v.filter("vec_id % 50 = 0"), 0.29).select("query_id", "vec_id", R6("cosine")).filter("cosine >= 0.3")


_UNNEST = "select label, unnest(range(0, len(embedding))) as dim, cast(unnest(embedding) as double) as x from embeddings"


@query("label_centroids", f"select label, dim, round(avg(x), 6) as mean, count(*) as n from ({_UNNEST}) group by 1, 2")
def label_centroids(spark, d):
    return vec.centroids(table(spark, d, "embeddings")).select("label", "dim", R6("mean"), "n")


@query("embedding_dispersion", f"""with p as (select label, dim, avg(x) as m, avg(x * x) as m2, count(*) as n from ({_UNNEST}) group by 1, 2)
select label, max(n) as n, round(sum(m2 - m * m), 6) as mean_sq_distance, round(sum(m2 - m * m) / (1 + sum(m2 - m * m)), 6) as consistency from p group by 1""")
def embedding_dispersion(spark, d):
    return vec.dispersion(table(spark, d, "embeddings")).select("label", "n", R6("mean_sq_distance"), R6("consistency"))


@query("rrf_fusion", with_corpus("""select f.query_id, f.doc_id, round(f.score, 6) as score, (select array_to_string(list_sort(list_distinct(list(src))), ',') from both_lists b where b.query_id = f.query_id and b.doc_id = f.doc_id) as provenance, f.rank from fused f"""))
def rrf_fusion(spark, d):
    return fused(spark, d).select("query_id", "doc_id", R6("score"), F.array_join("provenance", ",").alias("provenance"), "rank")


@query("linear_fusion", with_corpus(""", x as (select query_id, doc_id, 0.5 * score / max(score) over (partition by query_id) as p from bm union all select query_id, doc_id, 0.5 * score / max(score) over (partition by query_id) from tfr),
s as (select query_id, doc_id, sum(p) as score from x group by 1, 2)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s"""))
def linear_fusion(spark, d):
    return fusion.linear(bm25(spark, d), tf(spark, d)).select("query_id", "doc_id", R6("score"), "rank")


@query("keep_best_union", with_corpus("select query_id, doc_id, round(max(score), 6) as score from (select query_id, doc_id, score from bm union all select query_id, doc_id, score from tfr) group by 1, 2"))
def keep_best_union(spark, d):
    return fusion.keep_best([bm25(spark, d), tf(spark, d)]).select("query_id", "doc_id", R6("score"))


@query("knee_gate", with_corpus(""", g as (select query_id, score, row_number() over w - 1 as i, count(*) over (partition by query_id) as n, coalesce(score - lead(score) over w, 0) as gap from fused window w as (partition by query_id order by rank)),
m as (select *, avg(gap) over (partition by query_id order by i rows between 1 preceding and 1 following) as mean from g),
k as (select query_id, max(n) as n, min(case when i >= 3 and i < least(n - 1, 15) and score > 0 and mean / score > 0.05 then i end) as knee from m group by 1)
select query_id, n, case when n <= 3 then n else greatest(3, least(least(15, n), coalesce(knee, n))) end as keep from k"""))
def knee_gate(spark, d):
    return ranking.knee_gate(fused(spark, d), 3, 15, 0.05)


_COMMON = """, c as (select query_id, row_number() over (partition by query_id order by bm.rank) as ra, row_number() over (partition by query_id order by tfr.rank) as rb from bm join tfr using (query_id, doc_id))"""


@query("rank_spearman", with_corpus(_COMMON + """, s as (select query_id, count(*) as n, sum((ra - rb) * (ra - rb)) as d2 from c group by 1),
r as (select query_id, n, case when n < 2 then 0.0 else 1 - 6.0 * d2 / (n * (n * n - 1)) end as rho from s)
select query_id, n, round(rho, 6) as spearman, round(greatest(0, least(1, 1 - rho)), 6) as disagreement from r"""))
def rank_spearman(spark, d):
    return ranking.spearman(bm25(spark, d), tf(spark, d)).select("query_id", "n", R6("spearman"), R6("disagreement"))


@query("rank_kendall", with_corpus(_COMMON + """, n as (select query_id, count(*) as n from c group by 1),
p as (select a.query_id, sum(sign((a.ra - b.ra) * (a.rb - b.rb))) as t from c a join c b on a.query_id = b.query_id group by 1)
select query_id, n, round(case when n < 2 then 0.0 else t / (n * (n - 1)) end, 6) as kendall from n join p using (query_id)"""))
def rank_kendall(spark, d):
    return ranking.kendall(bm25(spark, d), tf(spark, d)).select("query_id", "n", R6("kendall"))


@query("score_margin_entropy", with_corpus(""", t as (select *, sum(score) over (partition by query_id) as s from fused),
x as (select query_id, max(case when rank = 1 then score end) as s1, max(case when rank = 2 then score end) as s2, sum(-(score / s) * ln(score / s)) as h, count(*) as n from t group by 1)
select query_id, round(case when s2 is null then 0 else (s1 - s2) / s1 end, 6) as margin, round(case when n < 2 then 0 else h / ln(n) end, 6) as entropy from x"""))
def score_margin_entropy(spark, d):
    return ranking.margin_entropy(fused(spark, d)).select("query_id", R6("margin"), R6("entropy"))


@query("granularity_boost", with_corpus(""", b as (select query_id, doc_id, granularity, score * case granularity when 'fine' then 2.0 when 'medium' then 1.2 else 0.8 end as score, rank as old_rank from fused join docx using (doc_id))
select query_id, doc_id, granularity, round(score, 6) as score, old_rank, row_number() over (partition by query_id order by round(score, 9) desc, old_rank) as rank from b"""))
def granularity_boost(spark, d):
    return ranking.granularity_boost(candidates(spark, d), "IMPLEMENT").select("query_id", "doc_id", "granularity", R6("score"), "old_rank", "rank")


@query("granularity_mix", with_corpus("""select query_id, doc_id, granularity, row_number() over (partition by query_id, granularity order by rank) <= case granularity when 'fine' then 3 when 'medium' then 2 else 1 end as taken from fused join docx using (doc_id)"""))
def granularity_mix(spark, d):
    return ranking.granularity_mix(candidates(spark, d), {"fine": 3, "medium": 2, "coarse": 1}).select("query_id", "doc_id", "granularity", "taken")


_HIER = """, c as (select query_id, doc_id, file, granularity, rank, sum(case when granularity = 'fine' then 1 else 0 end) over (partition by query_id, file) as f, row_number() over (partition by query_id, file, granularity order by rank) as pos from fused join docx using (doc_id))
select query_id, doc_id, file, granularity from c where not ((granularity = 'coarse' and f > 0) or (granularity = 'medium' and f >= 2))"""


@query("hierarchical_dedup", with_corpus(_HIER))
def hierarchical_dedup(spark, d):
    return ranking.hierarchical_dedup(candidates(spark, d)).select("query_id", "doc_id", "file", "granularity")


@query("hierarchical_dedup_keep_best", with_corpus(_HIER + " or pos = 1"))
def hierarchical_dedup_keep_best(spark, d):
    return ranking.hierarchical_dedup(candidates(spark, d), True).select("query_id", "doc_id", "file", "granularity")


@query("rank_churn", with_corpus(""", c as (select query_id, a.rank as r0, b.rank as r1 from bm a join fused b using (query_id, doc_id))
select query_id, round(avg(case when r0 <> r1 then 1.0 else 0.0 end), 6) as changed, round(avg(abs(r1 - r0)), 6) as mean_shift, max(abs(r1 - r0)) as max_shift,
round(sum(case when r0 <= 5 and r1 <= 5 then 1 else 0 end) / greatest(sum(case when r0 <= 5 then 1 else 0 end), 1), 6) as top_n_stability from c group by 1"""))
def rank_churn(spark, d):
    return ranking.rank_churn(bm25(spark, d), fused(spark, d), 5).select("query_id", R6("changed"), R6("mean_shift"), "max_shift", R6("top_n_stability"))


@query("file_concentration", with_corpus(""", c as (select query_id, file, count(*) as c from fused join docx using (doc_id) where rank <= 10 group by 1, 2),
t as (select *, sum(c) over (partition by query_id) as n from c)
select query_id, count(*) as files, round(max(c / n), 6) as top_share, round(sum(-(c / n) * ln(c / n)) / ln(10), 6) as entropy_k from t group by 1"""))
def file_concentration(spark, d):
    return metrics.concentration(candidates(spark, d)).select("query_id", "files", R6("top_share"), R6("entropy_k"))


_CUT = "cast(greatest(1, floor(length(text) / 3.5)) as bigint)"


@query("running_budget_skip", "with recursive" + with_corpus(f""", c as (select query_id, rank, doc_id, case when length(text) = 0 then 0 else {_CUT} end as cost from fused join docx using (doc_id)),
f as (select query_id, 0 as pos, 0::bigint as used, null::bigint as doc_id, null::bigint as cost, false as kept from (select distinct query_id from c)
 union all select f.query_id, f.pos + 1, case when f.used + c.cost <= 1800 then f.used + c.cost else f.used end, c.doc_id, c.cost, f.used + c.cost <= 1800 from f join c on c.query_id = f.query_id and c.rank = f.pos + 1)
select query_id, cast(pos as bigint) as rank, doc_id, cost, used from f where kept""")[4:])
def running_budget_skip(spark, d):
    rows = candidates(spark, d).withColumn("tokens", tx.tokens_by_length(F.col("text")))
    return selection.budget_skip(rows, 2000, 200)


@query("query_term_recall", with_corpus(f""", q as (select item_id as query_id, list_distinct({TOKENS.format('text')}) as qt from benchmark),
w as (select query_id, list_distinct(flatten(list({TOKENS.format('text')}))) as dt from fused join docx using (doc_id) where rank <= 5 group by 1)
select query_id, len(qt) as n_terms, round(case when len(qt) = 0 then 0 else len(list_intersect(qt, dt)) / len(qt) end, 6) as recall from q join w using (query_id)"""))
def query_term_recall(spark, d):
    q = bench_queries(spark, d).select("query_id", F.array_distinct(tx.tokens(F.col("text"))).alias("qt"))
    top = candidates(spark, d).filter("rank <= 5").select("query_id", F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    hit = q.select("query_id", F.explode("qt").alias("term")).join(top, ["query_id", "term"], "left_semi").groupBy("query_id").count()
    return q.join(hit, "query_id").select("query_id", F.size("qt").alias("n_terms"), F.round(F.col("count") / F.size("qt"), 6).alias("recall"))


def _blocks(spark, d):
    terms = F.array_distinct(tx.tokens(F.col("text")))
    q = bench_queries(spark, d).select("query_id", F.array_distinct(tx.tokens(F.col("text"))).alias("query_terms"))
    rows = candidates(spark, d).filter("rank <= 10").withColumn("terms", terms).withColumn("tokens", tx.tokens_by_length(F.col("text")))
    return rows.join(q, "query_id").select("query_id", "doc_id", "score", "rank", "file", "terms", "query_terms", "tokens")


@query("cqi4", with_corpus(f""", b as (select query_id, f.doc_id, f.rank, f.score, file, list_distinct({TOKENS.format('text')}) as terms, bm.score as sem from fused f join docx using (doc_id) left join bm using (query_id, doc_id) where f.rank <= 10),
b2 as (select query_id, rank, score, file, terms, coalesce(sem, 0) / 100 as sem from b),
p as (select a.query_id, len(list_intersect(a.terms, c.terms)) / len(list_distinct(list_concat(a.terms, c.terms))) as j from b2 a join b2 c on a.query_id = c.query_id and a.rank < c.rank where len(list_concat(a.terms, c.terms)) > 0),
m4 as (select query_id, avg(j) as m4 from p group by 1),
fc as (select query_id, file, count(*) as c from b2 group by 1, 2), ft as (select *, sum(c) over (partition by query_id) as t from fc),
m3 as (select query_id, sum(-(c / t) * ln(c / t)) / ln(2) as m3 from ft group by 1),
m5 as (select query_id, max(score) - min(score) as m5, avg(abs(score - sem)) as m6 from b2 group by 1),
x as (select query_id, m3, coalesce(m4, 0) as m4, m5, m6 from m3 join m5 using (query_id) left join m4 using (query_id)),
z as (select *, greatest(-3, least(3, (m4 - 0.197) / (0.180 + 1e-6))) as z4, greatest(-3, least(3, (m3 - 2.02) / (0.59 + 1e-6))) as z3, greatest(-3, least(3, (m5 - 0.091) / (0.049 + 1e-6))) as z5, greatest(-3, least(3, (m6 - 0.188) / (0.094 + 1e-6))) as z6 from x),
c as (select *, 1 / (1 + exp(-(0.5 * (0.5682 * z4 - 0.4318 * z3) + 0.5 * (0.5626 * z5 + 0.4374 * z6)))) as cqi from z)
select query_id, round(m3, 6) as m3, round(m4, 6) as m4, round(m5, 6) as m5, round(m6, 6) as m6, round(cqi, 6) as cqi, case when cqi >= 0.65 then 'excellent' when cqi >= 0.5 then 'good' when cqi >= 0.35 then 'fair' else 'poor' end as zone from c"""))
def cqi4(spark, d):
    sem = bm25(spark, d).select("query_id", "doc_id", (F.col("score") / 100).alias("sem"))
    rows = _blocks(spark, d).join(sem, ["query_id", "doc_id"], "left").withColumn("semantic", F.coalesce("sem", F.lit(0.0)))
    return metrics.cqi4(rows).select("query_id", R6("m3"), R6("m4"), R6("m5"), R6("m6"), R6("cqi"), "zone")


@query("mmr_rerank")
def mmr_rerank(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = fused(spark, d).select("query_id", "doc_id", "score", "rank").join(v, "doc_id", "left").select("query_id", "doc_id", "score", "rank", "embedding")
    return selection.mmr(rows).select("query_id", "doc_id", R6("score"), "rank")


@query("submodular_pack")
def submodular_pack(spark, d):
    return selection.submodular_pack(_blocks(spark, d), 2000).select("query_id", "doc_id", "rank", "tokens")


@query("set_optimize")
def set_optimize(spark, d):
    return selection.set_optimize(_blocks(spark, d), 2000).select("query_id", "doc_id", "rank", "tokens")


def _spans(spark, d):
    """Candidates with a span of lines made from the document's id and size."""
    lo = (F.col("doc_id") % 50 + 1).cast("int")
    rows = candidates(spark, d).withColumns({"lo": lo, "hi": (lo + F.col("n_chars") / 100).cast("int"), "symbol_id": F.concat_ws(":", "file", (F.col("doc_id") % 7).cast("string")), "tokens": tx.tokens_by_length(F.col("text")), "content": F.col("text")})
    return rows.select("query_id", "doc_id", "score", "rank", "file", "granularity", "lo", "hi", "symbol_id", "tokens", "content")


@query("structural_dedup")
def structural_dedup(spark, d):
    return dedup.structural_dedup(_spans(spark, d)).select("query_id", "doc_id", "rank", "granularity")


@query("context_dedup")
def context_dedup(spark, d):
    return dedup.context_dedup(_spans(spark, d)).select("query_id", "doc_id", "rank")


@query("budget_allocate")
def budget_allocate(spark, d):
    return selection.budget_allocate(_spans(spark, d), 2000, 0.5).select("query_id", "doc_id", "rank", "tokens", "allocated")


@query("prefix_dedup", """select doc_id, n_chars, prefix from (select doc_id, n_chars, substr(text, 1, 100) as prefix, row_number() over (partition by substr(text, 1, 100) order by n_chars desc, doc_id) as pos from documents) where pos = 1""")
def prefix_dedup(spark, d):
    return dedup.prefix_dedup(table(spark, d, "documents"), "text", "n_chars", "doc_id").select("doc_id", "n_chars", F.substring("text", 1, 100).alias("prefix"))


@query("keep_last_dedup", """select doc_id, source, n_chars from (select *, row_number() over (partition by source order by doc_id desc) as pos from documents) where pos = 1""")
def keep_last_dedup(spark, d):
    return dedup.keep_last(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id").select("doc_id", "source", "n_chars")


_SHORT = f"with t as (select doc_id, unnest(list_distinct({TOKENS.format('text')})) as term from documents), n as (select doc_id, count(*) as n from t group by 1)"


# Documents with equal word sets are a class: its first document is linked with the others, and with those of other classes.
@query("near_dup_jaccard", _SHORT + """, w as (select doc_id, string_agg(term, ' ' order by term) as words from t group by 1), r as (select doc_id, min(doc_id) over (partition by words) as rep from w), u as (select t.* from t join r using (doc_id) where rep = doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from u a join u b on a.term = b.term and a.doc_id < b.doc_id group by 1, 2)
select a, b, round(c / (x.n + y.n - c), 6) as jaccard from p join n x on x.doc_id = a join n y on y.doc_id = b where round(c / (x.n + y.n - c), 9) >= 0.8 union all select rep, doc_id, 1.0 from r where rep <> doc_id""")
def near_dup_jaccard(spark, d):
    return dedup.near_pairs(table(spark, d, "documents"), 0.8).select("a", "b", R6("jaccard"))


@query("span_candidates_coalesced", with_corpus("""select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(coalesce(a.score, b.score), 6) as score, least(a.rank, b.rank) as rank from bm a full join tfr b on a.query_id = b.query_id and a.doc_id = b.doc_id"""))
def span_candidates_coalesced(spark, d):
    a, b = bm25(spark, d).select("query_id", "doc_id", "score", "rank"), tf(spark, d).select("query_id", "doc_id", "score", "rank")
    return fusion.coalesce_metadata(a, b, ["query_id", "doc_id"], ("rank", "_none")).select("query_id", "doc_id", R6("score"), "rank")


@query("doc_granularity", "select doc_id, case when n_chars < 1000 then 'fine' when n_chars < 3000 then 'medium' else 'coarse' end as granularity from documents")
def doc_granularity(spark, d):
    return doc_columns(spark, d).select("doc_id", "granularity")
