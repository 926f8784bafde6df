"""Evaluation queries: judges, runs, roll-ups, series and signals."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics, runs
from ._base import TOKENS, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R6 = lambda c: F.round(c, 6).alias(c)
_JUDGED = "judged as (select doc_id % 50 as query_id, doc_id, case when quality > 1 - toxic then 'improved' when quality < 1 - toxic then 'regressed' else 'equal' end as verdict, quality, toxic from labels)"


def _judged(spark, d):
    return table(spark, d, "labels").select((F.col("doc_id") % 50).alias("query_id"), "doc_id", runs.verdict(F.col("quality"), 1 - F.col("toxic")).alias("verdict"), "quality", "toxic")


@query("judge_aggregate", f"with {_JUDGED} select verdict, count(*) as n, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from judged group by 1")
def judge_aggregate(spark, d):
    return _judged(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("majority_verdict", f"""with {_JUDGED}, c as (select query_id, count(*) as n_runs, sum(case when verdict = 'improved' then 1 else 0 end)::bigint as improved, sum(case when verdict = 'equal' then 1 else 0 end)::bigint as equal, sum(case when verdict = 'regressed' then 1 else 0 end)::bigint as regressed from judged group by 1)
select query_id, n_runs, improved, equal, regressed, case greatest(improved, equal, regressed) when improved then 'improved' when equal then 'equal' else 'regressed' end as verdict, round(greatest(improved, equal, regressed) / n_runs, 6) as stability from c""")
def majority_verdict(spark, d):
    return runs.majority_verdict(_judged(spark, d)).withColumn("stability", F.round("stability", 6))


@query("win_rate", f"with {_JUDGED} select sum(case when verdict = 'improved' then 1 else 0 end)::bigint as wins, sum(case when verdict = 'regressed' then 1 else 0 end)::bigint as losses, round(sum(case when verdict = 'improved' then 1 else 0 end) / greatest(sum(case when verdict <> 'equal' then 1 else 0 end), 1), 6) as win_rate from judged")
def win_rate(spark, d):
    one = lambda c: F.sum(c.cast("long"))
    v = F.col("verdict")
    return _judged(spark, d).agg(one(v == "improved").alias("wins"), one(v == "regressed").alias("losses"), F.round(one(v == "improved") / F.greatest(one(v != "equal"), F.lit(1)), 6).alias("win_rate"))


@query("compare_runs_delta", """with a as (select source, avg(n_chars) as size, count(*) as n from documents join labels using (doc_id) where quality = 1 group by 1), b as (select source, avg(n_chars) as size, count(*) as n from documents join labels using (doc_id) where quality = 0 group by 1)
select source, round(a.size, 6) as size_a, round(b.size, 6) as size_b, round(b.size - a.size, 6) as size_delta, a.n as n_a, b.n as n_b, b.n - a.n as n_delta from a join b using (source)""")
def compare_runs_delta(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    run = lambda q: x.filter(F.col("quality") == q).groupBy("source").agg(F.avg("n_chars").alias("size"), F.count("*").alias("n"))
    return runs.compare_runs(run(1), run(0), "source", ["size", "n"]).select("source", R6("size_a"), R6("size_b"), R6("size_delta"), "n_a", "n_b", "n_delta")


@query("harness_rollup", """with e as (select value, cast(json_extract_string(props, '$.k') as double) as k, event_type from events),
n as (select 'value' as metric, value as x from e union all select 'k', k from e), t as (select metric, sum(x) as total, avg(x) as mean from n where x is not null group by 1)
select metric, 'total' as kind, round(total, 4) as value from t union all select metric, 'mean', round(mean, 4) from t union all select 'event_type:' || event_type, 'count', cast(count(*) as double) from e group by event_type""")
def harness_rollup(spark, d):
    e = table(spark, d, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type")
    return runs.long_rollup(e, ["value", "k"], ["event_type"]).withColumn("value", F.round("value", 4))


@query("hist_stats_p50_p95_p99", """with s as (select event_type, list_sort(list(value)) as v, count(*) as n, sum(value) as total from events where value is not null group by 1)
select event_type, n as count, round(total, 4) as sum, round(total / n, 6) as mean, v[1] as min, v[-1] as max, v[cast(least(floor(n * 0.5), n - 1) as bigint) + 1] as p50, v[cast(least(floor(n * 0.95), n - 1) as bigint) + 1] as p95, v[cast(least(floor(n * 0.99), n - 1) as bigint) + 1] as p99 from s""")
def hist_stats(spark, d):
    x = metrics.histogram_stats(table(spark, d, "events"), ["event_type"], "value")
    return x.select("event_type", "count", F.round("sum", 4).alias("sum"), R6("mean"), "min", "max", "p50", "p95", "p99")


@query("sliding_percentile_500", """select event_id, event_type, round(case when count(*) over w = 0 then 0.5 else (select count(*) from (select unnest(list(value) over w) as u)) / 1.0 end, 6) as percentile from events window w as (partition by event_type order by ts, event_id rows between 500 preceding and 1 preceding)""".replace("(select count(*) from (select unnest(list(value) over w) as u)) / 1.0", "len(list_filter(list(value) over w, lambda u: u < value)) / (count(*) over w)"))
def sliding_percentile_500(spark, d):
    x = metrics.sliding_percentile(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")
    return x.select("event_id", "event_type", R6("percentile"))


@query("score_separation", "select event_type, round(stddev_pop(value) / abs(avg(value)), 6) as cv, round(var_pop(value) / (1 + var_pop(value)), 6) as norm_variance from events group by 1")
def score_separation(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(metrics.coefficient_of_variation("value"), 6).alias("cv"), F.round(runs.normalized_variance(F.col("value")), 6).alias("norm_variance"))


_ANSWERS = f"ans as (select conv_id, turn, list_distinct({TOKENS.format('text')}) as t, length(text) as n from conversations where role = 'assistant')"


@query("instability_signals", f"""with {_ANSWERS}, p as (select a.conv_id, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) as j from ans a join ans b on a.conv_id = b.conv_id and a.turn < b.turn where len(list_concat(a.t, b.t)) > 0),
m as (select conv_id, avg(j) as j from p group by 1), s as (select conv_id, count(*) as n_runs, var_pop(n) as v from ans group by 1)
select conv_id, n_runs, round(1 - coalesce(j, 0), 6) as overlap_instability, round(case when n_runs < 2 then 0 else v / (1 + v) end, 6) as length_variance, case when n_runs < 2 then 'UNSTABLE_CONTEXT' when 1 - coalesce(j, 0) > 0.5 then 'UNSTABLE_CONTEXT' else 'STABLE' end as label from s left join m using (conv_id)""")
def instability_signals(spark, d):
    a = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.array_distinct(tx.tokens(F.col("text"))).alias("t"), F.length("text").alias("n"))
    o = runs.chunk_overlap_instability(a, "conv_id", "t").withColumnRenamed("instability", "overlap_instability")
    s = a.groupBy("conv_id").agg(F.count("*").alias("n_runs"), runs.normalized_variance(F.col("n")).alias("length_variance"))
    x = s.join(o, "conv_id")
    label = F.when((F.col("n_runs") < 2) | (F.col("overlap_instability") > 0.5), "UNSTABLE_CONTEXT").otherwise("STABLE")
    return x.select("conv_id", "n_runs", R6("overlap_instability"), R6("length_variance"), label.alias("label"))


@query("hallucination_anti", f"""with {_ANSWERS}, w as (select conv_id, turn, unnest(t) as term from ans), known as (select distinct unnest({TOKENS.format('text')}) as term from documents)
select conv_id, turn, term from w where term not in (select term from known)""")
def hallucination_anti(spark, d):
    said = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    known = table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return said.join(known, "term", "left_anti").select("conv_id", "turn", "term")


@query("stratified_sample", """select doc_id, lang, bucket from (select doc_id, lang, case when n_chars < 1000 then 'fine' when n_chars < 3000 then 'medium' else 'coarse' end as bucket, row_number() over (partition by lang, case when n_chars < 1000 then 'fine' when n_chars < 3000 then 'medium' else 'coarse' end order by sha256(cast(doc_id as varchar)), doc_id) as r from documents) where r <= 5""")
def stratified_sample(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", tx.granularity(F.col("n_chars")).alias("bucket"))
    w = W.partitionBy("lang", "bucket").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    return x.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("doc_id", "lang", "bucket")


@query("pearson_length_bias", "select lang, count(*) as n, round(case when stddev_pop(quality) = 0 or stddev_pop(n_chars) = 0 then 0 else covar_pop(n_chars, quality) / (stddev_pop(quality) * stddev_pop(n_chars)) end, 6) as pearson from documents join labels using (doc_id) group by 1")
def pearson_length_bias(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.round(tx.safe_divide(F.covar_pop("n_chars", "quality"), F.stddev_pop("n_chars") * F.stddev_pop("quality")), 6).alias("pearson"))


@query("retrieval_frequency", "with c as (select user_id, count(*) as hits from events where event_type = 'view' group by 1) select u.user_id, coalesce(hits, 0)::bigint as hits, coalesce(hits, 0) = 0 as never from (select distinct user_id from events) u left join c using (user_id)")
def retrieval_frequency(spark, d):
    e = table(spark, d, "events")
    hits = F.count(F.when(F.col("event_type") == "view", 1))
    return e.groupBy("user_id").agg(hits.alias("hits"), (hits == 0).alias("never"))


@query("token_concentration", "with c as (select source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) select source, round(sum(case when r <= 5 then n_chars else 0 end) / sum(n_chars), 6) as top5_share from c group by 1")
def token_concentration(spark, d):
    # Five of each of 64 parts of a source first, so that no task orders a whole source.
    docs = table(spark, d, "documents").select("source", "n_chars", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"))
    w = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("n_chars"), "doc_id")
    top = docs.withColumn("r", F.row_number().over(w("source", "part"))).filter("r <= 5").withColumn("r", F.row_number().over(w("source"))).filter("r <= 5")
    share = top.groupBy("source").agg(F.sum("n_chars").alias("top")).join(docs.groupBy("source").agg(F.sum("n_chars").alias("total")), "source")
    return share.select("source", F.round(F.col("top") / F.col("total"), 6).alias("top5_share"))


@query("percentile_interpolated", "select event_type, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.5), 6) as p50 from events group by 1")
def percentile_interpolated(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.9), 6).alias("p90"), F.round(F.percentile("value", 0.5), 6).alias("p50"))


@query("score_labels", "select doc_id, round(least(10, greatest(0, (1 + 4 * quality - 1) * 2.5)), 6) as ten, case when toxic = 0 then 0.0 else round(quality / toxic, 6) end as ratio from labels")
def score_labels(spark, d):
    return table(spark, d, "labels").select("doc_id", F.round(tx.score_to_ten(1.0 + 4.0 * F.col("quality")), 6).alias("ten"), F.round(tx.safe_divide(F.col("quality"), F.col("toxic")), 6).alias("ratio"))


@query("metadata_variance", "with x as (select source, count(distinct lang) as n_lang, count(*) as n from documents group by 1) select round(var_pop(n_lang) / (1 + var_pop(n_lang)), 6) as lang_variance, round(var_pop(n) / (1 + var_pop(n)), 6) as size_variance from x")
def metadata_variance(spark, d):
    x = table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_lang"), F.count("*").alias("n"))
    return x.agg(F.round(runs.normalized_variance(F.col("n_lang")), 6).alias("lang_variance"), F.round(runs.normalized_variance(F.col("n")), 6).alias("size_variance"))


@query("failure_frequency", "select user_id, count(*) as n, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6) as failure from events group by 1")
def failure_frequency(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("failure"))


@query("stream_metrics")
def stream_metrics(spark, d):
    from ..streaming.metrics import windowed_metrics

    return windowed_metrics(spark, f"{d}/events.parquet")
