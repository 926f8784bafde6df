"""Cut-offs, agreement and re-scoring of rankings (query_id, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def _q():
    return W.partitionBy("query_id")

# Factors of intent by granularity.
BOOST = {
    "EXPLAIN": {"fine": 1.0, "medium": 1.5, "coarse": 2.0},
    "IMPLEMENT": {"fine": 2.0, "medium": 1.2, "coarse": 0.8},
    "SEARCH": {"fine": 1.0, "medium": 1.2, "coarse": 1.5},
    "DEBUG": {"fine": 2.0, "medium": 1.0, "coarse": 0.8},
}


def knee_gate(ranked: DataFrame, min_k: int = 20, max_k: int = 150, relative: float = 0.35) -> DataFrame:
    """(query_id, n, keep): how many rows stand above the knee of the scores.

    The gaps between neighbours are averaged over three; the first row at or after
    min_k whose average gap over its score exceeds `relative` is the knee."""
    order = _q().orderBy("rank")
    gap = F.coalesce(F.col("score") - F.lead("score").over(order), F.lit(0.0))
    x = ranked.withColumn("gap", gap).withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(_q()))
    x = x.withColumn("mean", F.avg("gap").over(order.rowsBetween(-1, 1)))
    knee = (F.col("i") >= min_k) & (F.col("i") < F.least(F.col("n") - 1, F.lit(max_k))) & (F.col("score") > 0) & (F.col("mean") / F.col("score") > relative)
    by = x.groupBy("query_id").agg(F.max("n").alias("n"), F.min(F.when(knee, F.col("i"))).alias("knee"))
    limit = F.least(F.lit(max_k), F.col("n"))
    keep = F.when(F.col("n") <= min_k, F.col("n")).otherwise(F.greatest(F.lit(min_k), F.least(limit, F.coalesce("knee", "n"))))
    return by.select("query_id", "n", keep.alias("keep"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, n, spearman, disagreement): over documents in both lists, ranked anew
    among themselves; 1 - 6 sum(d^2) / (n (n^2 - 1)), 0 for fewer than two;
    disagreement is 1 - spearman, held to 0..1."""
    both = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"])
    both = both.withColumn("ra", F.row_number().over(_q().orderBy("ra"))).withColumn("rb", F.row_number().over(_q().orderBy("rb")))
    d = (F.col("ra") - F.col("rb")).cast("double")
    by = both.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(d * d).alias("d2"))
    rho = F.when(F.col("n") < 2, 0.0).otherwise(1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1)))
    return by.select("query_id", "n", rho.alias("spearman"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rho)).alias("disagreement"))


def kendall(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, n, kendall): concordant less discordant pairs over all pairs of common
    documents. The lists are short (top k), so the pairs of one query are too."""
    both = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"])
    listed = both.groupBy("query_id").agg(F.collect_list(F.struct("ra", "rb")).alias("p"))
    sign = lambda x, y: F.signum((x["ra"] - y["ra"]).cast("double") * (x["rb"] - y["rb"]))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.aggregate("p", F.lit(0.0), lambda t, y: t + sign(x, y)))
    n = F.size("p")
    return listed.select("query_id", n.alias("n"), F.when(n < 2, 0.0).otherwise(total / (n * (n - 1))).alias("kendall"))


def normalized_entropy(p: Column, n: Column) -> Column:
    """p: sum of -p ln p; over ln n, 0 for n < 2."""
    return F.when(n < 2, 0.0).otherwise(p / F.log(n))


def margin_entropy(ranked: DataFrame) -> DataFrame:
    """(query_id, margin, entropy): (first - second) / first, and the normalised entropy of the positive scores."""
    total = F.sum(F.when(F.col("score") > 0, F.col("score"))).over(_q())
    p = F.when(F.col("score") > 0, F.col("score") / total)
    x = ranked.withColumn("h", -p * F.log(p)).withColumn("pos", (F.col("score") > 0).cast("int"))
    by = x.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.sum("h").alias("h"), F.sum("pos").alias("n"))
    margin = F.when(F.col("s1").isNull() | (F.col("s1") <= 0) | F.col("s2").isNull(), 0.0).otherwise((F.col("s1") - F.col("s2")) / F.col("s1"))
    return by.select("query_id", margin.alias("margin"), normalized_entropy(F.coalesce("h", F.lit(0.0)), F.col("n")).alias("entropy"))


def granularity_boost(candidates: DataFrame, intent: Column | str, table: dict = BOOST) -> DataFrame:
    """score times the factor of intent and granularity (1 if there is none), ranked anew; ties keep their order."""
    intent = F.lit(intent) if isinstance(intent, str) else intent
    factor = F.lit(1.0)
    for name, levels in table.items():
        for level, x in levels.items():
            factor = F.when((intent == name) & (F.col("granularity") == level), x).otherwise(factor)
    out = candidates.withColumn("score", F.col("score") * factor).withColumnRenamed("rank", "old_rank")
    return out.withColumn("rank", F.row_number().over(_q().orderBy(F.round("score", 9).desc(), "old_rank")))


def granularity_mix(candidates: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows within their level's limit, marked taken; none is dropped."""
    at = F.row_number().over(W.partitionBy("query_id", "granularity").orderBy("rank"))
    most = F.lit(2**31 - 1)
    for level, n in limits.items():
        most = F.when(F.col("granularity") == level, n).otherwise(most)
    return candidates.withColumn("taken", at <= most)


def hierarchical_dedup(candidates: DataFrame, keep_best: bool = False) -> DataFrame:
    """Per query and file: coarse rows go where a fine one is, medium rows where two
    are. keep_best: the best medium and the best coarse row stay. Rows without a file stay."""
    file = W.partitionBy("query_id", "file")
    fine = F.sum((F.col("granularity") == "fine").cast("int")).over(file)
    first = F.row_number().over(W.partitionBy("query_id", "file", "granularity").orderBy("rank")) == 1
    gone = ((F.col("granularity") == "coarse") & (F.col("_fine") > 0)) | ((F.col("granularity") == "medium") & (F.col("_fine") >= 2))
    keep = F.col("file").isNull() | (F.col("file") == "") | ~gone
    if keep_best:
        keep = keep | F.col("_first")
    return candidates.withColumn("_fine", fine).withColumn("_first", first).filter(keep).drop("_fine", "_first")


def rank_churn(before: DataFrame, after: DataFrame, top_n: int = 10) -> DataFrame:
    """(query_id, changed, mean_shift, max_shift, top_n_stability): how ranks moved."""
    both = before.select("query_id", "doc_id", F.col("rank").alias("r0")).join(after.select("query_id", "doc_id", F.col("rank").alias("r1")), ["query_id", "doc_id"])
    shift = F.abs(F.col("r1") - F.col("r0"))
    top = (F.col("r0") <= top_n).cast("int")
    return both.groupBy("query_id").agg(
        F.avg((shift > 0).cast("double")).alias("changed"), F.avg(shift.cast("double")).alias("mean_shift"), F.max(shift).alias("max_shift"),
        (F.sum(top * (F.col("r1") <= top_n).cast("int")) / F.greatest(F.sum(top), F.lit(1))).alias("top_n_stability"),
    )
