"""Feature scores and the set-at-a-time steps of context packing. Rows: query_id, doc_id, rank, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _q():
    return W.partitionBy("query_id")


def max_normalized(rows: DataFrame, column: str, out: str) -> DataFrame:
    """column over its largest value of the query; 0 where that is 0 or null."""
    most = F.max(column).over(_q())
    return rows.withColumn(out, F.coalesce(F.when(most > 0, F.col(column) / most), F.lit(0.0)))


def name_match(query_terms: Column, name_terms: Column) -> Column:
    """Shared terms over the larger of the two sets; 0 if either is empty."""
    a, b = F.size(F.array_distinct(query_terms)), F.size(F.array_distinct(name_terms))
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.size(F.array_intersect(query_terms, name_terms)) / F.greatest(a, b))


def base_score(lexical: Column, semantic: Column, name: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    return weights[0] * lexical + weights[1] * semantic + weights[2] * name


def struct_bonus(entry: Column, decorated: Column, graph: Column, most: float = 0.2) -> Column:
    """0.1 for an entry point, 0.05 for a decorator, 0.05 by graph distance, capped."""
    return F.least(F.lit(most), 0.1 * entry.cast("double") + 0.05 * decorated.cast("double") + 0.05 * graph)


def final_score(base: Column, rerank: Column, struct: Column, weights: tuple[float, float, float] = (0.5, 0.4, 0.1)) -> Column:
    """Rows that were not reranked have a rerank score of 0."""
    return weights[0] * base + weights[1] * F.coalesce(rerank, F.lit(0.0)) + weights[2] * struct


def budget_guard(rows: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """Rows trimmed from the tail until the sum of tokens fits."""
    return rows.withColumn("used", F.sum(tokens).over(_q().orderBy("rank").rowsBetween(W.unboundedPreceding, 0))).filter(F.col("used") <= budget)


def filter_with_floor(rows: DataFrame, keep: Column, floor: int) -> DataFrame:
    """Rows for which keep holds; all rows of a query that would keep fewer than `floor`."""
    kept = F.sum(keep.cast("long")).over(_q())
    return rows.withColumn("_keep", keep).withColumn("_n", kept).filter(F.col("_keep") | (F.col("_n") < floor)).drop("_keep", "_n")


def backfill(chosen: DataFrame, ranked: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """chosen with the next rows of the ranking that fit what is left of the budget, as long as
    they follow each other; the first that doesn't fit ends it."""
    used = chosen.groupBy("query_id").agg(F.sum(tokens).alias("_used"))
    rest = ranked.join(chosen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(used, "query_id", "left")
    upto = F.sum(tokens).over(_q().orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    more = rest.withColumn("_upto", upto).filter(F.col("_upto") + F.coalesce("_used", F.lit(0)) <= budget)
    return chosen.select("query_id", "doc_id", "rank", tokens, F.lit(False).alias("added")).union(more.select("query_id", "doc_id", "rank", tokens, F.lit(True)))


def tail_density_ratio(rows: DataFrame, density: str, tail: int = 3, epsilon: float = 1e-9) -> DataFrame:
    """(query_id, ratio): the mean density of the last rows over that of the first."""
    n = F.count("*").over(_q())
    x = rows.withColumn("_n", n)
    first, last = F.avg(F.when(F.col("rank") <= tail, F.col(density))), F.avg(F.when(F.col("rank") > F.col("_n") - tail, F.col(density)))
    return x.groupBy("query_id").agg((last / F.greatest(first, F.lit(epsilon))).alias("ratio"))


def relevance_gate(rows: DataFrame, similarity: str, top: int = 5, threshold: float = 0.25) -> DataFrame:
    """(query_id, best, triggered): whether none of the first rows is similar enough."""
    by = rows.filter(F.col("rank") <= top).groupBy("query_id").agg(F.max(similarity).alias("best"))
    return by.withColumn("triggered", F.col("best") < threshold)


def count_reorders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, reorders): how often, down the new ranking, the old rank falls."""
    both = after.select("query_id", "doc_id", F.col("rank").alias("r1")).join(before.select("query_id", "doc_id", F.col("rank").alias("r0")), ["query_id", "doc_id"])
    falls = F.lag("r0").over(_q().orderBy("r1")) > F.col("r0")
    return both.withColumn("_f", F.coalesce(falls.cast("long"), F.lit(0))).groupBy("query_id").agg(F.sum("_f").alias("reorders"))


def elimination_ledger(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, doc_id, eliminated_at): of the first stage's rows the first later stage that
    lacks them, `kept` if none does."""
    out = stages[0][1].select("query_id", "doc_id").distinct()
    for name, rows in stages[1:]:
        out = out.join(rows.select("query_id", "doc_id", F.lit(True).alias(name)).distinct(), ["query_id", "doc_id"], "left")
    at = F.coalesce(*[F.when(F.col(name).isNull(), F.lit(name)) for name, _ in stages[1:]], F.lit("kept"))
    return out.select("query_id", "doc_id", at.alias("eliminated_at"))


def file_target(rows: DataFrame, query_terms: str, path_terms: str, margin: float = 0.1) -> DataFrame:
    """(query_id, file, score, ambiguous): the file with the largest sum of scores and 0.2 for
    each term of the query in its path; ambiguous if the next is less than `margin` behind."""
    by = rows.groupBy("query_id", "file").agg(F.sum("score").alias("s"), F.first(query_terms).alias("_q"), F.first(path_terms).alias("_p"))
    by = by.select("query_id", "file", (F.col("s") + 0.2 * F.size(F.array_intersect("_q", "_p"))).alias("score"))
    w = _q().orderBy(F.round("score", 9).desc(), "file")
    x = by.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).filter("_r = 1")
    return x.select("query_id", "file", "score", (F.coalesce(F.col("score") - F.col("_next"), F.lit(float("inf"))) < margin).alias("ambiguous"))
