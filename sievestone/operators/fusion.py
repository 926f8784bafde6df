"""Fusion of two rankings of the same queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lexical import top_k


def rrf(a: DataFrame, b: DataFrame, k: int = 10, keep: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, provenance, rank): the sum of 1 / (k + rank) over both
    lists. A document that a list holds twice counts twice."""
    both = a.select("query_id", "doc_id", "rank", F.lit("a").alias("src")).union(b.select("query_id", "doc_id", "rank", F.lit("b").alias("src")))
    score = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("src")).alias("provenance"))
    return top_k(score, keep if keep else 2**31 - 1)


def linear(a: DataFrame, b: DataFrame, weight_a: float = 0.5, weight_b: float = 0.5, keep: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): each score over its list's maximum (0 counts as 1), weighted."""

    def scaled(x: DataFrame, weight: float) -> DataFrame:
        most = F.max("score").over(W.partitionBy("query_id"))
        return x.select("query_id", "doc_id", (weight * F.col("score") / F.when(most == 0, 1.0).otherwise(most)).alias("part"))

    score = scaled(a, weight_a).union(scaled(b, weight_b)).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return top_k(score, keep if keep else 2**31 - 1)


def keep_best(frames: list[DataFrame]) -> DataFrame:
    """(query_id, doc_id, score): of several result sets the best score of each document."""
    out = frames[0].select("query_id", "doc_id", "score")
    for f in frames[1:]:
        out = out.union(f.select("query_id", "doc_id", "score"))
    return out.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def coalesce_metadata(a: DataFrame, b: DataFrame, keys: list[str], spans: tuple[str, str] | None = None) -> DataFrame:
    """Full outer join of two candidate tables: the first's columns where they are set,
    else the second's; a span is the union of both."""
    right = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])
    on = [a[k] == right[f"_{k}"] for k in keys]
    both = a.join(right, on, "full_outer")
    out = []
    for c in a.columns:
        if spans and c == spans[0]:
            out.append(F.least(c, f"_{c}").alias(c))
        elif spans and c == spans[1]:
            out.append(F.greatest(c, f"_{c}").alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in b.columns else F.col(c))
    return both.select(*out)
