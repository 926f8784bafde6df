"""Evaluation runs: verdicts, stability, comparison and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of equal counts the first of these wins.
VERDICTS = ("improved", "equal", "regressed")


def verdict(candidate: Column, baseline: Column, margin: float = 0.0) -> Column:
    return F.when(candidate.isNull() | baseline.isNull(), "error").when(candidate > baseline + margin, "improved").when(candidate < baseline - margin, "regressed").otherwise("equal")


def majority_verdict(results: DataFrame, key: str = "query_id") -> DataFrame:
    """key, n_runs, verdict, stability: the most frequent verdict and its share."""
    by = results.groupBy(key).agg(F.count("*").alias("n_runs"), *[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in VERDICTS])
    most = F.greatest(*VERDICTS)
    pick = F.lit(None).cast("string")
    for v in reversed(VERDICTS):
        pick = F.when(F.col(v) == most, v).otherwise(pick)
    return by.select(key, "n_runs", *VERDICTS, pick.alias("verdict"), (most / F.col("n_runs")).alias("stability"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, each metric of both runs and its difference b - a, for keys in both."""
    left = a.select(key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return left.join(right, key).select(key, *[c for m in metrics for c in (F.col(f"{m}_a"), F.col(f"{m}_b"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta"))])


def long_rollup(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """metric, value, kind: totals and means of numeric columns, counts of the values of categorical ones."""
    nums = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in numeric]))
    totals = df.select(nums.alias("m")).select("m.*").filter("x is not null").groupBy("metric").agg(F.sum("x").alias("total"), F.avg("x").alias("mean"))
    long = totals.select("metric", F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.col("total").alias("value")), F.struct(F.lit("mean").alias("kind"), F.col("mean").alias("value")))).alias("v")).select("metric", "v.kind", "v.value")
    cats = F.explode(F.array(*[F.concat_ws(":", F.lit(c), F.col(c).cast("string")) for c in categorical]))
    counts = df.select(cats.alias("metric")).groupBy("metric").agg(F.count("*").cast("double").alias("value")).select("metric", F.lit("count").alias("kind"), "value")
    return long.union(counts)


def normalized_variance(value: Column) -> Column:
    """Aggregate: v / (1 + v) of the population variance, 0 for fewer than two."""
    v = F.var_pop(value)
    return F.when(F.count(value) < 2, 0.0).otherwise(v / (1 + v))


def chunk_overlap_instability(runs: DataFrame, key: str, items: str) -> DataFrame:
    """key, instability: 1 less the mean Jaccard of all pairs of a key's runs."""
    from .metrics import mean_pair_jaccard

    return mean_pair_jaccard(runs, key, items).select(key, (1 - F.col("overlap")).alias("instability"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: new, deleted, changed or unchanged, by a full outer join of snapshots."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))
