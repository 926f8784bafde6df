"""Quality measures of ranked rows, blocks, runs and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

# Means and deviations that the context-quality index is measured against.
CQI_BASE = {"m4": (0.197, 0.180), "m3": (2.02, 0.59), "m5": (0.091, 0.049), "m6": (0.188, 0.094)}


def group_entropy(df: DataFrame, keys: list[str], item: str, normalized: bool = True, base: float | None = None) -> DataFrame:
    """keys, n, distinct, entropy: of the shares of `item` within keys; natural logarithm
    over ln(distinct) if normalized (0 for one item), else to `base`."""
    c = df.groupBy(*keys, item).agg(F.count("*").alias("c")) if keys else df.groupBy(item).agg(F.count("*").alias("c"))
    # Without keys the total is one row.
    t = c.groupBy(*keys).agg(F.sum("c").alias("t"))
    c = c.join(t, keys) if keys else c.join(F.broadcast(t))
    p = F.col("c") / F.col("t")
    by = c.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.sum(-p * F.log(p)).alias("h"))
    if base:
        e = F.col("h") / F.log(F.lit(base))
    elif normalized:
        e = F.when(F.col("distinct") < 2, 0.0).otherwise(F.col("h") / F.log("distinct"))
    else:
        e = F.col("h")
    return by.select(*keys, "n", "distinct", e.alias("entropy"))


def mean_pair_jaccard(blocks: DataFrame, key: str = "query_id", terms: str = "terms") -> DataFrame:
    """key, overlap: the mean Jaccard of all pairs of a key's term sets, pairs without terms
    left out. The sets of one key are a ranking's head, so their pairs are few."""
    listed = blocks.groupBy(key).agg(F.collect_list(terms).alias("s"))
    every = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.when(F.size(F.array_union(a, b)) > 0, tx.jaccard(a, b)))))
    valid = F.filter(every, lambda x: x.isNotNull())
    total = F.aggregate(valid, F.lit(0.0), lambda s, x: s + x)
    return listed.select(key, F.when(F.size(valid) == 0, 0.0).otherwise(total / F.size(valid)).alias("overlap"))


def coefficient_of_variation(score: str) -> Column:
    """Aggregate: population deviation over the mean's size, 0 for a mean of 0."""
    return F.when(F.abs(F.avg(score)) < 1e-12, 0.0).otherwise(F.stddev_pop(score) / F.abs(F.avg(score)))


def cqi4(ranked: DataFrame, terms: str = "terms", file: str = "file", final: str = "score", semantic: str = "semantic") -> DataFrame:
    """query_id, m3, m4, m5, m6, cqi, zone: context-quality index of the rows of each query."""
    m4 = mean_pair_jaccard(ranked, "query_id", terms).withColumnRenamed("overlap", "m4")
    m3 = group_entropy(ranked, ["query_id"], file, base=2.0).select("query_id", F.col("entropy").alias("m3"))
    rest = ranked.groupBy("query_id").agg((F.max(final) - F.min(final)).alias("m5"), F.avg(F.abs(F.col(final) - F.col(semantic))).alias("m6"))
    x = m4.join(m3, "query_id").join(rest, "query_id")
    z = {m: tx.z_score(F.col(m), F.lit(mean), F.lit(std)) for m, (mean, std) in CQI_BASE.items()}
    ci = 0.5682 * z["m4"] - 0.4318 * z["m3"]
    rci = 0.5626 * z["m5"] + 0.4374 * z["m6"]
    x = x.withColumn("cqi", tx.sigmoid(0.5 * ci + 0.5 * rci))
    zone = F.when(F.col("cqi") >= 0.65, "excellent").when(F.col("cqi") >= 0.5, "good").when(F.col("cqi") >= 0.35, "fair").otherwise("poor")
    return x.withColumn("zone", zone)


def histogram_stats(df: DataFrame, keys: list[str], value: str, slices: int = 512) -> DataFrame:
    """count, sum, mean, min, max and p50, p95, p99 by index floor(n * q), without interpolation.

    Equal values are counted first. The values of a key are cut into slices of one width; the
    counts of slices tell in which of them a percentile lies, and only those are put in
    order. So no task orders a whole key, however many values it has."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    whole = c.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))
    at = F.when(F.col("max") > F.col("min"), F.least(F.lit(slices - 1), F.floor((F.col("v") - F.col("min")) / (F.col("max") - F.col("min")) * slices))).otherwise(F.lit(0))
    placed = c.join(whole.select(*keys, "min", "max"), keys).withColumn("_s", at.cast("int")).select(*keys, "v", "c", "_s")
    w = W.partitionBy(*keys).orderBy("_s")
    sums = placed.groupBy(*keys, "_s").agg(F.sum("c").alias("_c")).withColumn("_before", F.sum("_c").over(w) - F.col("_c")).join(whole.select(*keys, "n"), keys)
    wanted = F.array(*[F.least(F.floor(F.col("n") * q), F.col("n") - 1) for q in (0.5, 0.95, 0.99)])
    hit = sums.select("*", F.posexplode(wanted).alias("_q", "_i")).filter((F.col("_before") <= F.col("_i")) & (F.col("_i") < F.col("_before") + F.col("_c")))
    near = placed.join(hit.select(*keys, "_s", "_q", "_i", "_before"), [*keys, "_s"])
    upto = F.sum("c").over(W.partitionBy(*keys, "_s", "_q").orderBy("v")) + F.col("_before")
    found = near.withColumn("_u", upto).filter(F.col("_u") > F.col("_i")).groupBy(*keys).agg(*[F.min(F.when(F.col("_q") == k, F.col("v"))).alias(p) for k, p in enumerate(("p50", "p95", "p99"))])
    return whole.join(found, keys).select(*keys, F.col("n").alias("count"), "sum", (F.col("sum") / F.col("n")).alias("mean"), "min", "max", "p50", "p95", "p99")


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, slice_: Column) -> DataFrame:
    """df with the number (from 0) of each row within keys by order. slice_ must not fall along
    the order: rows are numbered within a slice, and slices by the sum of those before."""
    x = df.withColumn("_slice", slice_)
    n = x.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_slice")) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    return x.withColumn(name, own).join(n, [*keys, "_slice"]).withColumn(name, F.col(name) + F.col("_before")).drop("_slice", "_before")


def sliding_percentile(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 500, name: str = "percentile", slice_: Column | None = None, chunk: int = 10000) -> DataFrame:
    """The share of the last `size` earlier values below each value; 0.5 where there is none.

    The rows of a key are numbered by slices of the order (by default days of its first
    column) and cut into chunks; the last `size` rows of each go to the next one too. So a
    task holds one chunk, however long a key is."""
    slice_ = F.date_trunc("day", order[0]) if slice_ is None else slice_
    x = row_numbers(df, keys, order, "_row", slice_)
    at = F.floor(F.col("_row") / chunk)
    both = F.when(F.col("_row") % chunk >= max(0, chunk - size), F.array(at, at + 1)).otherwise(F.array(at))
    x = x.withColumn("_chunk", F.explode(both)).withColumn("_own", F.floor(F.col("_row") / chunk) == F.col("_chunk"))
    x = x.withColumn("_values", F.collect_list(value).over(W.partitionBy(*keys, "_chunk").orderBy("_row").rowsBetween(-size, -1))).filter("_own")
    below = F.size(F.filter("_values", lambda y: y < F.col(value)))
    return x.withColumn(name, F.when(F.size("_values") == 0, 0.5).otherwise(below / F.size("_values"))).drop("_values", "_own", "_chunk", "_row")


def size_profile(df: DataFrame, level: str, size: str) -> DataFrame:
    """Count, least, most, mean and median of `size` by level and (level null) over all."""
    return df.rollup(level).agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean"), F.percentile(size, 0.5).alias("median"))


def concentration(ranked: DataFrame, file: str = "file", k: int = 10) -> DataFrame:
    """query_id, files, top_share, entropy_k: how the first k rows spread over files."""
    c = ranked.filter(F.col("rank") <= k).groupBy("query_id", file).agg(F.count("*").alias("c"))
    c = c.withColumn("n", F.sum("c").over(W.partitionBy("query_id")))
    p = F.col("c") / F.col("n")
    return c.groupBy("query_id").agg(F.count("*").alias("files"), F.max(p).alias("top_share"), (F.sum(-p * F.log(p)) / F.log(F.lit(float(k)))).alias("entropy_k"))
