"""Interval, point-in-interval and as-of joins, and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 100) -> DataFrame:
    """Pairs of spans [lo, hi] and [lo2, hi2] (ends included) of equal keys that overlap.

    Spans are put in bins of `width`, and equal bins are joined; a pair is kept in the
    bin where the later of the two begins only, so no distinct is needed."""
    a = left.withColumn("_bin", _bins(F.col("lo"), F.col("hi"), width))
    b = right.withColumn("_bin", _bins(F.col("lo2"), F.col("hi2"), width))
    both = a.join(b, [*keys, "_bin"])
    first = F.floor(F.greatest("lo", "lo2") / width) == F.col("_bin")
    return both.filter(first & (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))).drop("_bin")


def innermost_span(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, span_id: str, width: int = 100) -> DataFrame:
    """Each point (at) with the shortest span [lo, hi] that holds it; ties by lo, then id."""
    s = spans.withColumn("_bin", _bins(F.col("lo"), F.col("hi"), width))
    p = points.withColumn("_bin", F.floor(F.col("at") / width).cast("long"))
    hit = p.join(s, [*keys, "_bin"]).filter((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi"))).drop("_bin")
    best = F.min_by(F.struct("lo", "hi", span_id), F.struct((F.col("hi") - F.col("lo")).alias("len"), "lo", span_id))
    return hit.groupBy(*keys, point_id, "at").agg(best.alias("b")).select(*keys, point_id, "at", "b.*")


def _slice(df: DataFrame, time: str, every: str) -> Column:
    """`every` of a time, or a thousand units of a number."""
    return F.date_trunc(every, time) if "timestamp" in dict(df.dtypes)[time] or dict(df.dtypes)[time] == "date" else F.floor(F.col(time) / 1000)


def _union(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: dict[str, Column], every: str) -> DataFrame:
    """Rows of left (_side 1, `columns` null) and right (_side 0), with the slice of time that they are in."""
    values = right.select(*[c.alias(n) for n, c in columns.items()]).schema
    a = left.select(*left.columns, F.lit(1).alias("_side"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in values])
    b = right.select(*[F.col(c) if c in (*keys, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), *[c.alias(n) for n, c in columns.items()])
    return a.union(b).withColumn("_slice", _slice(left, time, every))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tie: str, out: str, every: str = "day") -> DataFrame:
    """Each row of left with the value of the last row of right not after it, by keys: one
    sort of the union and a running last within each slice of time, and the last value of
    the slices before where a slice has none yet. No pairs, and no task for a whole key."""
    both = _union(left, right, keys, time, {"_v": F.col(value), "_tie": F.col(tie)}, every)
    own = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys, "_slice").orderBy(time, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0))
    ends = both.filter("_side = 0 and _v is not null").groupBy(*keys, "_slice").agg(F.max_by("_v", F.struct(time, "_tie")).alias("_end"))
    # One row for each slice of a key that is asked about or has a value.
    slices = both.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    carried = slices.withColumn("_carried", before).select(*keys, "_slice", "_carried")
    x = both.withColumn("_own", own).filter("_side = 1").join(carried, [*keys, "_slice"], "left")
    return x.select(*left.columns, F.coalesce("_own", "_carried").alias(out))


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, out: str, every: str = "day") -> DataFrame:
    """Each row of left with the value of the nearest row of right; the earlier of two as near.
    As asof_backward(), in both directions."""
    t = F.col(time)
    both = _union(left, right, keys, time, {"_r": F.struct(t.alias("t"), F.col(value).cast("bigint").alias("v"))}, every)
    within = W.partitionBy(*keys, "_slice")
    back, ahead = within.orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0), within.orderBy(F.desc(time), "_side").rowsBetween(W.unboundedPreceding, 0)
    ends = both.filter("_side = 0").groupBy(*keys, "_slice").agg(F.max_by("_r", "_r.t").alias("_last"), F.min_by("_r", "_r.t").alias("_first"))
    slices = both.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
    w = W.partitionBy(*keys)
    carried = slices.select(
        *keys, "_slice", F.last("_last", ignorenulls=True).over(w.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_cp"),
        F.last("_first", ignorenulls=True).over(w.orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)).alias("_cn"),
    )
    x = both.withColumn("_p", F.last("_r", ignorenulls=True).over(back)).withColumn("_n", F.last("_r", ignorenulls=True).over(ahead)).filter("_side = 1")
    x = x.join(carried, [*keys, "_slice"], "left").withColumn("_p", F.coalesce("_p", "_cp")).withColumn("_n", F.coalesce("_n", "_cn"))
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.t")) - F.unix_micros(t))
    nearest = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v")).when(gap("_n") < gap("_p"), F.col("_n.v")).otherwise(F.col("_p.v"))
    return x.select(*left.columns, nearest.alias(out))


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: starts tells (in terms of lag columns) where one begins."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(starts.cast("int"), F.lit(1))).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def span_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column, over: str = "smaller") -> Column:
    """Shared lines over the smaller or the larger span."""
    shared = F.greatest(F.lit(0), F.least(hi1, hi2) - F.greatest(lo1, lo2) + 1)
    a, b = hi1 - lo1 + 1, hi2 - lo2 + 1
    base = F.least(a, b) if over == "smaller" else F.greatest(a, b)
    return F.when(base <= 0, 0.0).otherwise(shared / base)


def line_windows(lines: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Windows of `size` lines that follow each other: number, first and last line, lines."""
    at = F.floor((F.col("line") - 1) / size).cast("int")
    return lines.groupBy(*keys, at.alias("window")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count("*").alias("n_lines"))
