"""Quality classification by importance resampling.

Two generative bag-of-n-grams models over hashed words and word pairs are learned: one
of the target (labelled good) texts and one of all raw text. The ratio of a document's
probabilities under the two is its importance weight; Gumbel noise makes the top k of
the noisy log weights a sample without replacement that leans to the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import _U64, combine, slices, small_batches, stage, text_buffer, word_hashes, word_spans

BUCKET_BITS = 18
_SLICE_BYTES = 1 << 21


@dataclass(frozen=True)
class ImportanceModel:
    """log_ratio: for each bucket, log of its target over its raw probability."""

    log_ratio: np.ndarray


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text, and where each text's begin."""
    starts, ends, first = word_spans(buf, offsets)
    words = word_hashes(buf, starts, ends)
    n = len(words)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][first[:-1] < n]] = _U64(0)
    both = np.empty(2 * n, _U64)
    both[0::2], both[1::2] = words, combine(before, words)
    return (both >> _U64(64 - BUCKET_BITS)).astype(np.int64), 2 * first


def _count(once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            for i, j in slices(offs, _SLICE_BYTES):
                at, first = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if once:
                    doc = np.repeat(np.arange(j - i), np.diff(first))
                    at = np.unique((doc << BUCKET_BITS) | at) & (len(total) - 1)
                total += np.bincount(at, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    return run


def count_buckets(docs: DataFrame, text_col: str = "text", counts: str = "occurrences") -> np.ndarray:
    """For each bucket how often its n-grams occur, or (counts="documents") the texts
    that hold one. A fixed number of counts reaches the driver."""
    got = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).mapInArrow(_count(counts == "documents"), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def train(target: np.ndarray, raw: np.ndarray, prior: float = 1.0, sure: float = 0.0) -> ImportanceModel:
    """The log ratio of two generative models of n-grams, each smoothed by `prior` of
    the raw model's counts: log (target + prior) / (expected + prior), where expected is
    what the raw model makes of as many n-grams as the target has.

    sure > 0: the value nearest 0 that is within so many standard errors, about the
    median ratio of frequent buckets, so that only what the counts prove is weighed."""
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    if not sure:
        return ImportanceModel(np.log((target + prior) / (expected + prior)).astype(np.float32))
    frequent = expected >= 30
    if frequent.any():
        expected = expected * max(float(np.median(target[frequent] / expected[frequent])), 1e-3)
    ratio = np.log((target + prior) / (expected + prior))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - sure / np.sqrt(expected + prior), 0)
    return ImportanceModel(ratio.astype(np.float32))


def weigh(docs: DataFrame, model: ImportanceModel, text_col: str = "text", power: float = 0.0) -> DataFrame:
    """docs without the text, with n_features and score: the sum of the log ratios of
    the text's n-grams, the log of its importance weight (0 for a text without words).
    power: the sum is divided by n_features to this power; with 1 / 2 the noise of a
    long text weighs no more than that of a short one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "n_features", text_col)]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("n_features", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value.log_ratio
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            n, score = [], []
            for i, j in slices(offs, _SLICE_BYTES):
                at, first = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                size = np.diff(first)
                total = np.zeros(j - i)
                if len(at):
                    some = np.flatnonzero(size)
                    total[some] = np.add.reduceat(ratio[at].astype(np.float64), first[some]) / size[some] ** power
                n.append(size)
                score.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(np.concatenate(score) if score else [], pa.float64())], [*kept, "n_features", "score"])

    return rows.mapInArrow(run, schema)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, few: int = 4096) -> float | None:
    """The k-th largest value of a column of doubles, by histograms that close in on
    it: no more than `bins` counts or `few` values are brought to the driver at once.
    None if there are fewer than k rows; k counts from 1."""
    values = df.select(F.col(column).alias("v")).filter("v is not null and not isnan(v)")
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    while n > few and lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            break
        at = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("at")
        inside = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        for bin_, size, low, high in sorted(inside.groupBy(at).agg(F.count("*"), F.min("v"), F.max("v")).collect(), reverse=True):
            if k <= size:
                lo, hi, n = low, high, size
                break
            k -= size
    if lo == hi:
        return lo
    rows = values.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").count().orderBy(F.desc("v"))
    seen = 0
    for v, size in rows.toLocalIterator():
        seen += size
        if seen >= k:
            return v
    return None


#: What the query over the provided tables uses: see the README for what each is good for.
SHARPENED = {"counts": "documents", "sure": 4.0, "power": 0.5, "temperature": 0.02}


def gumbel_key(score, row_id, temperature: float, seed: int):
    """score / temperature plus Gumbel noise that is fixed by seed and id."""
    u = (F.pmod(F.xxhash64(row_id, F.lit(seed + 2)), F.lit(2**52)) + 0.5) / float(2**52)
    return score / temperature - F.log(-F.log(u))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, max_labelled: int = 20000, good_kept: float = 0.995, temperature: float = 1.0, seed: int = 3, counts: str = "occurrences", prior: float = 1.0, sure: float = 0.0, power: float = 0.0) -> DataFrame:
    """All rows and columns of docs but the text, with n_features, score (the log
    importance weight: target over raw probability of the text's n-grams), sample_key
    (score / temperature and Gumbel noise, fixed by seed and id) and kept: whether
    the row is among the k largest keys, a sample without replacement by weight.

    labels: id_col, quality, toxic; of quality 1 and not toxic is the target, all else
    bad (of several labels of a document the worst counts). At most max_labelled
    labelled documents are used. With k given all of them learn. Without k half of them
    learn; the other half find the key that a share good_kept of good ones reach, and k
    is the number of documents that reach it.

    counts, prior, sure: see count_buckets() and train(); power: see weigh(). Without
    good labels, and with no k, all is kept. Rows of equal key (repeated rows) are kept
    or dropped together. A null id shares one noise. Null and empty texts have score 0.
    Columns of docs with the names of results are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = F.xxhash64("_id", F.lit(seed))
    half = F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(2)) == 0
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"))
    marks = stage(marks.withColumn("learn", F.lit(True) if k is not None else half).orderBy(order, "_id").limit(max_labelled), "labelled")
    target = docs.join(F.broadcast(marks.filter("good and learn").select(F.col("_id").alias(id_col))), id_col, "left_semi")
    model = train(count_buckets(target, text_col, counts), count_buckets(docs, text_col, counts), prior, sure)
    scored = stage(weigh(docs, model, text_col, power), "scored")
    out = scored.withColumn("sample_key", gumbel_key(F.col("score"), F.col(f"`{id_col}`"), temperature, seed))
    if k is None:
        judged = out.select(F.col(f"`{id_col}`").alias("_id"), "sample_key").join(F.broadcast(marks.filter("good and not learn")), "_id").groupBy("_id").agg(F.min("sample_key").alias("key")).collect()
        cut = float(np.quantile([r.key for r in judged], 1 - good_kept)) if judged else -np.inf
        k = out.filter(F.col("sample_key") >= F.lit(float(cut))).count()
    least = kth_largest(out, "sample_key", k)
    return out.withColumn("kept", F.col("sample_key") >= F.lit(least) if least is not None else F.lit(k > 0))
