"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Runs of a few dozen byte n-grams have a
likelihood under each language's n-gram model; expectation-maximisation finds
the proportions of the languages in the document, and a penalised likelihood
chooses how many of them it really has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import _LOWER, fresh, learned_fold, slices, small_batches, text_buffer

BUCKET_BITS = 16
RUN_BYTES = 24
EM_STEPS = 12
UNKNOWN = "und"
_SLICE_BYTES = 1 << 20
#: Runs whose n-grams are looked up at once: 400 KB of text, whatever a text's length.
_RUNS = 1 << 14

# Digits, punctuation and white space of ASCII say nothing of the language: all count as a space.
_FOLD = np.where((np.arange(256) < 128) & ~(((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122)), 32, _LOWER).astype(np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """langs: the learned values, sorted; log_p: for each bucket, a row of each language's log probability."""

    langs: list[str]
    log_p: np.ndarray


def _buckets(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hashed 4-gram that ends at each byte; before a text there are spaces."""
    b = _FOLD[buf]
    code = b.copy()
    for k in range(1, 4):
        before = np.empty_like(b)
        before[k:] = b[:-k]
        before[:k] = 32
        for j in range(k):
            at = offsets[:-1] + j
            before[at[at < offsets[1:]]] = 32
        code = code + before * np.uint32((1, 257, 65_599, 16_785_407)[k])
    code = code * np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - BUCKET_BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        buf, offs = text_buffer(batch.column(0))
        langs = batch.column(1).to_pylist()
        for i, lang in enumerate(langs):
            part = buf[offs[i] : offs[i + 1]]
            if len(part):
                n = found.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                n += np.bincount(_buckets(part, np.array([0, len(part)])), minlength=len(n))
            else:
                found.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
    for lang, n in found.items():
        at = np.flatnonzero(n)
        at = at if len(at) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """A model from all rows of docs with text and language. Rows with a null of
    either are left out. What comes to the driver is one count for each language
    and bucket (65,536 of them), whatever the size of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")).dropna()
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    n = np.zeros((1 << BUCKET_BITS, len(langs)))
    if langs:
        at = np.searchsorted(np.array(langs, object), np.array(counts["lang"].to_pylist(), object))
        np.add.at(n, (counts["bucket"].to_numpy(), at), counts["n"].to_numpy())
    p = (n + smoothing) / (n.sum(0) + smoothing * len(n))
    return LanguageModel(langs, np.log(p).astype(np.float32))


def infer(model: LanguageModel, buf: np.ndarray, offsets: np.ndarray, penalty: float = 1.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: proportions (texts x languages) by expectation-maximisation
    over runs of n-grams; the chosen languages as booleans; and whether the text
    has any byte. The set has the k most frequent languages, for the k
    with the best log likelihood less penalty * (k - 1) * log(runs + 1)."""
    n, width = len(offsets) - 1, len(model.langs)
    lens = np.diff(offsets)
    runs = -(-lens // RUN_BYTES)
    share = np.full((n, width), 1.0 / max(width, 1))
    chosen = np.zeros((n, width), bool)
    some = np.flatnonzero(runs)
    if not len(some) or not width:
        return share, chosen, runs > 0
    first = np.concatenate([[0], np.cumsum(runs[some])])
    doc = np.repeat(np.arange(len(some)), runs[some])
    starts = offsets[some][doc] + (np.arange(first[-1]) - first[:-1][doc]) * RUN_BYTES
    bucket = _buckets(buf, offsets)
    log_p = np.empty((len(starts), width))
    for i in range(0, len(starts), _RUNS):
        lo, hi = starts[i], starts[i + _RUNS] if i + _RUNS < len(starts) else len(buf)
        log_p[i : i + _RUNS] = np.add.reduceat(model.log_p[bucket[lo:hi]], starts[i : i + _RUNS] - lo, axis=0)
    # Neighbouring n-grams overlap, so a run holds less evidence than its n-grams taken apart.
    log_p *= 0.5
    top = log_p.max(1, keepdims=True)
    p = np.exp(log_p - top)
    pi = np.full((len(some), width), 1.0 / width)
    size = runs[some][:, None]
    for _ in range(EM_STEPS):
        r = p * pi[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first[:-1], axis=0) / size
    rank = np.argsort(-pi, axis=1, kind="stable")
    best, best_k = np.full(len(some), -np.inf), np.ones(len(some), int)
    for k in range(1, width + 1):
        mask = np.zeros_like(pi)
        np.put_along_axis(mask, rank[:, :k], 1.0, axis=1)
        sub = np.maximum(pi, 1e-12) * mask
        sub /= sub.sum(1, keepdims=True)
        fit = np.add.reduceat(np.log((p * sub[doc]).sum(1) + 1e-300) + top[:, 0], first[:-1]) - penalty * (k - 1) * np.log(size[:, 0] + 1)
        better = fit > best
        best[better], best_k[better] = fit[better], k
    share[some] = pi
    picked = np.zeros_like(pi, bool)
    for k in range(width):
        picked[np.arange(len(some)), rank[:, k]] |= best_k > k
    chosen[some] = picked
    return share, chosen, runs > 0


def _has_letter(part: bytes) -> bool:
    return any(c.isalpha() for c in part.decode("utf-8", "replace"))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with lang_pred, score (the share of lang_pred
    in the document, 0 to 1) and languages (the chosen set, most frequent first).

    A null text, one without letters, or an empty model gives `und`, 0 and an empty
    set. Repeated rows are judged alike. Columns with these names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    rows = docs.select(F.col(f"`{text_col}`").alias(fresh("text_in", kept)), *[F.col(f"`{c}`") for c in kept])
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("languages", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            pred, score, sets = [], [], []
            for i, j in slices(offs, _SLICE_BYTES):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                share, chosen, some = infer(m, part, o)
                letter = (((part | 32) >= 97) & ((part | 32) <= 122)).astype(np.int64)
                sure = np.diff(np.concatenate([[0], np.cumsum(letter)])[o]) > 0
                for k in range(j - i):
                    known = bool(m.langs) and some[k] and (sure[k] or _has_letter(part[o[k] : o[k + 1]].tobytes()))
                    by = np.argsort(-share[k], kind="stable") if known else []
                    pred.append(names[by[0]] if known else UNKNOWN)
                    score.append(min(1.0, float(share[k][by[0]])) if known else 0.0)
                    sets.append([names[x] for x in by if chosen[k][x]])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], [*kept, "lang_pred", "score", "languages"])

    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5) -> DataFrame:
    """identify() with a model learned from the rows of docs whose id's crc32 is
    not divisible by modulus; held_out is true for those that are. A null id
    teaches nothing and is not held out."""
    fold = learned_fold(id_col, modulus)
    model = train(docs.filter(fold != 0), text_col, lang_col)
    return identify(docs, model, text_col).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
