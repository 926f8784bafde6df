"""Language-model scoring by deleted interpolation.

The model mixes the maximum-likelihood n-grams of each length (bigram and unigram, or up
to a given order) and a uniform distribution. The weights depend on how often the context was seen (a bucket for
each power of two) and are learned by expectation-maximisation on deleted counts:
each training token is scored by the counts without itself.

Counting goes by blocks of documents. A block sends its distinct n-grams with its
own counts, as sorted arrays cut into ranges of the hash; a range adds the arrays
of all blocks up and answers each block in the order it asked. So a frequent
n-gram is one entry of each block, not a key with many rows, and the answers are
bare counts. Where ranges are many, this goes by levels (see _blocks.exchange).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import FAN, add_up, exchange, give_keys, make_blocks, merge_keys, open_block, pack_counts, pack_hashes, range_of, unpack_counts
from ._common import _U64, combine, drop_staged, fresh, learned_fold, small_batches, stage, text_buffer, trim, word_hashes, word_spans

BLOCK_BYTES = 6 << 20
BUCKETS = 32
_BINS = 48
_END = _U64(0x6A09E667F3BCC909)
_BEGIN = _U64(0xBB67AE8584CAA73B)


@dataclass(frozen=True)
class Weights:
    """weights: bucket of the longest context's frequency x (longest n-gram to unigram, uniform)."""

    weights: np.ndarray
    tokens: int
    types: int
    texts: int


class _Tokens:
    """A block's tokens: grams[n] are hashes of the n + 1 tokens that end at each token, in text
    order, `learn` tells which tokens are learned from, first the index of each text's first
    token. Before a text there is a begin."""

    def __init__(self, rows: bytes, order: int) -> None:
        self.table = open_block(rows)
        buf, offs = text_buffer(self.table.column(0))
        starts, ends, first = word_spans(buf, offs)
        n = self.table.num_rows
        self.first = first + np.arange(n + 1)
        words = np.full(int(self.first[-1]), _END, _U64)
        doc = np.repeat(np.arange(n), np.diff(first))
        words[np.arange(len(starts)) + doc] = word_hashes(buf, starts, ends)
        self.grams = [words]
        for _ in range(1, order):
            before = np.empty_like(words)
            before[1:] = self.grams[-1][:-1]
            before[self.first[:-1]] = _BEGIN
            self.grams.append(combine(before, words))
        learn = self.table.column(1).to_numpy(zero_copy_only=False).astype(bool)
        self.learn = np.repeat(learn, np.diff(self.first))

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes, for each token its place there, and the counts in learned texts."""
        found, at = np.unique(self.grams[n], return_inverse=True)
        return found, at, np.bincount(at[self.learn], minlength=len(found))


def _ask(parts: int, order: int):
    """block, rows -> a cell for each range of each length of n-gram: distinct hashes, learned counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _Tokens(rows, order)
                for n in range(order):
                    found, _, count = tokens.distinct(n)
                    cut = range_of(found, parts)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block] * parts, pa.int64()), pa.array(range(n * parts, (n + 1) * parts), pa.int32()),
                        pa.array([pack_hashes(found[cut[p] : cut[p + 1]]) for p in range(parts)], pa.binary()), pa.array([pack_counts(count[cut[p] : cut[p + 1]]) for p in range(parts)], pa.binary()),
                    ], ["sender", "part", "keys", "n"])

    return run


def _answer(ranges: int):
    """The totals over all senders of one range, for each in its own order; and for words a
    row of sender null with the learned tokens and types of the range."""

    def run(cells: pa.Table) -> pa.Table:
        found, total, at = add_up(cells)
        answers = [pack_counts(total[x]) for x in at]
        sender, part = cells.column("sender").to_pylist(), cells.column("part").to_pylist()
        n, own = len(sender), part[0] < ranges
        return pa.table({
            "sender": pa.array([*sender, *[None] * own], pa.int64()), "part": pa.array([*part, *part[:1] * own], pa.int32()), "answer": pa.array([*answers, *[None] * own], pa.binary()),
            "tokens": pa.array([0] * n + [int(total.sum())] * own, pa.int64()), "types": pa.array([0] * n + [int((total > 0).sum())] * own, pa.int64()),
        })

    return run


_ANSWER = "sender long, part int, answer binary, tokens long, types long"


def count_ngrams(docs: DataFrame, learn, text_col: str = "text", block_bytes: int = BLOCK_BYTES, parts: int | None = None, dropped: tuple = (), order: int = 2, fan: int = FAN) -> tuple[DataFrame, int, int]:
    """A table of blocks (rows: the documents, packed; answers: counts of all n-grams
    of the block over all learned texts), and the tokens and types learned."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c not in dropped]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(fresh("text_in", kept)), F.coalesce(learn, F.lit(False)).alias(fresh("learn", kept)), *[F.col(f"`{c}`") for c in kept])
    blocks = stage(rows.mapInArrow(make_blocks(block_bytes), "block long, rows binary"), "lm-blocks")
    senders = blocks.count()
    parts = parts or max(1, senders)
    first = min(parts, fan)
    # With levels below the first, ranges are as many as the levels cut in all.
    ranges, left = first, parts
    while left > fan:
        left = -(-left // fan)
        ranges *= min(left, fan)
    cells = blocks.mapInArrow(_ask(first, order), "sender long, part int, keys binary, n binary")
    used: list = []
    totals = exchange(cells, senders, parts, fan, merge_keys, give_keys((lambda x, n: unpack_counts(x), pack_counts)), (_answer(ranges), _ANSWER), dropped=used)
    answers = stage(totals, "lm-answers")
    tokens, types = answers.filter("sender is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    by_block = answers.filter("sender is not null").groupBy(F.col("sender").alias("block")).agg(F.array_sort(F.collect_list(F.struct("part", "answer"))).alias("answers"))
    counted = stage(blocks.join(by_block, "block"), "lm-counted")
    for old in (blocks, answers, *used):
        drop_staged(old)
    return counted, int(tokens), int(types)


def _counts(rows: bytes, answers: list[dict], texts: int, order: int = 2) -> tuple[_Tokens, list[np.ndarray], list[np.ndarray]]:
    """Tokens of a block; for each length of n-gram the learned counts of the one that ends
    at each token, and those of its context."""
    tokens = _Tokens(rows, order)
    each = len(answers) // order
    count = [np.concatenate([unpack_counts(a["answer"]) for a in answers[n * each : (n + 1) * each]])[tokens.distinct(n)[1]] for n in range(order)]
    context = []
    for n in range(1, order):
        before = np.empty_like(count[n])
        before[1:] = count[n - 1][:-1]
        before[tokens.first[:-1]] = texts
        context.append(before)
    return tokens, count, context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for a probability of 0, else by its logarithm, of which 30 powers of two are told apart."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(((_BINS - 1) + np.log2(np.maximum(p, 1e-300)) * ((_BINS - 2) / 30)).astype(np.int64), 1, _BINS - 1), 0)


def _deleted(n_tokens: int, texts: int, order: int):
    """Cells (bucket of the context, bins of the deleted estimates of each length) with their
    number and the estimates' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BUCKETS * _BINS**order
        total = np.zeros((order + 1, size))
        for batch in batches:
            trim()
            for rows, answers in zip(batch.column("rows").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                tokens, count, context = _counts(rows, answers, texts, order)
                learn = tokens.learn
                p = [(count[0][learn] - 1) / max(n_tokens - 1, 1)] + [np.where(context[k][learn] > 1, (count[k + 1][learn] - 1) / np.maximum(context[k][learn] - 1, 1), 0.0) for k in range(order - 1)]
                cell = _bucket(context[-1][learn])
                for x in reversed(p):
                    cell = cell * _BINS + _bin(x)
                for k, weight in enumerate((None, *p)):
                    total[k] += np.bincount(cell, weight, size)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0][at]), *[pa.array(total[k + 1][at]) for k in range(order)]], ["cell", "n", *[f"p{k}" for k in range(order)]])

    return run


def learn_weights(counted: DataFrame, tokens: int, types: int, texts: int, steps: int = 100, order: int = 2) -> Weights:
    """EM for the weights of each context bucket. The deleted estimates are gathered
    in a fixed grid of cells (a bucket, and 48 bins for each length of n-gram), each with
    its count and means, so what the driver sees does not grow with the corpus."""
    names = [f"p{k}" for k in range(order)]
    kind = "cell long, n double, " + ", ".join(f"{x} double" for x in names)
    got = counted.mapInArrow(_deleted(tokens, texts, order), kind).groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toArrow()
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    p = np.stack([*[got[x].to_numpy() / n for x in reversed(names)], np.full(len(n), 1 / (types + 1))], 1) if len(n) else np.zeros((0, order + 1))
    weights = np.tile([0.0] * (order - 1) + [0.9, 0.1], (BUCKETS, 1))
    bucket = cell // _BINS**order
    for k in np.unique(bucket):
        mine, count = p[bucket == k], n[bucket == k]
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(steps):
            r = mine * w
            r /= r.sum(1, keepdims=True)
            w = (r * count[:, None]).sum(0) / count.sum()
        # A uniform share of nothing would give unseen words no probability at all.
        w[-1] = max(w[-1], 1e-6)
        weights[k] = w / w.sum()
    for k in range(1, BUCKETS):
        if k not in bucket and len(bucket):
            weights[k] = weights[k - 1]
    return Weights(weights, tokens, types, texts)


def probabilities(model: Weights, count: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
    """The model's probability of each token. The estimate of a length whose context was never
    learned is left out, and the others' weights make up for it."""
    order = len(count)
    w = model.weights[_bucket(context[-1])]
    p, sure = w[:, order - 1] * count[0] / max(model.tokens, 1) + w[:, order] / (model.types + 1), w[:, order - 1] + w[:, order]
    for k in range(order - 1):
        known = context[k] > 0
        p = p + np.where(known, w[:, order - 2 - k] * count[k + 1] / np.maximum(context[k], 1), 0.0)
        sure = sure + np.where(known, w[:, order - 2 - k], 0.0)
    return p / np.maximum(sure, 1e-12)


def _score(model: Weights, schema: T.StructType, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            for rows, answers in zip(batch.column("rows").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                tokens, count, context = _counts(rows, answers, model.texts, order)
                add = lambda x: np.add.reduceat(x, tokens.first[:-1])  # noqa: E731, B023  a text has its end at least
                out = {
                    "n_tokens": np.diff(tokens.first),
                    "n_known": add((count[0] > 0).astype(np.int64)),
                    "train_tokens": np.full(tokens.table.num_rows, model.tokens),
                    "base_score": add(np.log10((count[0] + 1) / (model.tokens + model.types + 1))),
                    "score": add(np.log10(probabilities(model, count, context))),
                }
                kept = tokens.table.select([c for c in tokens.table.schema.names[2:] if c not in out]).combine_chunks()
                names = [*kept.schema.names, *out]
                for part in pa.Table.from_arrays([*kept.columns, *[pa.array(x) for x in out.values()]], names).to_batches(1024):
                    yield part

    return run


def score_texts(docs: DataFrame, learn, text_col: str = "text", keep_text: bool = True, block_bytes: int = BLOCK_BYTES, parts: int | None = None, order: int = 2, fan: int = FAN) -> DataFrame:
    """All rows and columns of docs with n_tokens, n_known, train_tokens, base_score
    and score (base-10 logarithms of the text's probability under add-one unigrams and
    under the model). learn: a condition on docs that tells which rows to learn from.
    keep_text: False leaves the text out of the result. order: the longest n-grams, in tokens.

    A null text is empty; an empty text is its end only. Words are hashed to 64 bits.
    Without learned rows all tokens are unknown and share one uniform probability.
    Repeated rows count as often as they stand. Columns with these names are replaced.
    """
    texts = docs.filter(learn).count()
    dropped = () if keep_text else (text_col,)
    counted, tokens, types = count_ngrams(docs, learn, text_col, block_bytes, parts, dropped, order, fan)
    model = learn_weights(counted, tokens, types, texts, order=order)
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names + dropped] + [T.StructField(n, T.DoubleType() if "score" in n else T.LongType()) for n in names])
    return counted.select("rows", "answers").mapInArrow(_score(model, schema, order), schema)


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, **options) -> DataFrame:
    """score_texts() learning from the rows whose id's crc32 modulo modulus is not
    held; held_out is true for the others. A null id is neither."""
    fold = learned_fold(id_col, modulus)
    out = score_texts(docs, fold != held, text_col, **options)
    return out.withColumn("held_out", F.coalesce(fold == held, F.lit(False)))
