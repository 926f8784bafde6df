"""Benchmark decontamination: find benchmark items in documents under word edits.

Words are runs of letters, digits and bytes above 127, A-Z and the capitals of
Latin-1 lowered. An item of n words leaks into a document if some run of the
document's words is within floor((1 - similarity) * n) word edits of it.

Items and the item-sized windows of all documents are embedded by the CGK random
walk, under which edit distance becomes Hamming distance: at each step a walk puts
out the word it stands on and moves on if a hash of that word for this step is odd.
An edit parts two walks for some steps, so the walk is started anew at each word of
the item and of the window. A table of bit-sampling LSH keys a few sampled places of
such a walk; there are as many tables as the target recall asks for. The items' keys
are a distributed table; documents send what passes a filter of fixed size for those
keys to a join with it, and each meeting is verified by exact edit distance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import _U64, combine, drop_staged, mix64, pack, slices, small_batches, stage, text_buffer, unpack, word_hashes, word_spans

_SLICE_BYTES = 1 << 20
_KEEP = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
#: Steps of a walk for each place that a table samples of it: one in each part of the walk.
STEPS_A_PLACE = 3
#: Items of fewer words are found by whole segments, of which one at least stays whole.
SHORT = 8
MOST_TABLES = 32
LEAST_SIMILARITY = 0.5
#: Bits of the largest filter of keys: 16 MB.
MOST_FILTER_BITS = 27
_ODD = _U64(0x9FB21C651E98DF25)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and for each document the index of its first."""
    clean = _KEEP[buf]
    # Capitals of Latin-1 (À to Þ but for ×) too.
    high = np.flatnonzero((clean[:-1] == 0xC3) & (clean[1:] >= 0x80) & (clean[1:] <= 0x9E) & (clean[1:] != 0x97)) + 1
    clean[high] += 0x20
    starts, ends, first = word_spans(clean, offsets)
    return word_hashes(clean, starts, ends), first


def _fold(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h + x) * _ODD
    return h ^ (h >> _U64(29))


@dataclass(frozen=True)
class Table:
    """One hash table: the walk's random bits come from `number`, places are its sampled steps."""

    number: int
    places: tuple[int, ...]

    @staticmethod
    def draw(number: int, sampled: int) -> Table:
        rng = np.random.default_rng([5, number])
        return Table(number, tuple(int(rng.integers(STEPS_A_PLACE)) + STEPS_A_PLACE * k for k in range(sampled)))

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the walks from starts, and which starts they are. A walk that leaves its
        text (the words before ends) by its last place has none, nor has one that stands
        on one word at two places: so few words tell nothing. seen: of the walks whose first
        two places are not in this filter no key is wanted."""
        bits = mix64(words ^ _U64((self.number + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at, last = starts.astype(np.int32), len(words) - 1
        which = np.arange(len(starts))
        h = np.full(len(starts), self.number + 1, _U64)
        done, before = 0, None
        for k, place in enumerate(self.places):
            for j in range(done, place):
                at = at + ((bits[np.minimum(at, last)] >> _U64(j)) & _U64(1)).astype(np.int32)
            done = place
            h = _fold(h, words[np.minimum(at, last)])
            if k:
                moved = at != before
                if k == 1 and seen is not None:
                    moved &= seen[(h >> _U64(64 - _PAIR_BITS)).astype(np.int64)]
                some = np.flatnonzero(moved)
                at, which, h = at[some], which[some], h[some]
            before = at
        inside = at < ends[which]
        return h[inside], which[inside]

    def heads(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What keys() compares with seen, for each start; 0 where it does not come so far."""
        out = np.zeros(len(starts), _U64)
        h, which = Table(self.number, self.places[:2]).keys(words, starts, np.full(len(starts), 2 * len(words) + 64))
        out[which] = h
        return out


_PAIR_BITS = 22


def tables_for(similarity: float, recall: float, size: int, sampled: int = 3) -> list[Table]:
    """As many tables as find a share `recall` of items of `size` words with all edits that
    are allowed, spread evenly (the hardest case), by the measured chance of a table."""
    edits = int((1 - similarity) * size + 1e-9)
    trial = [Table.draw(t, sampled) for t in range(MOST_TABLES)]
    steps = sampled * STEPS_A_PLACE
    if not edits:
        return trial[:2]
    rng = np.random.default_rng(3)
    chance = []
    for _ in range(24):
        item = rng.integers(1, 2**63, size, dtype=np.uint64)
        text = list(item)
        for at in np.linspace(0, size - 1, edits + 2)[-2:0:-1].astype(int):
            kind = rng.integers(3)
            if kind == 2:
                del text[at]
            else:
                text[at : at + (kind == 0)] = [_U64(rng.integers(1, 2**63))]
        text = np.array(text + list(rng.integers(1, 2**63, steps, dtype=np.uint64)), _U64)
        begin, stop = np.arange(size), np.full(size, size)
        open_, end = np.arange(len(text) - steps), np.full(len(text) - steps, len(text))
        chance.append(np.mean([bool(np.isin(t.keys(item, begin, stop)[0], t.keys(text, open_, end)[0]).any()) for t in trial]))
    # A table's chance is never taken as sure, as it is measured on a few trials.
    chance = np.minimum(np.array(chance), 0.95)
    for n in range(1, MOST_TABLES):
        if float(((1 - chance) ** n).mean()) <= 1 - recall:
            return trial[:n]
    return trial


def _segments(n: int, edits: int) -> tuple[int, list[int]]:
    """Width and starts of edits + 1 segments of n words: one of them at least is not edited."""
    width = n // (edits + 1)
    return width, [k * width for k in range(edits + 1)]


def _segment_keys(words: np.ndarray, width: int) -> np.ndarray:
    """A key of each `width` words in a row."""
    return combine(np.full(max(0, len(words) - width + 1), width, _U64), *[words[k : len(words) - width + 1 + k] for k in range(width)])


def allowed_edits(n, similarity: float):
    return np.floor((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def _item_keys(similarity: float, tables: list[Table]):
    """item, words -> item, key, place (of the key in the item), head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(data, _U64)
                n = len(words)
                keys, places, heads = [], [], []
                if n < SHORT:
                    width, starts = _segments(n, int(allowed_edits(n, similarity)))
                    all_keys = _segment_keys(words, width)
                    keys, places, heads = [all_keys[starts]], [np.array(starts)], [np.full(len(starts), -width)]
                else:
                    begin = np.arange(n)
                    for t in tables:
                        h, which = t.keys(words, begin, np.full(n, n))
                        keys.append(h)
                        places.append(which)
                        heads.append((t.heads(words, begin)[which] >> _U64(64 - _PAIR_BITS)).astype(np.int64))
                keys, places, heads = np.concatenate(keys), np.concatenate(places), np.concatenate(heads)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(places, pa.int32()), pa.array(heads, pa.int32())], ["item", "key", "place", "head"])

    return run


@dataclass(frozen=True)
class _Filter:
    """seen: which heads of walks occur in an item; bits: a filter of the items' keys by
    their leading bits; widths: of the segments of short items; margin: words around a
    hit in which the leak lies."""

    seen: np.ndarray
    bits: np.ndarray
    shift: int
    tables: list[Table]
    widths: list[int]
    margin: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> _U64(self.shift)
        return ((self.bits[(at >> _U64(3)).astype(np.int64)] >> (at & _U64(7)).astype(np.uint8)) & 1).astype(bool)

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words and keys there that an item may have, by place."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, _U64)
        doc_end = np.repeat(first[1:], np.diff(first))
        at, found = [], []
        if self.tables:
            start = np.arange(n)
            for t in self.tables:
                keys, which = t.keys(words, start, doc_end, self.seen)
                some = self.has(keys)
                at.append(which[some])
                found.append(keys[some])
        for width in self.widths:
            keys = _segment_keys(words, width)
            some = np.flatnonzero(self.has(keys))
            some = some[some + width <= doc_end[some]]
            at.append(some)
            found.append(keys[some])
        at, found = np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, _U64)
        order = np.argsort(at, kind="stable")
        return at[order], found[order]


def _nominate(shared):
    """text_key, text -> a row for each region of hits: its words, and keys and their places in it."""
    schema = pa.schema([("text_key", pa.string()), ("region", pa.int32()), ("words", pa.binary()), ("keys", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            rows = []
            for i, j in slices(offs, _SLICE_BYTES):
                words, first = words_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at, keys = f.hits(words, first)
                if not len(at):
                    continue
                doc = np.searchsorted(first, at, side="right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * f.margin)
                cut = np.append(np.flatnonzero(new), len(at))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    d = int(doc[a])
                    lo, hi = max(int(first[d]), int(at[a]) - f.margin), min(int(first[d + 1]), int(at[b - 1]) + f.margin)
                    rows.append((batch.column(0)[i + d].as_py(), lo - int(first[d]), pack(words[lo:hi].tobytes()), keys[a:b].view(np.int64), (at[a:b] - lo).astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)

    return run


def best_edits(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """For each item and text the fewest word insertions, deletions and substitutions
    between the item and any run of the text."""
    n, m = np.array([len(x) for x in items]), max((len(x) for x in texts), default=0)
    # Words that are not there are equal to none: one does for the items, one for the texts.
    a, b = np.zeros((len(items), int(n.max(initial=0))), _U64), np.ones((len(texts), m), _U64)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    place = np.arange(m + 1)
    row = np.zeros((len(items), m + 1), np.int64)
    out = np.where(n == 0, 0, n)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(new - place, axis=1) + place
        ended = n == i + 1
        out[ended] = row[ended].min(axis=1)
    return out


def _verify(similarity: float):
    """text_key, item, spot, words, item_words -> text_key, item, edits where few enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            items = [np.frombuffer(x, _U64) for x in cols["item_words"]]
            edits = allowed_edits([len(x) for x in items], similarity)
            found = np.full(len(items), -1, np.int64)
            texts, words, of = [], None, None
            for k in range(len(items)):
                if cols["words"][k] is not of:
                    of = cols["words"][k]
                    words = np.frombuffer(unpack(of), _U64)
                e, reach = int(edits[k]), len(items[k]) + int(edits[k])
                texts.append(words[max(0, cols["spot"][k] * reach - e) : max(0, (cols["spot"][k] + 1) * reach + len(items[k]) + 2 * e)])
            # Alike sizes together, as many as make a few million cells.
            order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(texts[k])))
            i = 0
            while i < len(order):
                j = i + 1
                while j < len(order) and (j - i) * len(texts[order[j]]) < 1 << 18 and len(items[order[j]]) <= 2 * len(items[order[i]]):
                    j += 1
                some = order[i:j]
                found[some] = best_edits([items[k] for k in some], [texts[k] for k in some])
                i = j
            keep = np.flatnonzero((found >= 0) & (found <= edits))
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(keep)), batch.column("item").take(pa.array(keep)), pa.array(found[keep], pa.int32())], ["text_key", "item", "edits"])

    return run


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        words, first = words_of(buf, offs)
        data = [words[first[k] : first[k + 1]].tobytes() for k in range(batch.num_rows)]
        names = [hashlib.blake2b(x, digest_size=16).hexdigest() for x in data]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(data, pa.binary())], ["id", "item", "n", "words"])


def find_leaks(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, similarity: float, recall: float, sampled: int) -> DataFrame:
    """text_key, leaks of the rows of texts (text_key, text) in which items were found."""
    spark = texts.sparkSession
    small_batches(spark)
    source = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text_col}`").alias("text")).filter("text is not null")
    listed = stage(source.mapInArrow(_split_items, "id long, item string, n long, words binary").filter("n > 0"), "dc-items")
    items = listed.groupBy("item").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    long_ = F.when(F.col("n") >= SHORT, F.col("n"))
    least, most = listed.agg(F.min(long_), F.max("n")).first()
    tables = tables_for(similarity, recall, least, sampled) if least else []
    keys = stage(items.select("item", "words").mapInArrow(_item_keys(similarity, tables), "item string, key long, place int, head int"), "dc-keys")
    count = keys.count()
    bits = int(min(MOST_FILTER_BITS, max(20, math.ceil(math.log2(max(1, count) * 16)))))
    # One row for each 64 places of a filter that some key sets: never more than the filter's size.
    slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"))
    rows = slots.selectExpr("slot div 64 as at", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    heads = keys.select("head").distinct().toArrow()["head"].to_numpy()
    seen = np.zeros(1 << _PAIR_BITS, bool)
    seen[heads[heads >= 0]] = True
    margin = int(most or 0) + 2 * int(allowed_edits(most or 0, similarity)) + STEPS_A_PLACE * sampled
    shared = spark.sparkContext.broadcast(_Filter(seen, words.view(np.uint8), 64 - bits, tables, sorted(int(-h) for h in heads if h < 0), margin))
    regions = stage(texts.mapInArrow(_nominate(shared), "text_key string, region int, words binary, keys array<long>, at array<int>"), "dc-regions")
    hits = regions.select("text_key", "region", F.explode(F.arrays_zip("keys", "at")).alias("x")).select("text_key", "region", F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
    reach = F.col("n") + F.floor((1 - similarity) * F.col("n") + 1e-9)
    met = hits.join(keys.select("item", "key", "place"), "key").join(items.select("item", "n"), "item")
    met = met.select("text_key", "region", "item", F.floor((F.col("at") - F.col("place")) / reach).cast("int").alias("spot")).distinct()
    pairs = met.join(regions.select("text_key", "region", "words").dropDuplicates(["text_key", "region"]), ["text_key", "region"]).join(items.select("item", F.col("words").alias("item_words")), "item")
    verified = pairs.select("text_key", "item", "spot", "words", "item_words").mapInArrow(_verify(similarity), "text_key string, item string, edits int")
    best = verified.groupBy("text_key", "item").agg(F.min("edits").alias("edits"))
    leaks = F.collect_list(F.struct(F.col("id").alias("item"), "edits")).alias("leaks")
    out = stage(best.join(listed.select("item", "id"), "item").groupBy("text_key").agg(leaks), "dc-leaks")
    for old in (listed, keys, regions):
        drop_staged(old)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.99, sampled: int = 3) -> DataFrame:
    """All rows and columns of docs with leaks (array of struct item, edits: the
    items found and the fewest word edits, by item) and leaked (boolean).

    similarity: 0.5 to 1; other values are refused. recall: of items with all edits
    that are allowed, spread evenly, the share that the tables are to find, at the size of
    the shortest one (longer ones have more walks, and so more chances). sampled: places
    of a table; one more makes chance meetings rarer and asks for more tables, which pays
    for a benchmark of very many items. Items of fewer than SHORT words are found for certain.

    Items without a word and null items are left out; a null item id is an item of id
    null. Null and empty texts leak nothing. Equal items are each found; repeated rows
    are judged alike. Very long texts are searched whole. Columns of docs with these
    names are replaced.
    """
    if not LEAST_SIMILARITY <= similarity <= 1:
        raise ValueError(f"similarity must be from {LEAST_SIMILARITY} to 1")
    key = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    texts = docs.filter(F.col(f"`{text_col}`").isNotNull()).select(key.alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    leaks = find_leaks(texts, benchmark, item_col, item_text_col, similarity, recall, sampled)
    order = lambda x, y: F.when(x["item"].eqNullSafe(y["item"]), x["edits"] - y["edits"]).when(x["item"].isNull() | (x["item"] < y["item"]), -1).otherwise(1)
    found = leaks.select(F.col("text_key"), F.array_sort("leaks", order).alias("leaks"))
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("leaks", "leaked")]
    both = docs.alias("d").join(found.alias("f"), F.md5(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")).cast("binary")) == F.col("f.text_key"), "left")
    empty = F.from_json(F.lit("[]"), found.schema["leaks"].dataType)
    out = both.select(*kept, F.coalesce(F.col("f.leaks"), empty).alias("leaks"))
    return out.withColumn("leaked", F.size("leaks") > 0)
