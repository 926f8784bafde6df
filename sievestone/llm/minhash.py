"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of hashes, each of `half` minhashes, are paired: every hash of
the first with every hash of the second makes the key of one table. Thus m * m tables
cost 2 * m * half minhashes, about the square root of what independent tables would.
Documents that share a key are candidates, and each link is confirmed on the full
shingle sets.

Equal sets are one node from the start. The nodes of all buckets that hang together
form families; a family is compared in tiles of a few hundred nodes by a product of
its shingle matrices, which yields each tile's links as a spanning forest. So neither
the pairs of a bucket nor the links of a group are ever rows. A family of more than one
tile (as of many texts around one common passage) is first taken apart without loss: of
two sets that are alike enough, the rarest few shingles of one and of the other, in one
order of rarity, have one in common (prefix filtering), so a family falls into
those that hang together by such shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import _U64, combine, drop_staged, fresh, pack, slices, small_batches, stage, text_buffer, unpack, word_hashes, word_spans

_SLICE_BYTES = 1 << 20
_SEED = 23


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the width-word shingles of each text in order (repeats included), and
    the index of each text's first. A text with fewer words has its whole sequence."""
    starts, ends, first = word_spans(buf, offsets)
    words = word_hashes(buf, starts, ends)
    count = np.diff(first)
    shingles = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(shingles)])
    begin = np.repeat(first[:-1] - at[:-1], shingles) + np.arange(at[-1])
    doc = np.repeat(np.arange(len(count)), shingles)
    cols = [np.where(begin + k < first[doc + 1], words[np.minimum(begin + k, max(len(words) - 1, 0))], _U64(0)) if len(words) else words for k in range(width)]
    return (combine(*cols) if len(begin) else np.zeros(0, _U64)), at


def _set_of(data: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), width)[0])


def _hash_family(m: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([_SEED, m, half])
    k = 2 * m * half
    return rng.integers(1, 2**63, k, dtype=np.uint64) * _U64(2) + _U64(1), rng.integers(1, 2**63, k, dtype=np.uint64)


def half_keys(h: np.ndarray, at: np.ndarray, m: int, half: int) -> np.ndarray:
    """For each text (shingles at[d]:at[d + 1] of h) the 2 * m hashes of `half` minhashes."""
    odd, add = _hash_family(m, half)
    some = np.flatnonzero(np.diff(at))
    sign = np.zeros((len(at) - 1, len(odd)), _U64)
    for x in range(len(odd) if len(some) else 0):
        sign[some, x] = np.minimum.reduceat(h * odd[x] + add[x], at[some])
    return (combine(*[sign[:, y::half] for y in range(half)]) >> _U64(1)).astype(np.int64)


def _signer(width: int, m: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            sizes, keys, halves, texts = [], [], [], []
            for i, j in slices(offs, _SLICE_BYTES):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                h, at = shingle_hashes(part, o, width)
                both = half_keys(h, at, m, half)
                for d in range(j - i):
                    own = np.unique(h[at[d] : at[d + 1]])
                    sizes.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    halves.append(both[d] if len(own) else None)
                    texts.append(pack(part[o[d] : o[d + 1]].tobytes()) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.list_(pa.int64())), pa.array(texts, pa.binary())], ["id", "n_shingles", "set_key", "halves", "packed"])

    return run


#: Shingles are counted in so many slots, for the order of rarity: a fixed size, whatever the corpus.
RARITY_BITS = 20


#: Slots counted together in a row.
_SLOTS = 1 << 14


def _count_shingles(width: int):
    """node, packed -> part, n: in how many of the sets a shingle of each slot of a part stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                total += np.bincount((_set_of(unpack(x), width) >> _U64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        parts = total.reshape(-1, _SLOTS)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(parts[k].tobytes()) for k in some], pa.binary())], ["part", "n"])

    return run


def _add_counts(rows: pa.Table) -> pa.Table:
    total = np.zeros(_SLOTS, np.int64)
    for x in rows.column("n").to_pylist():
        total += np.frombuffer(unpack(x), np.int64)
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "n": pa.array([pack(total.tobytes())], pa.binary())})


def rarest(own: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many as must hold one that a set alike to
    percent has among its own rarest: size - ceil(size * percent / 100) + 1."""
    order = np.lexsort((own, count[(own >> _U64(64 - RARITY_BITS)).astype(np.int64)]))
    return own[order[: len(own) - -(-len(own) * percent // 100) + 1]]


def _rare_shingles(width: int, percent: int, shared):
    """node, packed, comp -> node, comp, shingle for each of the node's rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [rarest(_set_of(unpack(x), width), shared.value, percent) for x in part.column(1).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in rows]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(2).take(of), pa.array(np.concatenate(rows).view(np.int64))], ["node", "comp", "shingle"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Indices of the links a-b that make a spanning forest of n nodes."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def tile_links(sets: list[np.ndarray], num: int, den: int, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets with den * shared >= num * together.
    cut: only pairs of a set before cut and one from there on."""
    sizes = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    found, at, count = np.unique(values, return_inverse=True, return_counts=True)
    # Shingles of one set only can't be shared; the others are columns, some thousand at a time.
    column = np.cumsum(count > 1) - 1
    both = count[at] > 1
    owner, at = owner[both], column[at[both]]
    split = len(sets) if cut is None else cut
    shared = np.zeros((split, len(sets) if cut is None else len(sets) - cut), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[i:j], at[i:j] - lo] = 1
        shared += m[:split] @ (m.T if cut is None else m[cut:].T)
    together = sizes[:split, None] + (sizes if cut is None else sizes[cut:])[None, :] - shared
    linked = den * shared >= num * together
    if cut is None:
        linked = np.triu(linked, 1)
    a, b = np.nonzero(linked)
    b = b + (0 if cut is None else cut)
    keep = _forest(a, b, len(sets))
    return a[keep], b[keep]


def _partition_forest():
    """Of the links (a, b) of a partition only those that join two parts of it so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def top(x):
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = root[x]
            return x

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                keep.append(x != y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def thin(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, far fewer where many run within a group: a
    spanning forest of each partition, and again of the partitions that these make."""
    for _ in range(2):
        links = stage(links.mapInArrow(_partition_forest(), links.schema), "forest")
    return links


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each of nodes reaches over links (a, b).

    In each round a node takes the smallest of itself and its neighbours as parent; the
    parents are shortened once, and the links are drawn between parents anew, where
    most of them vanish. Every round is written."""
    edges = thin(links.select("a", "b"))
    found = stage(nodes.select("node", F.col("node").alias("comp")), "labels")
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
        parent = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("child"), F.least("a", "b").alias("up")), "parents")
        above = parent.select(F.col("child").alias("via"), F.col("up").alias("further"))
        parent = stage(parent.join(above, parent["up"] == above["via"], "left").select("child", F.least("up", F.coalesce("further", "up")).alias("up")), "parents")
        moved = edges.join(parent.toDF("a", "x"), "a").join(parent.toDF("b", "y"), "b").filter("x <> y")
        shorter = thin(moved.select(F.col("x").alias("a"), F.col("y").alias("b")))
        label = stage(found.join(parent, found["comp"] == parent["child"], "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        for old in (found, parent, edges):
            drop_staged(old)
        found, edges = label, shorter
    return found


def table_keys(halves: DataFrame, m: int) -> DataFrame:
    """(node, key): the keys of the m * m tables, from (node, halves)."""
    each = F.sequence(F.lit(0), F.lit(m - 1))
    keys = F.flatten(F.transform(each, lambda i: F.transform(each, lambda j: F.xxhash64(i, j, F.get("halves", i), F.get("halves", j + m)))))
    return halves.select("node", F.explode(keys).alias("key"))


def families(buckets: DataFrame) -> DataFrame:
    """(node, comp): the nodes that share a bucket with others, and their family, from
    (node, key)."""
    pivots = stage(buckets.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot"), "pivots")
    star = thin(buckets.join(pivots, "key").filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    drop_staged(pivots)
    nodes = star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))).distinct()
    out = components(nodes, star)
    drop_staged(star)
    return out


def split_families(found: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, comp) with each family taken apart into those that hang together by rare
    shingles. No two sets alike to percent are parted; nodes that are alone are left out."""
    spark = found.sparkSession
    got = texts.join(found.select("node"), "node", "left_semi").mapInArrow(_count_shingles(shingle), "part int, n binary").groupBy("part").applyInArrow(_add_counts, "part int, n binary")
    count = np.zeros(((1 << RARITY_BITS) // _SLOTS, _SLOTS), np.int64)
    for row in got.collect():  # 64 rows at most, of 128 KB at most
        count[row.part] = np.frombuffer(unpack(bytes(row.n)), np.int64)
    count = count.ravel()
    rows = texts.join(found, "node").select("node", "packed", "comp")
    kinds = rows.select("node", "comp").schema.add("shingle", T.LongType())
    rare = stage(rows.mapInArrow(_rare_shingles(shingle, percent, spark.sparkContext.broadcast(count)), kinds), "rare")
    out = families(rare.select("node", F.xxhash64("comp", "shingle").alias("key")))
    drop_staged(rare)
    return out


def _link_tiles(width: int, percent: int, kind: pa.DataType):
    def run(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_pylist() for c in ("comp", "lo", "hi", "tile", "node", "packed")}
        by: dict = {}
        for k in range(group.num_rows):
            by.setdefault((cols["comp"][k], cols["lo"][k], cols["hi"][k]), []).append(k)
        a, b = [], []
        for (_, lo, hi), rows in by.items():
            if len(rows) < 2:
                continue
            rows.sort(key=lambda k: (cols["tile"][k], cols["node"][k]))
            first = None if lo == hi else sum(cols["tile"][k] == lo for k in rows)
            if first in (0, len(rows)):
                continue
            x, y = tile_links([_set_of(unpack(cols["packed"][k]), width) for k in rows], percent, 100, first)
            nodes = [cols["node"][k] for k in rows]
            a += [nodes[i] for i in x]
            b += [nodes[i] for i in y]
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return run


#: Nodes of a tile, about.
TILE = 384


def all_links(signed: DataFrame, reps: DataFrame, shingle: int, percent: int, m: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between nodes: within each tile pair of a family, a spanning forest
    of the pairs whose full sets are similar enough."""
    found = families(table_keys(reps.select("node", "halves"), m))
    texts = stage(signed.filter("set_key is not null").join(found, F.col("id") == F.col("node"), "left_semi").dropDuplicates(["id", "set_key"]).select(F.col("id").alias("node"), "packed"), "texts")
    sizes = stage(found.groupBy("comp").agg(F.count("*").alias("n")), "sizes")
    several = sizes.filter(F.col("n") > tile).select("comp")
    apart = split_families(found.join(several, "comp", "left_semi"), texts, shingle, percent)
    whole = found
    found = stage(whole.join(several, "comp", "left_anti").select("node", "comp").union(apart.select("node", "comp")), "families")
    sizes = stage(found.groupBy("comp").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    # Small families share a group; a large one has a group for each pair of its tiles.
    group = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("comp"), F.lit(max(1, total // tile)))).otherwise(F.xxhash64("comp", "lo", "hi"))
    placed = found.join(sizes, "comp").withColumn("tiles", tiles).withColumn("tile", own).select("node", "comp", "tiles", "tile", other.alias("other"))
    placed = placed.select("node", "comp", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tiles").withColumn("cell", group).drop("tiles")
    kind = reps.select(F.col("node").alias("a"), F.col("node").alias("b")).schema
    arrow = pa.int64() if kind["a"].dataType == T.LongType() else pa.int32() if kind["a"].dataType == T.IntegerType() else pa.string()
    links = placed.join(texts, "node").groupBy("cell").applyInArrow(_link_tiles(shingle, percent, arrow), kind)
    out = stage(links.distinct(), "links")
    drop_staged(texts)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, m: int = 10, half: int = 2, tile: int = TILE) -> DataFrame:
    """For each row of docs: id_col, n_shingles (distinct shingles), component_id (the
    smallest id linked directly or over others) and kept (id = component_id).

    Documents are linked if 100 * shared shingles >= percent * all shingles of both.
    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; a text with fewer words than a
    shingle is one shingle; a text without words, or null, has no shingle and is linked
    with nothing. Rows of one id are linked with each other. A row with a null id is
    linked with nothing, has a null component and is kept. An empty table gives none.

    A link at the threshold is missed by all tables with a chance of about
    2 * (1 - (percent / 100) ** half) ** m. Other columns of docs are left out (see
    near_duplicates()). Texts of any length are compared whole.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("halves", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])
    signed = stage(docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(_signer(shingle, m, half), schema), "signed")
    real = F.col("set_key").isNotNull() & F.col("id").isNotNull()
    reps = stage(signed.filter(real).groupBy("set_key").agg(F.min("id").alias("node"), F.first("halves").alias("halves")), "sets")
    owned = stage(signed.filter(real).select("id", "n_shingles", "set_key").join(reps.select("set_key", "node"), "set_key").select("id", "n_shingles", "node"), "owned")
    several = owned.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).filter("a <> hi").select("id", "a")
    of_one_id = owned.join(several, "id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = all_links(signed, reps, shingle, percent, m, tile).union(of_one_id)
    comp = components(reps.select("node").distinct(), links)
    found = owned.join(comp, "node").select("id", "n_shingles", F.col("comp").alias("component_id"))
    rest = signed.filter(~real).select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.union(rest).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of docs with component_id and kept as near_groups() gives
    them for the row's id. Columns with these names are replaced."""
    groups = near_groups(docs, id_col, text_col, **options).filter(F.col(id_col).isNotNull())
    key = fresh("id", docs.columns)
    groups = groups.groupBy(F.col(id_col).alias(key)).agg(F.min("component_id").alias("component_id"))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("component_id", "kept")])
    out = rows.join(groups, rows[f"`{id_col}`"] == groups[key], "left").drop(key)
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))
