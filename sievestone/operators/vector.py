"""Exact vector search for a stated set of query vectors, in blocks, and vector aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors as vx


# Queries that are sent at once, and vectors that meet them in one product.
BLOCK, TILE = 8192, 256


def _queries(queries: DataFrame, id_col: str, vector_col: str) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of the queries, in blocks of one length of vector each."""
    held: dict[int, tuple[list, list]] = {}
    for r in queries.select(id_col, vx.doubles(F.col(vector_col)).alias("v")).filter("v is not null").toLocalIterator():
        ids, vectors = held.setdefault(len(r[1]), ([], []))
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == BLOCK:
            yield ids, np.array(held.pop(len(r[1]))[1], float)
    for ids, vectors in held.values():
        yield ids, np.array(vectors, float).reshape(len(ids), -1)


def _tiles(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of a few rows at a time, by id; those of another length are left out."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TILE):
            part = batch.slice(lo, TILE)
            size = pc.fill_null(pc.list_value_length(part.column(1)), -1)
            part = part.filter(pc.equal(size, dim))
            part = part.take(pc.array_sort_indices(part.column(0)))
            if part.num_rows:
                yield part.column(0).to_pylist(), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, dim)


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from the first to the last."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.union(p)
    return out


def _nearest(ids: list, q: np.ndarray, k: int, exclude_self: bool, types: list[pa.DataType]):
    """What a task does with its vectors: of each query the k nearest of them."""
    norms = (q * q).sum(axis=1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[] for _ in ids]
        most = np.full(len(ids), np.inf)
        for at, v in _tiles(batches, q.shape[1]):
            far = norms + (v * v).sum(axis=1)[:, None] - 2 * (v @ q.T)
            slack = 1e-6 + 1e-9 * (norms + (v * v).sum(axis=1).max())
            limit = most
            if len(at) > k + 1:
                # One of the k + 1 nearest of the tile may be the query itself.
                limit = np.minimum(most, np.partition(far, k, axis=0)[k])
            hit = far <= limit + slack
            for j in np.flatnonzero(hit.any(axis=0)):
                rows = [i for i in np.flatnonzero(hit[:, j]) if not (exclude_self and at[i] == ids[j])]
                exact = _in_order((v[rows] - q[j]) ** 2).tolist()
                pool = sorted(got[j] + [(d, at[i]) for d, i in zip(exact, rows, strict=True)])
                if len(pool) > k:
                    most[j] = pool[k - 1][0]
                    # Of equal distances k are enough; those that differ by less than a rank tells stay.
                    pool = [x for i, x in enumerate(pool) if x[0] <= most[j] + 2e-9 and (i < k or pool[i - k][0] != x[0])]
                got[j] = pool
        flat = [(i, x, d) for i, pool in zip(ids, got, strict=True) for d, x in pool]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate(types)], ["query_id", "vec_id", "distance"])

    return best


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, mode: str = "legacy", id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, vec_id, distance, similarity, rank): the k nearest by squared L2.

    All vectors meet all queries in matrix products; each task keeps k of each query, whose
    distances are then added up in the order of dimensions."""
    kinds = [queries.schema[id_col].dataType, vectors.schema[id_col].dataType]
    schema = f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, distance double"
    types = [to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.float64()]
    rows = vectors.select(id_col, vector_col)
    parts = [rows.mapInArrow(_nearest(ids, q, k, exclude_self, types), schema) for ids, q in _queries(queries, id_col, vector_col)]
    out = _union(parts, vectors.sparkSession.createDataFrame([], schema))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("similarity", vx.similarity(F.col("distance"), mode)).select("query_id", "vec_id", "distance", "similarity", "rank")


def _alike(ids: list, q: np.ndarray, least: float, types: list[pa.DataType]):
    """What a task does with its vectors: the pairs with a query whose cosine reaches `least`."""
    norms = np.sqrt(_in_order(q * q))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, v in _tiles(batches, q.shape[1]):
            size = np.sqrt(_in_order(v * v))
            n = size[:, None] * norms
            rows, cols = np.nonzero((n > 0) & ((v @ q.T) >= (least - 1e-7) * n) if least > 0 else np.ones(n.shape, bool))
            for lo in range(0, len(rows), 1 << 16):
                r, c = rows[lo : lo + (1 << 16)], cols[lo : lo + (1 << 16)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.where(n[r, c] == 0, 0.0, _in_order(v[r] * q[c]) / n[r, c])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in c], types[0]), pa.array([at[i] for i in r], types[1]), pa.array(cosine)], ["query_id", "vec_id", "cosine"])

    return pairs


def cosine_matches(vectors: DataFrame, queries: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, cosine) at or above the threshold, a vector with itself left out."""
    kinds = [queries.schema[id_col].dataType, vectors.schema[id_col].dataType]
    schema = f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, cosine double"
    types = [to_arrow_type(kinds[0]), to_arrow_type(kinds[1])]
    rows = vectors.select(id_col, vector_col)
    parts = [rows.mapInArrow(_alike(ids, q, threshold, types), schema) for ids, q in _queries(queries, id_col, vector_col)]
    out = _union(parts, vectors.sparkSession.createDataFrame([], schema))
    return out.filter((F.col("query_id") != F.col("vec_id")) & (F.round("cosine", 9) >= threshold))


def centroids(vectors: DataFrame, key: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(key, dim, mean, n)."""
    each = vectors.select(key, F.posexplode(vx.doubles(F.col(vector_col))).alias("dim", "x"))
    return each.groupBy(key, "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def dispersion(vectors: DataFrame, key: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(key, n, mean_sq_distance, consistency): the mean squared distance to the
    centroid d, and d / (1 + d). d is the mean squared norm less the centroid's."""
    each = vectors.select(key, F.posexplode(vx.doubles(F.col(vector_col))).alias("dim", "x"))
    per = each.groupBy(key, "dim").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("m2"), F.count("*").alias("n"))
    out = per.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("m2") - F.col("m") * F.col("m")).alias("mean_sq_distance"))
    return out.withColumn("consistency", F.col("mean_sq_distance") / (1 + F.col("mean_sq_distance")))
