"""Graph operators on edge tables (src, dst). Each hop is one join; frontiers only grow by new nodes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so loops don't pile up lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def bfs_distance(edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """(node, distance): hops from the nearest seed along src -> dst, up to max_depth."""
    seen = _written(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(depth))
        frontier = _written(step)
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen


def distance_score(distance):
    """0: 1, 1: 0.8, 2: 0.6, 3: 0.4, more: 0.2, unknown: 0."""
    return F.when(distance.isNull(), 0.0).when(distance <= 3, 1.0 - 0.2 * distance).otherwise(0.2)


def propagate(edges: DataFrame, seeds: DataFrame, decay: float = 0.8, depth: int = 3) -> DataFrame:
    """(node, score): the largest seed score times decay ** (hop + 1) over walks of at
    most `depth` hops; seeds themselves are left out unless a walk returns to them."""
    frontier, out = seeds.select("node", "score"), None
    for hop in range(depth):
        frontier = _written(frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("score").alias("score")))
        reached = frontier.select("node", (F.col("score") * decay ** (hop + 1)).alias("score"))
        out = reached if out is None else out.union(reached)
    return out.groupBy("node").agg(F.max("score").alias("score"))


#: Links that a task holds at once while it thins them.
HELD = 4_000_000


def _stars(links: pa.Table) -> pa.Table:
    """Links (a, b) with the same nodes and components: each node with the smallest of its component."""
    a, b = (links.column(c).combine_chunks() for c in ("a", "b"))
    both = pc.dictionary_encode(pa.concat_arrays([a, b]))
    order = pc.sort_indices(both.dictionary).to_numpy()
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # A link without one end only tells its other end.
    codes = both.indices.to_numpy(zero_copy_only=False)
    whole = links.column("a").is_valid().to_numpy() & links.column("b").is_valid().to_numpy()
    x, y = (place[c[whole].astype(np.int64)] for c in (codes[: len(a)], codes[len(a) :]))
    top = np.arange(n)
    while len(x):
        # A root takes one smaller root that a link leads to, so each tree's root stays its smallest node.
        top[np.maximum(x, y)] = np.minimum(x, y)
        while not np.array_equal(up := top[top], top):
            top = up
        x, y = top[x], top[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    nodes = both.dictionary.take(pa.array(order))
    # A smallest node needs a row of its own only where it is alone.
    told = (top != np.arange(n)) | (np.bincount(top, minlength=n) == 1)
    out = pa.table([nodes.take(pa.array(top[told])), nodes.take(pa.array(np.flatnonzero(told)))], links.schema)
    if both.null_count:
        out = pa.concat_tables([out, pa.table([pa.nulls(1, a.type)] * 2, links.schema)])
    return out


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a partition's links, some millions at a time; what they leave is thinned with what follows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= HELD:
            stars = _stars(pa.Table.from_batches(held))
            held, n = stars.to_batches(), len(stars)
            # Where links don't thin, they go on as they are.
            if n > HELD // 2:
                yield from held
                held, n = [], 0
    if n:
        yield from _stars(pa.Table.from_batches(held)).to_batches()


def _thin(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same nodes and components, far fewer where many run within a group. Each core thins
    one share of the nodes, as few large shares leave fewer links than many small ones."""
    few = links.repartition("a").coalesce(max(1, links.sparkSession.sparkContext.defaultParallelism))
    return _written(few.mapInArrow(_thinned, links.schema))


def connected_components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each reaches over edges between nodes, taken both ways;
    without nodes, those of the edges.

    Edges are thinned where they lie. In each round a node takes the smallest of itself and its neighbours as
    parent, the parents are shortened once, and what joins different parents is thinned anew: most vanishes."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if nodes is not None:
        for end in ("a", "b"):
            links = links.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
        links = links.select("a", "b")
    links = _thin(links)
    if nodes is None:
        nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    label = _written(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        links = links.filter("a <> b")
        if not links.limit(1).count():
            return label
        both = links.union(links.select("b", "a"))
        parent = _written(both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("up")).select("child", F.least("child", "up").alias("up")))
        above = parent.select(F.col("child").alias("via"), F.col("up").alias("further"))
        parent = _written(parent.join(above, parent["up"] == above["via"]).select("child", F.col("further").alias("up")))
        label = _written(label.join(parent, label["component"] == parent["child"], "left").select("node", F.coalesce("up", "component").alias("component")))
        moved = links.join(parent.toDF("a", "x"), "a").join(parent.toDF("b", "y"), "b").filter("x <> y")
        links = _thin(moved.select(F.col("x").alias("a"), F.col("y").alias("b")))


# Kinds of relation that are followed first, in order.
PRIORITY = ("DEFINES", "CALLS", "RESOLVES_TO", "INHERITS", "OVERRIDES")


def graph_stitch(edges: DataFrame, seeds: DataFrame, hops: int = 2, high_beam: int = 8, low_beam: int = 3, min_confidence: float = 0.5, limit: int = 8) -> DataFrame:
    """(query_id, node, relation, hop, confidence): neighbours to add to each query's seeds.

    edges: src, dst, relation, confidence; they are also followed backwards, as REV_
    relations of low priority. Each node gives its high_beam best edges of high and
    low_beam of low priority; a node is visited once; the best `limit` are returned."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("REV_"), "relation").alias("relation"), "confidence")
    every = edges.select("src", "dst", "relation", "confidence").union(back)
    high = F.col("relation").isin(*PRIORITY)
    beam = W.partitionBy("src", high).orderBy(F.desc("confidence"), "relation", "dst")
    every = every.withColumn("_at", F.row_number().over(beam)).filter(F.col("_at") <= F.when(high, high_beam).otherwise(low_beam)).drop("_at")
    every = _written(every)
    seen = _written(seeds.select("query_id", "node").distinct())
    frontier, found = seen, None
    for hop in range(1, hops + 1):
        step = frontier.join(every, frontier["node"] == every["src"]).select("query_id", F.col("dst").alias("node"), "src", "relation", "confidence")
        step = step.join(seen, ["query_id", "node"], "left_anti")
        first = W.partitionBy("query_id", "node").orderBy("src", F.desc("confidence"), "relation")
        step = _written(step.withColumn("_at", F.row_number().over(first)).filter("_at = 1").drop("_at", "src").withColumn("hop", F.lit(hop)))
        found = step if found is None else found.union(step)
        seen = _written(seen.union(step.select("query_id", "node")))
        frontier = step.select("query_id", "node")
    rank = F.lit(999)
    for i, name in enumerate(PRIORITY):
        rank = F.when(F.col("relation") == name, i).otherwise(rank)
    w = W.partitionBy("query_id").orderBy(rank, "hop", F.desc("confidence"), "relation", "node")
    out = found.filter(F.col("confidence") >= min_confidence).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return out.select("query_id", "node", "relation", "hop", "confidence", "rank")


def dangling(edges: DataFrame, column: str, nodes: DataFrame, node_col: str) -> DataFrame:
    """Edges whose column names no node. An anti join needs no distinct nodes, so none are held in a hash table."""
    return edges.join(nodes.select(F.col(node_col).alias("_n")), F.col(column) == F.col("_n"), "left_anti")


def ancestors(symbols: DataFrame, depth: int = 8) -> DataFrame:
    """(id, scope): the names of all ancestors by parent_id, outermost first, then its own."""
    out = symbols.select("id", "parent_id", F.array("name").alias("scope"))
    up = symbols.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"), F.col("name").alias("_name"))
    for _ in range(depth):
        out = out.join(up, out["parent_id"] == up["_id"], "left").select("id", F.col("_parent").alias("parent_id"), F.when(F.col("_name").isNull(), F.col("scope")).otherwise(F.concat(F.array("_name"), F.col("scope"))).alias("scope"))
    return out.select("id", "scope")
