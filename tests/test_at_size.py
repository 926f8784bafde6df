"""Steps that must not grow faster than their input, against plain versions."""

import random

from pyspark.sql import functions as F

from sievestone.operators import context as cx
from sievestone.operators import vector


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_meet_queries_in_products(spark):
    rng = random.Random(5)
    some = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice(some)) for i in range(700)]
    v = spark.createDataFrame([*rows, (700, None)], "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 50 = 0")
    near, alike = vector.vector_topk(v, q, 5), vector.cosine_matches(v, q, 0.6)
    for df in (near, alike):
        assert "Generate" not in plan(df) and "NestedLoop" not in plan(df)
    want = {(a, b) for a, x in rows if a % 50 == 0 for _, b in sorted((sum((s - t) ** 2 for s, t in zip(x, y)), b) for b, y in rows if b != a)[:5]}
    assert {(r.query_id, r.vec_id) for r in near.collect()} == want
    size = lambda x: sum(s * s for s in x) ** 0.5
    want = {(a, b) for a, x in rows if a % 50 == 0 for b, y in rows if b != a and round(sum(s * t for s, t in zip(x, y)) / (size(x) * size(y)), 9) >= 0.6}
    assert {(r.query_id, r.vec_id) for r in alike.collect()} == want


def test_words_end_where_those_of_sql_end(spark):
    from sievestone.functions import answers as an
    from sievestone.functions import classify as cl

    x = spark.createDataFrame([("écon but señor pro",), ("é 1. x",), ("a\r1. x\n2) y",), ("éflow",)], "t string")
    got = x.select(an._count(F.col("t"), an.CONTRAST).alias("c"), an._count(F.col("t"), an.STEP).alias("s"), cl.query_type(F.col("t")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(3, 0, "explanation"), (0, 0, "explanation"), (0, 1, "explanation"), (0, 0, "trace")]


def test_queries_and_all_blocks_of_a_name_never_meet(spark):
    n = 400
    blocks = spark.createDataFrame([(i, f"def shared(x): # {'y' * (i % 9)}", "f.py", f"s{i}") for i in range(n)], "block_id long, content string, file string, symbol string")
    queries = spark.createDataFrame([(i, "shared") for i in range(50)], "query_id long, q string")
    few = spark.createDataFrame([(i, 500 + i, "pass", "f.py", "", 1) for i in range(50)] + [(0, 0, "pass", "f.py", "", 2)], "query_id long, block_id long, content string, file string, symbol string, rank int")
    few = few.union(few.withColumn("block_id", F.col("block_id") + 1000)).union(few.withColumn("block_id", F.col("block_id") + 2000))
    for most in (None, 6):
        df = cx.precision_recovery(queries, few, blocks, own_most=most)
        assert {(r.query_id, r.block_id) for r in df.collect()} == {(i, 9 if i == 0 else 0) for i in range(50)}
        assert "WindowGroupLimit" in plan(df)


def test_anti_joins_hold_no_distinct_nodes(spark):
    from sievestone.operators import graph

    edges = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, to long")
    nodes = spark.createDataFrame([(5,), (5,), (None,)], "n long")
    got = graph.dangling(edges, "to", nodes, "n")
    assert {r.id for r in got.collect()} == {2, 3} and "Aggregate" not in plan(got)


def test_links_are_thinned_before_rounds(spark, monkeypatch):
    import pyarrow as pa

    from sievestone.operators import graph

    rng = random.Random(6)
    # Groups of 40 nodes and chains, some nodes alone, links to nothing, links to themselves.
    pairs = [(g * 40 + rng.randrange(40), g * 40 + rng.randrange(40)) for g in range(20) for _ in range(300)] + [(i, i + 1) for i in range(2000, 2100)] + [(3000, 3000), (3001, None), (None, None)]
    want = {x: x for p in pairs for x in p}
    while changed := [p for p in pairs if None not in p and want[p[0]] != want[p[1]]]:
        for a, b in changed:
            want[a] = want[b] = min(want[a], want[b])
    for held in (4_000_000, 64):
        monkeypatch.setattr(graph, "HELD", held)
        parts = [pa.table(list(map(pa.array, zip(*pairs[i : i + 50], strict=True))), pa.schema([("a", pa.int64()), ("b", pa.int64())])).to_batches() for i in range(0, len(pairs), 50)]
        thin = [r for b in graph._thinned(x for p in parts for x in p) for r in b.to_pylist()]
        assert len(thin) < (1000 if held > 64 else len(pairs) + 1)
        assert {v for r in thin for v in r.values()} == set(want)
    assert len(graph._stars(pa.Table.from_batches([x for p in parts for x in p]))) <= len(want)
    for kind in ("long", "string"):
        name = (lambda x: x) if kind == "long" else lambda x: x if x is None else f"n{x:05}"
        df = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"src {kind}, dst {kind}").repartition(5)
        assert {r.node: r.component for r in graph.connected_components(None, df).collect()} == {name(k): name(v) for k, v in want.items()}
    # A node that is not asked for links nothing.
    ends, path = spark.createDataFrame([(1,), (3,)], "node long"), spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert {tuple(r) for r in graph.connected_components(ends, path).collect()} == {(1, 1), (3, 3)}
