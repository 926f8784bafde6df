"""Operators on small fixtures, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.functions import classify, vectors
from sievestone.functions import text as tx
from sievestone.operators import dedup, fusion, graph, intervals, lexical, metrics, ranking, runs, selection, vector

RANKED = "query_id int, doc_id int, score double, rank int"


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("", 0), ("a", 1), ("a" * 7, 2), ("a" * 35, 10)])
def test_tokens_by_length(spark, text, want):
    assert one(spark, tx.tokens_by_length(F.col("t")), t=text) == want


@pytest.mark.parametrize(("path", "want"), [("./a/b", "a/b"), ("../a", "a"), (".github/x", "github/x"), ("a\\b", "a/b")])
def test_normalize_path(spark, path, want):
    assert one(spark, tx.normalize_path(F.col("t")), t=path) == want


@pytest.mark.parametrize(("word", "want"), [("bodies", "body"), ("running", "runn"), ("used", "used"), ("tested", "test"), ("boxes", "box"), ("cats", "cat"), ("is", "is")])
def test_stem(spark, word, want):
    assert one(spark, tx.stem(F.col("t")), t=word) == want


@pytest.mark.parametrize(("query", "intent"), [("Refactor and add tests", "refactor"), ("please implement X", "implement"), ("where is the file", "search"), ("why does it stop", "debug"), ("how it works", "explain"), ("", "unknown")])
def test_intent(spark, query, intent):
    assert one(spark, classify.retrieval_intent(F.col("t")), t=query) == intent


@pytest.mark.parametrize(("query", "k"), [("plain", 50), ("trace it", 65), ("trace all of it", 80), ("FooBar and BazQux", 65), ("FooBar BazQux some_name", 80)])
def test_required_k(spark, query, k):
    assert one(spark, classify.required_k(F.col("t")), t=query) == k


def test_similarity_is_bounded_and_falls(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.5, 1.0, 3.0, 10.0)], "d double")
    for mode in ("legacy", "calibrated_v1"):
        s = [r[0] for r in d.select(vectors.similarity(F.col("d"), mode)).collect()]
        assert s[0] == 1.0 and all(0 <= b <= a <= 1 for a, b in zip(s, s[1:], strict=False))
    with pytest.raises(ValueError):
        vectors.similarity(F.lit(1.0), "other")


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_bm25_against_plain(spark):
    docs = [(1, "the cat sat"), (2, "the dog and the cat"), (3, "birds fly"), (4, None), (5, "")]
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25_topk(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(7, "cat dog"), (8, None)], "query_id int, text string")).collect()}
    split = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, split.values())) / len(docs)
    for i, words in split.items():
        s = 0.0
        for t in ("cat", "dog"):
            df = sum(t in w for w in split.values())
            tf = words.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        assert math.isclose(got.get((7, i), 0.0), s, abs_tol=1e-9)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3)], RANKED)
    b = spark.createDataFrame([(1, 11, 9.0, 1), (1, 13, 5.0, 2), (1, 10, 1.0, 3)], RANKED)
    got = [(r.doc_id, tuple(r.provenance)) for r in fusion.rrf(a, b).orderBy("rank").collect()]
    assert got == [(11, ("a", "b")), (10, ("a", "b")), (13, ("b",)), (12, ("a",))]
    assert fusion.linear(a, b).count() == 4


def test_vector_topk(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 5))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id int, embedding array<float>")
    m = m.astype(np.float32).astype(float)
    for r in vector.vector_topk(v, v.filter("vec_id < 3"), 4).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("x")).collect():
        d = ((m - m[r.query_id]) ** 2).sum(1)
        d[r.query_id] = np.inf
        assert [y.vec_id for y in r.x] == np.argsort(d, kind="stable")[:4].tolist()


def test_knee_gate(spark):
    scores = [10, 9.9, 9.8, 3, 2.9, 2.8, 2.7]
    x = spark.createDataFrame([(1, i, float(s), i + 1) for i, s in enumerate(scores)] + [(2, 0, 1.0, 1)], RANKED)
    got = {r.query_id: r.keep for r in ranking.knee_gate(x, 1, 6, 0.2).collect()}
    assert got == {1: 1 if (0.1 + 0.1 + 6.8) / 3 / 9.9 > 0.2 else 2, 2: 1}


def test_rank_agreement(spark):
    a = spark.createDataFrame([(1, i, 1.0, i + 1) for i in range(5)], RANKED)
    b = spark.createDataFrame([(1, i, 1.0, 5 - i) for i in range(5)], RANKED)
    assert ranking.spearman(a, a).first().spearman == 1.0 and ranking.spearman(a, b).first().spearman == -1.0
    assert ranking.kendall(a, a).first().kendall == 1.0 and ranking.kendall(a, b).first().kendall == -1.0


def test_hierarchical_dedup(spark):
    rows = [(1, 1, "f", "fine", 1), (1, 2, "f", "coarse", 2), (1, 3, "f", "fine", 3), (1, 4, "f", "medium", 4), (1, 5, None, "coarse", 5)]
    x = spark.createDataFrame(rows, "query_id int, doc_id int, file string, granularity string, rank int")
    assert {r.doc_id for r in ranking.hierarchical_dedup(x).collect()} == {1, 3, 5}
    assert {r.doc_id for r in ranking.hierarchical_dedup(x, True).collect()} == {1, 2, 3, 4, 5}


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(3)
    a = [(k % 3, i, lo := rng.randrange(60), lo + rng.randrange(25)) for i, k in enumerate(range(40))]
    b = [(k % 3, i, lo := rng.randrange(60), lo + rng.randrange(25)) for i, k in enumerate(range(40))]
    got = {(r.i, r.j) for r in intervals.overlap_join(spark.createDataFrame(a, "k int, i int, lo int, hi int"), spark.createDataFrame(b, "k int, j int, lo2 int, hi2 int"), ["k"], 7).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]}


def test_asof_backward(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 6, 60)], "k int, t int, v int")
    got = {(r.k, r.t): r.x for r in intervals.asof_backward(left, right, ["k"], "t", "v", "v", "x").collect()}
    assert got == {(1, 5): 50, (1, 1): None, (2, 3): None}


def test_asof_over_slices(spark):
    """Values are carried over slices of time that hold none."""
    rng = random.Random(2)
    left = [(rng.randrange(3), rng.randrange(20000), i) for i in range(150)]
    right = [(rng.randrange(2), t, t) for t in rng.sample(range(20000), 60)]
    a, b = spark.createDataFrame(left, "k int, t int, i int").repartition(3), spark.createDataFrame(right, "k int, t int, v int").repartition(3)
    got = {r.i: r.x for r in intervals.asof_backward(a, b, ["k"], "t", "v", "v", "x").collect()}
    assert got == {i: max((v for kk, tt, v in right if kk == k and tt <= t), default=None) for k, t, i in left}


def test_sliding_percentile_and_histogram_by_parts(spark):
    rng = random.Random(3)
    rows = [(k, t, i, rng.choice([rng.randrange(20), rng.random() * 1000])) for i, (k, t) in enumerate((rng.choice("ab"), rng.randrange(300)) for _ in range(400))]
    rows += [("c", 1, 1000, 7.0), ("d", 1, 1001, 2.0), ("d", 2, 1002, 2.0)]
    df = spark.createDataFrame([(k, t, i, float(v)) for k, t, i, v in rows], "k string, t int, i int, v double").repartition(4)
    got = {r.i: r.percentile for r in metrics.sliding_percentile(df, ["k"], ["t", "i"], "v", size=15, slice_=F.floor(F.col("t") / 7), chunk=40).collect()}
    want = {}
    for k in "abcd":
        mine = sorted((t, i, v) for kk, t, i, v in rows if kk == k)
        for n, (_, i, v) in enumerate(mine):
            before = [x for _, _, x in mine[max(0, n - 15) : n]]
            want[i] = sum(x < v for x in before) / len(before) if before else 0.5
    assert got == want and len(got) == len(rows)
    for r in metrics.histogram_stats(df, ["k"], "v", slices=6).collect():
        v = sorted(float(x) for kk, _, _, x in rows if kk == r.k)
        assert (r["count"], r.min, r.max) == (len(v), v[0], v[-1])
        assert [r.p50, r.p95, r.p99] == [v[min(int(len(v) * q), len(v) - 1)] for q in (0.5, 0.95, 0.99)]


def test_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    e = spark.createDataFrame(edges, "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node int")
    root = list(range(60))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in graph.connected_components(nodes, e).collect()} == {i: top(i) for i in range(60)}
    reach, level = {0: 0}, [0]
    for depth in (1, 2, 3):
        level = list({b for a, b in edges if a in level} - set(reach))
        reach.update(dict.fromkeys(level, depth))
    assert {r.node: r.distance for r in graph.bfs_distance(e, spark.createDataFrame([(0,)], "node int"), 3).collect()} == reach


def test_entropy_and_histogram(spark):
    x = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (2, "d")], "query_id int, file string")
    got = {r.query_id: r.entropy for r in metrics.group_entropy(x, ["query_id"], "file").collect()}
    assert got[1] == 0 and math.isclose(got[2], 1.0)
    values = [float(v) for v in range(1, 101)]
    r = metrics.histogram_stats(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v").first()
    assert (r["count"], r["p50"], r["p95"], r["p99"], r["min"], r["max"]) == (100, 51.0, 96.0, 100.0, 1.0, 100.0)


def test_budget_skip(spark):
    x = spark.createDataFrame([(1, d, r, c) for r, (d, c) in enumerate([(1, 60), (2, 50), (3, 30), (4, 20), (5, 10)], 1)], "query_id int, doc_id long, rank int, tokens long")
    assert [r.doc_id for r in selection.budget_skip(x, 120, 20).orderBy("rank").collect()] == [1, 3, 5]


def test_greedy_selection_keeps_its_promises(spark):
    rng = random.Random(2)
    rows = [(q, i, rng.random(), i + 1, f"f{rng.randrange(3)}", [f"t{rng.randrange(9)}" for _ in range(4)], ["t1", "t2", "t3"], rng.randrange(5, 40)) for q in (1, 2) for i in range(12)]
    x = spark.createDataFrame(rows, "query_id int, doc_id int, score double, rank int, file string, terms array<string>, query_terms array<string>, tokens int")
    for op in (selection.submodular_pack, selection.set_optimize):
        got = op(x, 100)
        once = [tuple(r) for r in got.orderBy("query_id", "rank").collect()]
        assert once == [tuple(r) for r in op(x, 100).orderBy("query_id", "rank").collect()]
        for r in got.groupBy("query_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect():
            assert r.t <= 100 and r.n == r.d and r.n > 0


def test_mmr(spark):
    x = spark.createDataFrame([(1, 1, 1.0, 1, [1.0, 0.0]), (1, 2, 0.9, 2, [1.0, 0.0]), (1, 3, 0.8, 3, [0.0, 1.0]), (1, 4, 0.1, 4, None)], RANKED + ", embedding array<double>")
    assert [r.doc_id for r in selection.mmr(x, 0.5).orderBy("rank").collect()] == [1, 3, 4, 2]


def test_structural_dedup_emits_once(spark):
    rows = [(1, 1, 1.0, 1, "f", "coarse", 1, 50, "s1"), (1, 2, 0.9, 2, "f", "fine", 10, 20, "s2"), (1, 3, 0.8, 3, "f", "fine", 10, 20, "s2"), (1, 4, 0.7, 4, "g", "fine", 1, 5, "s3")]
    x = spark.createDataFrame(rows, RANKED + ", file string, granularity string, lo int, hi int, symbol_id string")
    assert sorted(r.doc_id for r in dedup.structural_dedup(x).collect()) in ([2, 4], [1, 4])


def test_runs(spark):
    v = spark.createDataFrame([(1, "improved"), (1, "regressed"), (2, "equal"), (2, "equal"), (2, "improved")], "query_id int, verdict string")
    got = {r.query_id: (r.verdict, round(r.stability, 3)) for r in runs.majority_verdict(v).collect()}
    assert got == {1: ("improved", 0.5), 2: ("equal", 0.667)}
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, h string")
    new = spark.createDataFrame([("a", "2"), ("c", "1")], "path string, h string")
    assert {r.path: r.change for r in runs.snapshot_diff(old, new, "path", "h").collect()} == {"a": "changed", "b": "deleted", "c": "new"}
    assert {r.change for r in runs.snapshot_diff(new, new, "path", "h").collect()} == {"unchanged"}
