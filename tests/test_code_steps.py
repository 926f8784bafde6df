"""Queries over code blocks: what they need of a block is worked out once, and candidates are dealt to their queries once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sievestone.functions import evidence as ev
from sievestone.operators import context as cx
from sievestone.operators import diagnostics as dg
from sievestone.operators import evidence as op

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize(("name", "lines"), [("kernel_metrics", 2), ("signal_profile", 2), ("synthesis_profile", 2), ("integration_profile", 4), ("evidence_scores", 2), ("evidence_picks", 2), ("merged_plans", 1), ("claim_anchor_scores", 2)])
def test_lines_are_read_once_for_blocks_and_once_for_candidates(spark, name, lines):
    from sievestone.plans import catalogue

    df = catalogue.QUERIES[name](spark, SF)
    # orders and lineitem alone hold l_orderkey.
    scans = [x for x in plan(df).split("\n") if "FileScan" in x and "l_orderkey" in x]
    assert len(scans) <= lines


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_plan_of_failure_mode_stays_small(spark):
    from sievestone.plans import catalogue

    assert len(catalogue.QUERIES["failure_mode"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_claims_and_words_do_not_go_through_the_driver(spark):
    q = spark.createDataFrame([(1, "trace the OrderBook flow")], "query_id long, q string")
    blocks = spark.createDataFrame([(10, "order.py", "OrderBook", "class OrderBook: trace flow")], "block_id long, file string, symbol string, content string")
    cand = spark.createDataFrame([(1, 10, 1)], "query_id long, block_id long, rank int")
    cov, scores = op.claim_coverage(op.claim_packets(q), cand, op.block_lexemes(blocks)), cx.evidence_scores(cand.join(blocks.select("block_id", *cx.evidence_columns()), "block_id"), q)
    for df in (cov, scores):
        assert "ShuffledHashJoin" in plan(df) and df.collect()


def stem(token):
    for old in ("deserialise", "serialise", "deserialisation", "serialisation"):
        token = token.replace(old, old.replace("lis", "liz"))
    y = token[:-3] + "y" if token.endswith("ies") and len(token) > 4 else token
    if token.startswith(("deserializ", "serializ")):
        return token[: token.index("z") + 1]
    return next((y[: -len(s)] for s in ev.SUFFIXES if y.endswith(s) and len(y) - len(s) >= 4), y)


def test_stems_in_one_pass_are_those_of_each_word(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab_9") for _ in range(rng.randrange(6))) + rng.choice(["", "ies", *ev.SUFFIXES, *ev.SUFFIXES]) for _ in range(400)] + ["serialises", "deserialisation", "reserialised", "serializers", "ies", "xies"]
    words = [w for w in words if w]
    x = spark.createDataFrame([(words, "(" + "-".join(words) + ") ")], "w array<string>, t string").select(F.transform("w", ev.lexeme).alias("each"), ev.lexemes(F.col("t")).alias("text")).first()
    want = [stem(w) for w in words]
    assert x.each == want and x.text == list(dict.fromkeys(want))


def test_measures_are_not_read_again_for_a_filter(spark):
    blocks = spark.createDataFrame([(1, "f.py", "def f():\n    return 1"), (2, "f.py", "# only words"), (3, "g.py", None)], "block_id long, file string, content string")
    m = dg.signal_noise(dg.composition(blocks, "block_id", "content", ("file",)))
    plans = (dg.ACTION_RULES, (dg.ActionRule("all", "KEEP", 0.1, "signal >= 0"),))
    df = cx.best_actions(dg.propose_plans(m, "file", plans), "file", 2)
    assert plan(df).count("aggregate(") == 1 and plan(m.filter("signal > 0.6")).count("aggregate(") == 1
    got = {(r.file, r.action): (r.priority, r.confidence, r.n_plans) for r in df.collect()}
    assert got["f.py", "PROTECT"] == (1, 0.9, 1) and got["f.py", "KEEP"] == (2, 0.8, 2) and got["g.py", "KEEP"] == (2, 0.1, 1)


def test_picks_and_profiles_match_plain_versions(spark):
    rng = random.Random(8)
    scores = [(q, b, o, r, rng.randrange(4)) for q in range(12) for b in range(1 + q % 5) for o, (r, _) in enumerate(cx.ROLES)]
    want = set()
    for q in range(12):
        used = set()
        for o, (r, _) in enumerate(cx.ROLES):
            left = [(-s, b) for k, b, i, _, s in scores if k == q and i == o and b not in used]
            if left:
                s, b = min(left)
                used.add(b)
                want.add((q, r, b, -s))
    df = spark.createDataFrame(scores, "query_id long, block_id long, order int, role string, score int")
    assert {tuple(r) for r in cx.evidence_picks(df).collect()} == want
    rows = [(q, i, i + 1, rng.choice("abc"), s := rng.randrange(40), s + rng.randrange(30), 1.0 + rng.random()) for q in range(6) for i in range(1 + 5 * q)]
    blocks = spark.createDataFrame(rows, "query_id long, block_id long, rank int, file string, start_line int, end_line int, base double").withColumns({"symbol": F.lit("s"), "content": F.concat(F.lit("w"), F.col("block_id").cast("string"))})
    asked = spark.createDataFrame([(q, "w0 w3 w4 w9") for q in range(6)], "query_id long, q string")
    got = {r.query_id: r for r in op.integration_profile(blocks, asked, "base").collect()}
    slope = {r.query_id: r.slope for r in op.early_slope(op.coverage_curve(blocks, asked)).collect()}
    for q in range(6):
        top = [r for r in rows if r[0] == q and r[2] <= 20]
        pairs = [(a, b) for a in top for b in top if a[2] < b[2]]
        part = lambda a, b: max(0, min(a[5], b[5]) - max(a[4], b[4]) + 1) / (min(a[5] - a[4], b[5] - b[4]) + 1) if a[3] == b[3] else 0
        assert got[q].overlap == pytest.approx(sum(part(*p) for p in pairs) / len(pairs) if pairs else 0) and got[q].slope == pytest.approx(slope[q])
        assert got[q].dispersion == pytest.approx(len({r[3] for r in top}) / len(top))


def test_claims_are_made_where_queries_are_dealt(spark):
    q = spark.createDataFrame([(i, f"trace the OrderBook flow {i}, or entries") for i in range(9)], "query_id long, q string").coalesce(1)
    claims = op.claim_packets(q)
    # One file of questions is one task: they are read after the exchange.
    assert "Exchange" in plan(claims).split("Generate", 1)[1]
    assert {(r.query_id, r.claim_id) for r in claims.collect()} == {(i, c) for i in range(9) for c in ("C1", "C2")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_sizes_of_blocks_need_no_texts(spark):
    from sievestone.plans import _code, catalogue

    text = {r.block_id: (r.file, r.symbol, len(r.content)) for r in _code.code_blocks(spark, SF).collect()}
    assert {r.block_id: (r.file, r.symbol, r.n_chars) for r in _code.code_sizes(spark, SF).collect()} == text
    for name in ("signal_profile", "adaptive_weights"):
        # Lines are not brought together, and candidates are sorted for ranks, for what else they are ranked by, for files and for levels.
        p = plan(catalogue.QUERIES[name](spark, SF))
        assert "collect_list" not in p and p.count("Sort [query_id") <= 4


def test_margin_of_ties_and_nothing(spark):
    rows = [(1, 1, 0.5, 2), (1, 2, 0.5, 1), (1, 3, 0.1, 3), (2, 1, 0.8, 2), (2, 2, None, 1), (3, 1, 0.9, 1), (4, 1, 0.8, 1), (4, 2, 0.2, 2), (5, 1, 0.0, 1), (5, 2, -1.0, 2)]
    x = spark.createDataFrame([(q, b, s, r, 9.0 - r, 1.0 * b, "f", "fine") for q, b, s, r in rows], "query_id long, block_id long, score double, rank int, bm double, vec double, file string, level string")
    for at in (None, "rank"):
        got = {r.query_id: (r.margin, r.correlation) for r in op.signal_profile(x, at=at).collect()}
        assert {q: m for q, (m, _) in got.items()} == {1: 0.0, 2: None, 3: 1.0, 4: pytest.approx(0.75), 5: 0.0}
        assert got[2][1] == pytest.approx(1.0) and got[4][1] == pytest.approx(-1.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pairs_and_files_need_no_table_of_all(spark, tmp_path):
    from sievestone.plans import _code, catalogue

    # Neither pairs nor the files of a query are keys of a hash table, and lines are not grouped to know a block.
    keys = [x.split("functions")[0] for x in plan(catalogue.QUERIES["synthesis_profile"](spark, SF)).split("\n") if "Aggregate" in x]
    assert keys and not any(c in x for x in keys for c in ("file#", "block_id#", "l_orderkey#"))
    rows = [(1, 7, 5.0, 1.0, 0.1), (1, 7, 9.0, None, 0.0), (1, 7, 2.0, 3.0, 0.2), (2, 7, 1.0, None, 0.3), (None, 7, 4.0, 2.0, 0.0), (None, 7, 6.0, 1.0, 0.0), (1, 8, 5.0, 1.0, 0.1)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in _code.code_pairs(spark, str(tmp_path)).collect()} == {(1, 7, 9.0, 3.0, 2.0), (2, 7, 1.0, None, 3.0), (None, 7, 6.0, 2.0, 0.0), (1, 8, 5.0, 1.0, 1.0)}


def test_files_of_the_first_blocks_are_counted_once(spark):
    rng = random.Random(9)
    rows = [(q, i + 1, rng.choice(["a", "b", "c", None]), rng.random()) for q in range(8) for i in range(1 + 7 * q)]
    x = spark.createDataFrame(rows, "query_id long, rank int, file string, base double")
    asked = spark.createDataFrame([(q, "stock of parts") for q in range(8)], "query_id long, q string")
    got = {r.query_id: r.dispersion for r in op.synthesis_profile(x, asked, "base", F.lit(0.0) * F.count("*"), top=20).collect()}
    for q in range(8):
        top = [f for k, r, f, _ in rows if k == q and r <= 20]
        assert got[q] == pytest.approx(len({f for f in top if f}) / len(top))
