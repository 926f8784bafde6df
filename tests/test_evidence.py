"""Claims, signals, profiles, recovery and search with pruning, on small frames of known results."""

import random

import pytest
from pyspark.sql import functions as F

from sievestone.functions import evidence as ev
from sievestone.operators import context as cx
from sievestone.operators import evidence as op
from sievestone.operators import lexical


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("OrderBook and order_book in run.py, OrderBook", ["OrderBook", "order_book", "run.py"]), ("How MAX_SIZE", ["MAX_SIZE"]), ("", []), (None, [])])
def test_hints(spark, text, want):
    assert column(spark, text, ev.identifier_hints) == want


@pytest.mark.parametrize(("text", "want"), [("QueryOptimizer.run_all2", ["2", "all", "all2", "optimizer", "query", "queryoptimizer", "run"]), ("HTTPServer", ["http", "httpserver", "server"]), (None, [])])
def test_name_terms(spark, text, want):
    assert column(spark, text, ev.name_terms) == want


@pytest.mark.parametrize(("token", "want"), [("serialisation", "serializ"), ("queries", "query"), ("connections", "connection"), ("handlers", "handl"), ("used", "used"), ("payments", "payment")])
def test_lexemes(spark, token, want):
    assert column(spark, token, ev.lexeme) == want


@pytest.mark.parametrize(("text", "n", "want"), [("short", 5, "short"), ("a" * 50, 5, "a" * 20 + "\n# ... truncated"), ("aaaaaaaaaaaaaa\n\nbbbbbbbbbb", 5, "aaaaaaaaaaaaaa\n# ... truncated"), ("aa\n\nbbbbbbbbbbbbbbbbbbbbbb", 5, "aa\n\nbbbbbbbbbbbbbbbb\n# ... truncated")])
def test_truncate(spark, text, n, want):
    assert column(spark, text, lambda c: ev.truncate(c, n)) == want


def test_claims_and_coverage(spark):
    q = spark.createDataFrame([(1, "trace the OrderBook flow, handle errors and retry"), (2, "")], "query_id long, q string")
    claims = op.claim_packets(q)
    rows = {(r.query_id, r.claim_id): r for r in claims.collect()}
    assert rows[1, "C1"].intent == "TRACE" and rows[1, "C1"].hints == ["OrderBook"] and rows[1, "C2"].intent == "ERROR_FALLBACK" and len(rows) == 4
    blocks = spark.createDataFrame([(10, "order.py", "OrderBook", "class OrderBook: trace flow of orderbook sequence step"), (11, "x.py", "", "nothing")], "block_id long, file string, symbol string, content string")
    cand = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, block_id long, rank int")
    cov = {(r.query_id, r.claim_id): r for r in op.claim_coverage(claims, cand, op.block_lexemes(blocks)).collect()}
    assert cov[1, "C1"].covered and cov[1, "C1"].symbol == 1.0 and not cov[1, "C2"].covered and cov[2, "C1"].n_anchors == 0
    gate = {r.query_id: r for r in op.claim_gate(op.claim_coverage(claims, cand, op.block_lexemes(blocks))).collect()}
    assert gate[1].action == "SOFT_RECOVERY" and gate[1].unresolved == ["C2", "C3"]


def test_veto_and_remediation(spark):
    rows = [("INSUFFICIENT", "SUFFICIENT", "SUFFICIENT"), ("SUFFICIENT", "INSUFFICIENT", "INSUFFICIENT"), ("SUFFICIENT", "SUFFICIENT", "INSUFFICIENT"), ("SUFFICIENT",) * 3]
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, structural string, rule string, semantic string")
    got = op.remediation(op.veto(s, F.array(F.lit("RULE"), F.lit("SEMANTIC"))), F.col("k") == 2)
    out = {r.k: (r.verdict, r.deciding, r.actions) for r in got.collect()}
    assert out == {0: ("SUFFICIENT", None, []), 1: ("INSUFFICIENT", "RULE", ["RETRIEVAL_RE_TARGET", "TOKEN_BUDGET_INCREASE"]), 2: ("PROBABLY_SUFFICIENT", "SEMANTIC", ["TOKEN_BUDGET_INCREASE", "RETRY_ESCALATION"]), 3: ("SUFFICIENT", None, [])}


def test_block_order_is_the_greedy_one(spark):
    """One sort gives what taking the best of the rest, less a tenth or so for its file, gives."""
    rng = random.Random(3)
    rows = [(1, i, i + 1, f"f{rng.randrange(4)}", rng.choice(["", "a_b"]), round(rng.random(), 2)) for i in range(40)]
    c = spark.createDataFrame(rows, "query_id int, block_id int, rank int, file string, symbol string, raw double")
    q = spark.createDataFrame([(1, "where is a")], "query_id int, q string")
    got = op.score_blocks(c, q, F.col("raw"), F.lit(0.0)).orderBy("position").collect()
    left, order, seen = sorted(got, key=lambda r: r["rank"]), [], {}
    while left:
        best = max(left, key=lambda r: (round(r.final / (1 + op.FILE_DECAY * seen.get(r.file, 0)), 9), -r["rank"]))
        left.remove(best)
        seen[best.file] = seen.get(best.file, 0) + 1
        order.append(best.block_id)
    assert [r.block_id for r in got] == order


def test_recovery_takes_each_block_once(spark):
    q = spark.createDataFrame([(1, "use alpha and beta")], "query_id long, q string")
    corpus = spark.createDataFrame([(1, "", "x = 1"), (2, "", "def alpha(): beta"), (3, "", "def beta(): pass\ndef alpha(): pass"), (4, "", "y"), (5, "", "z"), (6, "", "def gamma(): gamma()")], "block_id long, symbol string, content string")
    cand = corpus.filter("block_id in (1, 4, 5, 6)").withColumns({"query_id": F.lit(1).cast("long"), "rank": F.col("block_id").cast("int")})
    got = {(r.identifier, r.block_id) for r in cx.precision_recovery(q, cand, corpus).collect()}
    assert got == {("alpha", 2), ("beta", 3)}
    assert cx.precision_recovery(q, cand, corpus, most=1).count() == 1


def test_pruned_search_is_exact(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    pick = lambda: words[min(int(rng.expovariate(0.12)), 59)]
    docs = spark.createDataFrame([(i, " ".join(pick() for _ in range(rng.randrange(1, 60)))) for i in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(pick() for _ in range(rng.randrange(1, 25)))) for i in range(30)] + [(99, "none of these"), (100, None)], "query_id long, text string")
    index = lexical.build_index(docs)
    for part, plain in (("bm25", lexical.bm25_topk), ("share", lexical.tf_topk)):
        want = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in plain(docs, queries, 7).collect()}
        for rare in (1, 3, 6):
            got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in lexical.search(index, lexical.query_terms(queries), 7, part, rare).collect()}
            assert got == want
