"""Rankings are made where the documents are read: exact, with ties by id, and without exchanging tokens or texts."""

import math
import os
import random
import re

import pytest

from sievestone.operators import lexical

SF = "/root/testdata/sf0.001"


def test_rankings_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.1)), 49)] for _ in range(rng.randrange(0, 40)))
    some = [text() for _ in range(60)]
    texts = [rng.choice(some) for _ in range(1300)] + [None]
    asked = {i: text() for i in range(8)} | {8: some[3], 9: "nowhere"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    split = [re.findall("[a-z0-9_]+", t or "") for t in texts]
    n, avg = len(split), sum(map(len, split)) / len(split)
    df = {w: sum(w in s for s in split) for w in words + ["nowhere"]}

    def bm25(terms, s):
        return math.fsum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * s.count(t) * 2.2 / (s.count(t) + 1.2 * (0.25 + 0.75 * len(s) / avg)) for t in terms if t in s)

    def best(score):
        scored = [(-round(score(s), 9), d) for d, s in enumerate(split)]
        return [d for x, d in sorted(scored)[:7] if x < 0]

    terms = {q: set(re.findall("[a-z0-9_]+", t)) for q, t in asked.items()}
    lists = {"bm25": lexical.Asked(lexical.query_terms(queries)), "share": lexical.Asked(lexical.query_terms(queries), "share"), "every": lexical.Asked(lexical.query_terms(queries), every=True)}
    got = {}
    for r in lexical.rankings(docs, lists, 7).orderBy("rank").collect():
        got.setdefault((r.list, r.query_id), []).append(r.doc_id)
    for q, ts in terms.items():
        assert got.get(("bm25", q), []) == best(lambda s: bm25(ts, s))
        assert got.get(("share", q), []) == best(lambda s: sum(s.count(t) for t in ts) / max(len(s), 1))
        assert got.get(("every", q), []) == best(lambda s: bm25(ts, s) if ts <= set(s) else 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_no_row_for_each_token_and_no_exchange_of_texts(spark):
    from sievestone.plans import _base

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan(lexical.postings(docs)) + plan(lexical.term_stats(docs))
    assert "Exchange" not in plan(lexical.postings(docs))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(_base.candidates(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
