import itertools

import pytest
from pyspark.sql import functions as F

from sievestone.llm import url_filters as uf

CASES = [
    (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://EXAMPLE.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net/fr", "a.net", "/fr", None, "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://a.com?q=://b.net/es/", "a.com", "", None, "allow"),
    ("x://a.net/fr/\n://c", "a.net", "/fr/\n://c", "net/fr/", "block"),
]


def labelled(spark, n=200):
    rows = [(f"http://{'spam.bad' if i % 4 == 0 else f'site{i % 9}'}.org/{'win' if i % 3 == 0 else 'doc'}/{i}", i % 4 == 0 and i % 3 == 0) for i in range(n)]
    return spark.createDataFrame([*rows, (None, True), ("http://x.org/", None)], "url string, bad boolean")


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string")


def test_path_rules(spark, pages):
    out = {r.page_id: r for r in uf.url_filter(pages, labelled(spark).limit(0)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict), CASES[i]


def test_mined_rules_against_plain_counting(spark):
    data = labelled(spark)
    rows = [(frozenset(r.t), r.bad) for r in data.filter("url is not null and bad is not null").select(uf.url_tokens(F.col("url")).alias("t"), "bad").collect()]
    base = sum(bad for _, bad in rows) / len(rows)
    want = {}
    for tokens in {frozenset(c) for t, _ in rows for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}:
        hit = [bad for t, bad in rows if tokens <= t]
        confidence = sum(hit) / len(hit)
        if len(hit) >= 10 and confidence >= max(0.3, 1.5 * base) and confidence - base >= 2.5 * (base * (1 - base) / len(hit)) ** 0.5:
            want[tokens] = (len(hit), confidence)
    want = {t: x for t, x in want.items() if not any(s < t for s in want)}
    got = {frozenset(r.tokens): (r.n, r.confidence, r.anchor) for r in uf.mine_rules(data, 0.01).collect()}
    assert set(got) == set(want) and want
    for t, (n, confidence, anchor) in got.items():
        assert n == want[t][0] and abs(confidence - want[t][1]) < 1e-9
        assert sum(anchor in x for x, _ in rows) == min(sum(y in x for x, _ in rows) for y in t)


def test_rules_decide_where_no_path_rule_fits(spark):
    """Against plain matching; urls of .org hosts, for which there is no path rule."""
    data = labelled(spark).filter("url is not null").select(F.monotonically_increasing_id().alias("page_id"), "url")
    rules = [frozenset(r.tokens) for r in uf.mine_rules(labelled(spark), 0.01).collect()]
    out = uf.url_filter(data, labelled(spark), min_support=0.01).select("url", "rule", "verdict", uf.url_tokens(F.col("url")).alias("t")).collect()
    for r in out:
        assert r.rule is None and (r.verdict == "block") == any(need <= set(r.t) for need in rules)
    assert 10 < sum(r.verdict == "block" for r in out) < len(out) / 2


def test_native_and_extra_columns(spark, pages):
    odd = pages.withColumn("host", F.lit(1)).withColumn("z", F.lit(2)).withColumn("token_set", F.lit("mine")).withColumn("matched_set", F.lit("too"))
    out = uf.url_filter(odd, labelled(spark), min_support=0.01)
    assert out.columns.count("host") == 1 and out.count() == len(CASES) and out.filter("token_set = 'mine' and matched_set = 'too'").count() == len(CASES)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert uf.url_filter(pages.limit(0), labelled(spark)).count() == 0
    assert uf.url_filter(pages.union(pages), labelled(spark)).count() == 2 * len(CASES)


def test_labels_meet_pages_by_number(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/7?x=9"), (2, "http://a.org/en/8.html"), (3, "http://a.org/"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (8, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.url, r.bad) for r in uf.labelled_pages(pages, labels).collect()} == {("http://a.org/en/7?x=9", False), ("http://a.org/en/8.html", True)}
