"""The queries of the text operators over the smallest provided tables: against their SQL, or for
the columns that a few lines of Python give, against those."""

import math
import os
import re

import brute
import pytest

from sievestone.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(str(r[c]) for c in columns) for r in got.collect())
    assert rows and rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    out = queries.op2_url_filters(spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert len(out) == len(urls)
    for r in out:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (brute.lower(m[1]), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_languages(spark, texts):
    out = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    for i, t in texts:
        letters = any(c.isalpha() for c in t or "")
        assert out[i].held_out == (brute.fold(i, 5) == 0) and (out[i].lang_pred == "und") == (not letters) and 0 <= out[i].score <= 1
    held = [i for i, _ in texts if out[i].held_out and langs[i] and out[i].lang_pred != "und"]
    assert sum(out[i].lang_pred == langs[i] for i in held) > 0.9 * len(held)


def test_language_model_columns(spark, texts):
    out = {r.doc_id: r for r in queries.op10_language_model(spark, SF).collect()}
    n, want = brute.base_scores(texts, lambda i: brute.fold(i, 7) != 2)
    for i, (tokens, known, base) in want.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, brute.fold(i, 7) == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_pages_and_classes_have_all_rows(spark, texts):
    pages = queries.op5_html_extraction(spark, SF).collect()
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in pages)
    out = queries.op4_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in texts) and 0 < sum(r.kept for r in out)


def test_leaks(spark, texts):
    """Documents that hold an item word for word are leaked; what is said to be leaked is near one."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    out = {r.doc_id: r for r in queries.op7_decontamination(spark, SF).collect()}
    for i, t in texts:
        whole = " " + " ".join(words(t)) + " "
        exact = {k for k, w in items.items() if f" {' '.join(w)} " in whole}
        assert exact <= set(out[i]["items"]), i
        assert out[i].leaked == (out[i].n_leaks > 0) and (not exact or out[i].fewest_edits == 0)
        for k in out[i]["items"]:
            assert len(set(items[k]) & set(words(t))) >= 0.7 * len(set(items[k]))
