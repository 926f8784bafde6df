from pyspark.sql import functions as F

from sievestone.llm import quality_rules as qr

import brute


def test_base_against_plain(docs, corpus):
    got = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        r = got[i]
        want = brute.base_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_order_never_changes_the_verdict(docs):
    names = [r.name for r in qr.DEFAULT_RULES]
    a = qr.quality_rules(docs, order=names)
    b = qr.quality_rules(docs, order=names[::-1])
    assert {(r.doc_id, r.kept) for r in a.collect()} == {(r.doc_id, r.kept) for r in b.collect()}


def test_cheap_and_strict_rules_come_first(docs):
    never = qr.Rule("never", "length(regexp_replace(_text, '(a|b)+', '')) < 0")
    often = qr.Rule("often", "n_words > 30")
    assert [r.name for r in qr.plan_cascade(docs, [never, often])] == ["often", "never"]


def test_order_is_greedy_given_the_rules_before():
    """Rule 1 rejects most, but of what rule 0 leaves only little."""
    groups = {0b011: 50, 0b010: 10, 0b100: 20, 0b000: 100}
    assert qr.cascade_order(groups, [1.0, 1.0, 1.0]) == [1, 2, 0]
    assert qr.cascade_order(groups, [1.0, 1.5, 1.0]) == [0, 2, 1]
    assert qr.cascade_order({}, [2.0, 1.0]) == [1, 0]


def test_columns_of_the_same_name_as_inner_ones(docs):
    x = qr.quality_rules(docs.withColumn("_text", F.lit("mine")).withColumn("_measures", F.lit(1)), order=[r.name for r in qr.DEFAULT_RULES])
    assert x.filter("_text = 'mine' and _measures = 1").count() == docs.count()
    y = qr.quality_rules(docs.withColumnRenamed("text", "_text"), text_col="_text", order=[r.name for r in qr.DEFAULT_RULES])
    want = qr.quality_rules(docs, order=[r.name for r in qr.DEFAULT_RULES])
    assert {(r.doc_id, r.kept) for r in y.collect()} == {(r.doc_id, r.kept) for r in want.collect()} and "_text" in y.columns


def test_extra_columns_empty_table_and_filters(docs, no_docs):
    x = docs.withColumn("n_words", F.lit("mine")).withColumn("other", F.lit(1))
    out = qr.quality_rules(x)
    assert out.columns.count("n_words") == 1 and out.filter("kept").select("other").distinct().collect() == [(1,)]
    assert qr.quality_rules(no_docs).count() == 0
    twice = qr.quality_rules(docs.union(docs))
    assert twice.count() == 2 * docs.count()


def test_no_python_in_the_plan(docs):
    plan = qr.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
