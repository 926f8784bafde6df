"""JSON artifacts, run records, settings and extension points."""

import json

import pytest
from pyspark.sql import functions as F

from sievestone.plans import extension as ex
from sievestone.sources import artifacts as ar


def test_artifacts_are_sorted_and_read_back(spark, tmp_path):
    calls = spark.createDataFrame([("b", "z"), ("a", "y"), ("a", "x"), ("a", "x"), ("c", None)], "caller string, callee string").repartition(3)
    files = spark.createDataFrame([(2, "q.py"), (1, "p.py")], "file_id int, path string")
    ar.write_artifacts({"calls": calls, "files": files}, str(tmp_path), {"calls": ["caller", "callee"], "files": ["path"]})
    text = "".join(p.read_text() for p in sorted((tmp_path / "calls").glob("part-*")))
    rows = [json.loads(x) for x in text.splitlines()]
    assert [r["caller"] for r in rows] == sorted(r["caller"] for r in rows) and all(list(r) == sorted(r) for r in rows)
    assert {(r.caller, tuple(r.callees)) for r in ar.load_callgraph(spark, f"{tmp_path}/calls").collect()} == {("a", ("x", "y")), ("b", ("z",))}
    scope = {r.name: (r.n, r.digest) for r in ar.read_json(spark, f"{tmp_path}/scope", "name string, n long, digest long").collect()}
    ar.write_artifacts({"calls": calls.repartition(1), "files": files}, f"{tmp_path}/again", {"calls": ["caller", "callee"], "files": ["path"]})
    assert scope == {r.name: (r.n, r.digest) for r in ar.read_json(spark, f"{tmp_path}/again/scope", "name string, n long, digest long").collect()}
    assert scope["calls"][0] == 5 and scope["files"][0] == 2


def test_adjacency_has_both_ways(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"src": "a", "dst": "b", "relation": "USES", "confidence": 0.5}\n{"src": "x"}\n')
    (tmp_path / "c.json").write_text('{"caller": "a", "callee": "c"}\n')
    got = {(r.node, r.neighbour, r.relation, r.confidence) for r in ar.load_adjacency(spark, f"{tmp_path}/r.json", f"{tmp_path}/c.json").collect()}
    assert got == {("a", "b", "USES", 0.5), ("b", "a", "REV_USES", 0.5), ("a", "c", "CALLS", 1.0), ("c", "a", "REV_CALLS", 1.0)}


def test_shared_folder_without_a_setting():
    """The warehouse is shared too; the session's settings stay as they are."""
    from types import SimpleNamespace

    from sievestone.sources.shared import shared_dir

    def session(settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: settings.get(k, *d)))

    assert shared_dir(session({"spark.checkpoint.dir": "hdfs:///c/", "spark.sql.warehouse.dir": "hdfs:///w"})) == "hdfs:///c"
    assert shared_dir(session({"spark.sql.warehouse.dir": "hdfs:///w/"})) == "hdfs:///w/_staged"


def test_queries_and_responses(spark, tmp_path):
    rows = [{"query_id": 1, "query_text": "how"}, {"query_id": 2, "query_text": "why"}]
    for name, data in (("a.json", rows), ("b.json", {"queries": rows})):
        (tmp_path / name).write_text(json.dumps(data, indent=1))
        assert [(r.query_id, r.query_text) for r in ar.load_queries(spark, f"{tmp_path}/{name}").collect()] == [(1, "how"), (2, "why")]
    (tmp_path / "r.jsonl").write_text('{"query_id": 1, "status": "ok", "tokens_in": 5}\n{"query_id": 2}\n{"status": "lost"}\n')
    got = [(r.query_id, r.status, r.tokens_in, r.latency_ms, r.answer_text) for r in ar.load_responses(spark, f"{tmp_path}/r.jsonl").orderBy("query_id").collect()]
    assert got == [(1, "ok", 5, 0.0, ""), (2, "unknown", 0, 0.0, "")]


def test_lines_of_files(spark):
    files = spark.createDataFrame([("/w/a", "1\n2\n3\n4"), ("/w/../b", "1\n2"), ("/x/c", "1\n2"), ("/w/d", "1")], "path string, text string")
    got = {r.path: (r.start, r.end, r.content) for r in ar.read_lines(files, 2, 9, most_lines=2, root="/w").collect()}
    assert got == {"/w/a": (2, 3, "2\n3")}
    with pytest.raises(ValueError):
        ar.read_lines(files, 3, 2)


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"top_k": 7}')
    assert ar.load_settings(spark, f"{tmp_path}/s.json", {"top_k": 5, "other": "x"}) == {"top_k": 7, "other": "x"}
    with pytest.raises(KeyError):
        ar.load_settings(spark, f"{tmp_path}/s.json", {"other": 1})
    assert ar.clamp_overrides({"top_k": 999, "min_similarity": -1, "bm25_k": True, "evil": 3, "vector_k": "8", "max_tokens": float("nan")}) == {"top_k": 200, "min_similarity": 0.0}
    assert ar.broaden({"top_k": 20, "bm25_k": 300}, 1) == {"top_k": 30, "bm25_k": 400}


@pytest.mark.parametrize(("text", "want"), [("all", [1, 2, 3, 4, 5]), ("3", [3]), ("5, 1-2,2", [1, 2, 5])])
def test_selection(text, want):
    assert ar.parse_selection(text, 5) == want


@pytest.mark.parametrize("text", ["", "0", "6", "3-2", "x", "1,,2"])
def test_no_selection(text):
    with pytest.raises(ValueError):
        ar.parse_selection(text, 5)


def test_registered_steps_run_in_order(spark):
    docs = spark.createDataFrame([(1, "cat dog cat"), (2, "dog bird " * 20), (3, "fish")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "CATS and dog"), (2, "fish")], "query_id long, text string")

    class Singular:
        def prepare(self, q):
            return q.withColumn("text", F.regexp_replace("text", "(?i)cats", "cat"))

    class Stitch:
        def stitch(self, packed):
            return packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "|").alias("context"))

    r = ex.Registry()
    with pytest.raises(LookupError):
        ex.run(r, queries)
    r.register("preparer", Singular())
    r.register("index", ex.Bm25Index(docs), "words")
    r.register("index", ex.ShareIndex(docs), "share")
    with pytest.raises(LookupError):
        ex.run(r, queries)
    r.register("merger", ex.RankFusion())
    assert {(x.query_id, x.doc_id) for x in ex.run(r, queries, 2).collect()} == {(1, 1), (1, 2), (2, 3)}
    r.register("budget", ex.TokenBudget(docs, 10))
    r.register("stitcher", Stitch())
    assert {x.query_id: x.context for x in ex.run(r, queries, 2).collect()} == {1: "cat dog cat", 2: "fish"}
    with pytest.raises(TypeError):
        r.register("stitcher", object())
    with pytest.raises(KeyError):
        r.register("oven", Stitch())
