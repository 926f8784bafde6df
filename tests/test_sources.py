"""Source trees, index tables and streams."""

from pyspark.sql import functions as F

from sievestone.sources import tables, tree
from sievestone.streaming.metrics import append_metrics, windowed_metrics


def make_tree(tmp_path):
    (tmp_path / "src" / "build").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("import os\n\nclass A:\n    @property\n    def one(self):\n        return two()\n\ndef two():\n    # three()\n    return len('three()')\n")
    (tmp_path / "src" / "bad.py").write_text("def broken(:\n")
    (tmp_path / "src" / "build" / "x.py").write_text("x = 1\n")
    (tmp_path / "src" / "h.h").write_text("int x;\n")
    (tmp_path / "src" / "notes.bin").write_text("?")
    return str(tmp_path / "src")


def test_scan_and_symbols(spark, tmp_path):
    files = tree.scan_tree(spark, make_tree(tmp_path), ["build/*"])
    got = {r.path: (r.language, r.line_count) for r in files.collect()}
    assert got == {"a.py": ("python", 10), "bad.py": ("python", 1), "h.h": ("cpp", 1)}
    symbols = tree.python_symbols(files)
    rows = {r.name: r for r in symbols.filter("not parse_error").collect()}
    assert set(rows) == {"A", "one", "two"}
    assert rows["one"].parent_id == rows["A"].symbol_id and rows["one"].decorators == ["property"] and rows["A"].signature is None
    assert symbols.filter("parse_error").count() == 1
    edges = tree.call_edges(files, symbols.filter("not parse_error")).collect()
    assert {(e.caller_id, e.callee_id) for e in edges} == {(rows["one"].symbol_id, rows["two"].symbol_id)}


def test_index_tables(spark, tmp_path):
    t = tables.IndexTables(spark, "file://" + str(tmp_path / "index"))
    assert t.read("files").count() == 0 and t.is_legacy()
    t.write("files", spark.createDataFrame([("f1", "a.py"), ("f2", "b.py")], "file_id string, path string"))
    t.write("symbols", spark.createDataFrame([("s1", "f1", "x"), ("s2", "f2", "y")], "symbol_id string, file_id string, name string"))
    t.write("call_edges", spark.createDataFrame([("s1", "s2", 3), ("s2", "s2", 4)], "caller_id string, callee_id string, call_site_line int"))
    t.upsert("files", spark.createDataFrame([("f2", "b.py", "python")], "file_id string, path string, language string"))
    assert {(r.file_id, r.language) for r in t.read("files").collect()} == {("f1", None), ("f2", "python")}
    t.delete_file("a.py")
    assert [r.file_id for r in t.read("files").collect()] == ["f2"]
    assert [r.symbol_id for r in t.read("symbols").collect()] == ["s2"]
    assert [r.caller_id for r in t.read("call_edges").collect()] == ["s2"]
    t.set_metadata("schema_version", "1.9")
    assert t.is_legacy()
    t.set_metadata("schema_version", "10.0")
    assert not t.is_legacy()
    t.reset()
    assert t.read("files").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600 + 1_700_000_000).alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"), F.col("id").cast("double").alias("value"))
    path = str(tmp_path / "events.parquet")
    rows.repartition(3).write.parquet(path)
    got = {(r.start, r.event_type): (r.n, r.total) for r in windowed_metrics(spark, path).collect()}
    want = {(r.w.start, r.event_type): (r.n, r.total) for r in rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 4


def test_jsonl_sink(spark, tmp_path):
    path = str(tmp_path / "m")
    append_metrics(spark.createDataFrame([("a", 1.0)], "run string, x double"), path)
    append_metrics(spark.createDataFrame([("b", 2.0)], "run string, x double"), path)
    assert {(r.run, r.x, r.y) for r in tables.read_jsonl(spark, path, "run string, x double, y string").collect()} == {("a", 1.0, None), ("b", 2.0, None)}
