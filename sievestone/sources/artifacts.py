"""Artifacts of an index as JSON lines, in an order that does not change from run to run; run
records and settings."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that may be changed from outside, with their bounds.
BOUNDS: dict[str, tuple[float, float]] = {"top_k": (1, 200), "bm25_k": (1, 400), "vector_k": (1, 400), "max_tokens": (256, 32768), "expansion_max": (0, 50), "min_similarity": (0.0, 1.0)}


def write_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, its keys sorted, the lines of each file by `order`; whole ranges of
    the order lie in files of rising names."""
    sorted_keys = rows.select(*sorted(rows.columns))
    sorted_keys.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_artifacts(tables: Mapping[str, DataFrame], path: str, keys: Mapping[str, list[str]]) -> None:
    """Every table under its name; `scope` tells the rows and a digest of each that does not
    depend on their order."""
    scope = None
    for name in sorted(tables):
        write_json(tables[name], f"{path}/{name}", keys[name])
        rows = F.xxhash64(*sorted(tables[name].columns))
        one = tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.bit_xor(rows), F.lit(0)).alias("digest"))
        scope = one if scope is None else scope.union(one)
    if scope is not None:
        write_json(scope, f"{path}/scope", ["name"])


def load_callgraph(spark: SparkSession, path: str) -> DataFrame:
    """(caller, callees): the sorted distinct callees of each caller, of call edges as JSON lines."""
    edges = read_json(spark, path, "caller string, callee string")
    return edges.filter("caller is not null and callee is not null").groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


def load_adjacency(spark: SparkSession, relations: str, calls: str) -> DataFrame:
    """(node, neighbour, relation, confidence): relations and calls, and each the other way under REV_."""
    r = read_json(spark, relations, "src string, dst string, relation string, confidence double").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    c = read_json(spark, calls, "caller string, callee string").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("relation"), F.lit(1.0).alias("confidence"))
    e = r.select("src", "dst", "relation", "confidence").union(c).filter("src is not null and dst is not null").distinct()
    back = e.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.concat(F.lit("REV_"), "relation").alias("relation"), "confidence")
    return e.toDF("node", "neighbour", "relation", "confidence").union(back)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_text) of a JSON array of queries, or of an object that holds it as `queries`."""
    raw = spark.read.text(path, wholetext=True).select("value")
    kind = "array<struct<query_id:int,query_text:string>>"
    whole = F.coalesce(F.from_json("value", kind), F.from_json("value", f"struct<queries:{kind}>")["queries"])
    is_object = F.ltrim("value").startswith("{")
    rows = raw.select(F.explode(F.when(is_object, F.from_json("value", f"struct<queries:{kind}>")["queries"]).otherwise(whole)).alias("q"))
    return rows.select("q.query_id", "q.query_text")


def load_responses(spark: SparkSession, path: str) -> DataFrame:
    """Run records as JSON lines; what is missing has its default."""
    rows = read_json(spark, path, "query_id int, query_text string, run_id string, telemetry_path string, tokens_in long, tokens_out long, latency_ms double, status string, answer_text string")
    return rows.fillna({"query_text": "", "run_id": "", "telemetry_path": "", "tokens_in": 0, "tokens_out": 0, "latency_ms": 0.0, "status": "unknown", "answer_text": ""}).filter("query_id is not null")


def read_lines(files: DataFrame, first: int, last: int, most_lines: int = 400, root: str | None = None) -> DataFrame:
    """files (path, text) -> (path, start, end, content, digest): the lines from first to last, at most
    most_lines of them; files outside root are left out."""
    if first < 1 or last < first:
        raise ValueError("lines run from 1 up")
    inside = F.lit(True)
    if root is not None:
        inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").rlike("(^|/)\\.\\.(/|$)")
    lines = F.slice(F.split("text", "\n"), first, min(last - first + 1, most_lines))
    rows = files.filter(inside).select("path", lines.alias("l")).filter(F.size("l") > 0)
    content = F.array_join("l", "\n")
    return rows.select("path", F.lit(first).alias("start"), (F.lit(first - 1) + F.size("l")).alias("end"), content.alias("content"), F.sha2(content, 256).alias("digest"))


def load_settings(spark: SparkSession, path: str, defaults: Mapping[str, object]) -> dict[str, object]:
    """Settings of a JSON file over defaults; unknown names are refused. A file of settings is small."""
    text = spark.read.text(path, wholetext=True).first()
    given = json.loads(text[0]) if text else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return {**defaults, **given}


def clamp_overrides(raw: Mapping[str, object]) -> dict[str, float]:
    """The numbers among raw whose names may be changed, within their bounds; all else is left out."""
    out: dict[str, float] = {}
    for name, (low, high) in BOUNDS.items():
        value = raw.get(name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            continue
        value = min(max(value, low), high)
        out[name] = int(value) if isinstance(low, int) else float(value)
    return out


def broaden(settings: Mapping[str, float], iteration: int) -> dict[str, float]:
    """Overrides of a follow-up search: each pass looks half as far again."""
    scale = 1 + 0.5 * max(0, iteration)
    return clamp_overrides({k: settings[k] * scale for k in ("top_k", "bm25_k", "vector_k") if k in settings})


def parse_selection(expression: str, total: int) -> list[int]:
    """1-based numbers of `all`, `5`, `1,4`, `2-6` or a mix; sorted, each once."""
    if expression.strip().lower() == "all":
        return list(range(1, total + 1))
    chosen: set[int] = set()
    for part in expression.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"not a selection: {part!r}")
        low, high = int(m[1]), int(m[2] or m[1])
        if not 1 <= low <= high <= total:
            raise ValueError(f"out of range 1 to {total}: {part.strip()}")
        chosen.update(range(low, high + 1))
    return sorted(chosen)
