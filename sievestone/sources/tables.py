"""The index tables: schemas, writing, upserts, deletion, snapshots, and run files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.0"
SCHEMAS = {
    "files": "file_id string, path string, language string, content_hash string, line_count int, parse_error boolean, indexed_at timestamp",
    "symbols": "symbol_id string, file_id string, name string, kind string, start_line int, end_line int, signature string, parent_id string, content string",
    "call_edges": "caller_id string, callee_id string, call_site_line int",
    "entities": "entity_id string, file string, name string, entity_type string, span_start int, span_end int, docstring_hash string, confidence_score float, is_exported boolean, is_async boolean, parent_id string",
    "relations": "src string, dst string, relation_type string, extraction_source string",
    "chunks": "chunk_id string, file_path string, content string, granularity_level string, span_start int, span_end int, entity_ids array<string>, is_summary boolean, symbol_name string",
    "index_metadata": "key string, value string, at timestamp",
}
KEYS = {"files": ["file_id"], "symbols": ["symbol_id"], "call_edges": ["caller_id", "callee_id", "call_site_line"], "entities": ["entity_id"], "relations": ["src", "dst", "relation_type"], "chunks": ["chunk_id"], "index_metadata": ["key"]}


class IndexTables:
    """Tables in one folder. Each write makes a new version beside the old and then names it
    current, so a reader sees a whole table, and a failed write leaves the old."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _current(self, name: str) -> str | None:
        fs, at = self._fs(f"{self.root}/{name}/_current")
        if not fs.exists(at):
            return None
        return self.spark.read.text(f"{self.root}/{name}/_current").first()[0]

    def read(self, name: str) -> DataFrame:
        at = self._current(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(at) if at else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table. Columns that df lacks are null."""
        fields = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        kinds = dict(x.split() for x in SCHEMAS[name].split(", "))
        rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in fields])
        version = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        rows.write.parquet(version)
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}/_current")

    def upsert(self, name: str, df: DataFrame) -> None:
        """Rows of df replace those of equal keys; of equal keys within df any one stays."""
        keys = KEYS[name]
        new = df.dropDuplicates(keys)
        old = self.read(name).join(new.select(*keys), keys, "left_anti")
        self.write(name, old.unionByName(new, allowMissingColumns=True))

    def delete_file(self, path: str) -> None:
        """Remove a file with its symbols, edges, entities, relations and chunks."""
        files = self.read("files")
        gone = files.filter(F.col("path") == path).select("file_id")
        symbols = self.read("symbols")
        sym = symbols.join(gone, "file_id", "left_semi").select("symbol_id")
        ent = self.read("entities").filter(F.col("file") == path).select("entity_id")
        edges = self.read("call_edges").join(sym, F.col("caller_id") == F.col("symbol_id"), "left_anti").join(sym, F.col("callee_id") == F.col("symbol_id"), "left_anti")
        rel = self.read("relations").join(ent, F.col("src") == F.col("entity_id"), "left_anti").join(ent, F.col("dst") == F.col("entity_id"), "left_anti")
        out = {"call_edges": edges, "relations": rel, "symbols": symbols.join(gone, "file_id", "left_anti"), "entities": self.read("entities").filter(F.col("file") != path), "chunks": self.read("chunks").filter(F.col("file_path") != path), "files": files.filter(F.col("path") != path)}
        for name, df in out.items():
            self.write(name, df)

    def reset(self) -> None:
        for name in SCHEMAS:
            self.write(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def set_metadata(self, key: str, value: str) -> None:
        self.upsert("index_metadata", self.spark.createDataFrame([(key, value)], "key string, value string").withColumn("at", F.current_timestamp()))

    def is_legacy(self) -> bool:
        """Whether the index is of an older schema; versions compare by their numbers."""
        row = self.read("index_metadata").filter("key = 'schema_version'").select("value").first()
        number = lambda v: tuple(int(x) for x in v.split("."))
        return row is None or number(row[0]) < number(SCHEMA_VERSION)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a given schema; fields that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """run_id and the phases of all telemetry files that match."""
    x = spark.read.schema("run_id string, phases map<string, map<string, double>>").option("multiLine", True).json(pattern)
    return x.select("run_id", F.explode_outer("phases").alias("phase", "measures"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
