"""Windowed measures of an append-only event table, as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Of each event type and window of time: rows, sum and mean of value. Rows later than `late` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def append_metrics(records: DataFrame, path: str) -> None:
    """Add records to a JSON-lines table."""
    records.write.mode("append").json(path)


def windowed_metrics(spark: SparkSession, path: str) -> DataFrame:
    """event_counts() of all that lies at path now, read as a stream and written, window by
    window as each is closed, to a table; the result is that table.

    The last windows stay open, since no later event closes them."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").format("parquet")
    source = stream.load(path) if not name.endswith(".parquet") or _is_folder(spark, path) else stream.option("pathGlobFilter", name).load(folder)
    out = _folder(spark)
    counts = event_counts(source)
    query = counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
