"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a folder in the session's warehouse,
    which executors share too. The setting itself is left as it is."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return (at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged").rstrip("/")
