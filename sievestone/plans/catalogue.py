"""All named queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context, diagnostics, evaluation, evidence, packing, relational, retrieval, textual


def _wide(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Counts and ranks come out as 64-bit integers, whatever function made them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])

    return run


_PARTS = (retrieval, textual, relational, evaluation, diagnostics, packing, evidence, context)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _wide(f) for p in _PARTS for n, f in p.QUERIES.items()}
ORACLE: dict[str, str] = {n: s for p in _PARTS for n, s in p.ORACLE.items()}
