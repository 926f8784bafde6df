"""Scores of the structure of an answer, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import portable

# What marks a step, a contrast and a reference.
STEP = "step\\s*\\d|(?m:^\\s*\\d+[.):])|\\bfirst\\b|\\bthen\\b|\\bnext\\b|\\bfinally\\b|->|==>"
CONTRAST = "\\b(?:however|whereas|in contrast|on the other hand|unlike|while|but|alternatively|advantage|disadvantage|pro|con|tradeoff|trade.off|better|worse|faster|slower|compared to|difference|similar|distinct)\\b"


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(portable(f"({pattern})")), F.lit(1)))


def step_score(answer: Column, query_type: Column) -> Column:
    """1 unless steps are asked for; then by the number of step markers."""
    n = _count(answer, STEP)
    return F.when(query_type != "trace", 1.0).when(n >= 5, 1.0).when(n >= 3, 0.7).when(n >= 1, 0.4).otherwise(0.1)


def contrast_score(answer: Column, query_type: Column) -> Column:
    n = _count(answer, CONTRAST)
    return F.when(query_type != "comparison", 1.0).when(n >= 6, 1.0).when(n >= 3, 0.7).when(n >= 1, 0.4).otherwise(0.1)


def coverage(wanted: Column, said: Column) -> Column:
    """Share of the wanted items that were said; 1 if none is wanted."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, said)) / n)
