"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination
and tokenising, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the columns of
docs; extra columns stay. A null or empty text is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm._common import stage
from sievestone.llm.decontamination import decontaminate
from sievestone.llm.language_id import UNKNOWN, language_id
from sievestone.llm.minhash import near_groups
from sievestone.llm.queries import VOCABULARY
from sievestone.llm.sentencepiece_codec import load_vocabulary, tokenize
from sievestone.llm.suffix_dedup import suffix_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found: those without any letter go."""
    return language_id(docs).filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles alike to 0.8 or more) the
    document of the smallest id."""
    groups = near_groups(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = groups.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what repeats an earlier 100-byte string; n_chars follows."""
    out = suffix_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited a little."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).filter(~F.col("leaked")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, decoded_same and ids of each document."""
    out = tokenize(docs.select("doc_id", "text"), load_vocabulary(VOCABULARY), keep_text=False)
    return out.select("doc_id", "n_tokens", "decoded_same", "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_substrings),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: No stage can be expressed in SQL: each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
