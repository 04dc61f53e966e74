"""A corpus pipeline over `documents`: language, near copies, repeated passages, test items, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents. The names below import without a guard: a missing operator is an error here.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm import crf_language, decontamination, near_copies, packing, substring
from crateflow.llm.common import stored

#: A text is rejected if no language is determined or the best has less than this share of its words' posteriors.
LEAST_LANGUAGE = 0.3
#: Least share of a perfect alignment with a test item.
LEAST_LEAK = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; all languages stay."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return crf_language.keep_known(docs, crf_language.learn(docs, F.coalesce(fold, F.lit(0)) != 2), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near copies (0.8 of the five-word shingles or more)."""
    return near_copies.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them."""
    return substring.cut_repeats(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, edited or not."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=LEAST_LEAK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


test_items.__test__ = False

STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substring", repeated_passages), ("decontamination", test_items), ("packing", pack)]

#: Language, near copies and alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
