"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm import crf_language, decontamination, html_text, licenses, media, oracles, packing, ppm, prefix_trie, quality_cnn, simhash, spelling, substring, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=0.5)


def _fold(name: str, folds: int):
    """crc32 of an id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(folds))


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = crf_language.learn(docs, _fold("doc_id", 4) != 2)
    found = crf_language.predict(docs, model)
    return found.select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_cnn.learn(docs, _table(spark, sf_dir, "labels"), _fold("i", 5) != 0)
    found = quality_cnn.predict(docs, model)
    predicted = (F.col("score") >= quality_cnn.GOOD).cast("int")
    return found.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), misspell=97)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))
    own = F.col("conv_id")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns, own - own % 20, _fold("conv_id", 4), most=3))


def op13_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"), _fold("doc_id", 10) == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_token_files, op3_html_text, op4_licenses, op5_media, op6_simhash, op7_substring, op8_decontamination,
        op9_crf_language, op10_quality_cnn, op11_spelling, op12_prefix_trie, op13_ppm,
    )
}
ORACLES: dict[str, str] = {"op7_substring": oracles.SUBSTRING, "op11_spelling": oracles.SPELLING, "op12_prefix_trie": oracles.PREFIX_TRIE}
