"""The queries of this folder's operators over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bytebpe, caps, classifier, minhash, packing, quotes, rules, substring, tokenfile, warc
from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op1").path("tokens")
    tokenfile.write_token_files(_read(spark, sf_dir, "documents"), folder, bytebpe.default_path())
    return tokenfile.read_token_files(spark, folder)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), bytebpe.default_path())


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), bpe.default_path(), digests=True)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op6").path("warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measure(_read(spark, sf_dir, "documents"))


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_read(spark, sf_dir, "conversations"))


def op10_vector_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_packing, op3_word_bpe, op4_minhash, op5_substring_dedup, op6_warc, op7_quality_classifier, op8_quality_rules, op9_quotation_links, op10_vector_caps)}

SQL: dict[str, str] = {"op4_minhash": minhash.SQL, "op5_substring_dedup": substring.SQL, "op6_warc": warc.SQL, "op8_quality_rules": rules.sql(), "op9_quotation_links": quotes.SQL, "op10_vector_caps": caps.SQL}
