"""The corpus pipeline: quality rules, quality classifier, near-dedup, substring dedup, packing.

Every stage takes documents with any further columns and, but for the last, gives rows of the same columns.  Null texts
count as empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bytebpe, classifier, minhash, packing, rules, substring
from quirefold.llm.common import Scratch


def _set_aside(docs: DataFrame) -> DataFrame:
    """The text, and a struct of the other columns, whatever their names are."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that a rule rejects go (null, empty and very short ones among them); the others stay row for row."""
    return _as_before(rules.judge(_set_aside(docs)).where("kept"), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents that are still here; texts predicted 0 go.  Without a label nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _as_before(classifier.score(_set_aside(docs), classifier.fit(docs, labels)).where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least id, with all its rows.  Rows without an id or words stay."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a smaller document holds too go, and n_chars follows; all rows stay, empty ones as well."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    cut = substring.remove_repeats(docs, texts_too=True, carry=tuple(c for c in docs.columns if c not in own))
    return cut.select(*[(own[c] if c in own else F.col("carried")[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces instead of documents: every row has at least the piece of its end id, also with a null text or id."""
    return packing.pack(docs, bytebpe.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

#: Packing and the classifier are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is written, read by the next one and then deleted."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
