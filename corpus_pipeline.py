"""From documents to packed training sequences, by five of the operators in `platewise.llm`.

Each stage takes what the one before has written, as a DataFrame with the columns of
documents, and works on all of it. Where a stage cuts texts, `n_chars` follows. The last
stage returns one row per piece of a document with its place in a sequence.

Nulls, empty texts, ties and repeated rows fare as the operators' docstrings say: a text
that is null or has no letter is rejected by the classifier; of repeated rows one stays; a
text that dedup leaves empty is still packed, as its end token. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import line_dedup, minhash, packing, suffixes, weak_labels
from platewise.llm.catalog import VOCABULARY, table
from platewise.llm.scratch import stored


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer keeps; it learns from the labels beside the documents."""
    return weak_labels.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go from all of them."""
    return _recounted(line_dedup.without_shared_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.one_of_each(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand anywhere else go."""
    return _recounted(suffixes.without_repeats(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.packed(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The stages are not expressible in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
