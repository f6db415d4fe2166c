"""A training-data pipeline over ``documents``: each stage is one operator of ``ruleloom.llm``.

Rejected documents go, of equal texts the smallest ``doc_id`` stays, then of near copies; secrets in the remaining
texts are replaced, and what is left is packed into sequences. Every stage takes all that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import exact, packing, quality, secrets, simhash
from ruleloom.llm.catalogue import vocabulary
from ruleloom.llm.common import documents, labels, stored
from ruleloom.sources.scratch import mark, release, release_since


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the documents given."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the smallest ``doc_id`` stays."""
    return exact.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share about four fifths of their five-word shingles the smallest ``doc_id`` stays."""
    return simhash.representatives(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and ``n_chars`` follows."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: A trained model decides in the first stage, which SQL cannot express; tests/llm compares run() with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each reading what the one before wrote to the shared folder.

    When a stage's result is written, its input and whatever else it wrote are deleted."""
    docs = documents(spark, sf_dir)
    for position, (_, stage) in enumerate(STAGES):
        before, last = mark(), docs
        docs = stage(spark, last, sf_dir)
        if position < len(STAGES) - 1:
            docs = stored(docs)
            release(last)
            release_since(before, docs)
    return docs
