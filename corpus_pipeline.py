"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Nulls, empty texts, repeated rows and empty tables are handled as each stage's
operator defines; the stages keep every column of ``documents`` (the last one
returns pieces of packed sequences).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from complexa.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from complexa.llm.common import table, work_table
from complexa.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below the threshold."""
    _ready(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts."""
    _ready(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    _ready(spark)
    return ngram_join.ngram_dedup(docs, n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    _ready(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens."""
    _ready(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated), ("packing", pack),
]

#: A trained network and a tokeniser are stages: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
