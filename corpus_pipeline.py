"""From documents to packed training sequences: five stages over the whole table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``; the last returns one row for each piece of the packed sequences.

Every stage keeps columns that it does not know, whatever their names, and takes null, empty and very
long texts, null and repeated ids, repeated rows and empty tables; what it does with them stands below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from likeness.llm._common import documents, stored
from likeness.llm.decontamination import drop_contaminated
from likeness.llm.line_dedup import drop_repeated_lines
from likeness.llm.near_dedup import drop_near_duplicates
from likeness.llm.packing import best_fit_packing
from likeness.llm.quality_classifier import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Texts without words get the score of the model's bias, so they stay or go together. Repeated rows
    are judged alike. Without labels of both classes all documents stay or go by the share of label 1.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more have.

    No document goes: one that loses all its lines keeps an empty text, a null text stays null. Every
    row counts as a document, repeated ones too.
    """
    return drop_repeated_lines(docs, threshold=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id, a null id first.

    Documents without words are no duplicates of each other and all stay; of repeated rows one stays.
    """
    return drop_near_duplicates(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null and empty texts hold none. Items without words or with null text match nothing; without items
    all documents stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 4096 tokens.

    A null or empty text is its end id alone. Rows are packed one by one, whatever their ids.
    """
    return best_fit_packing(docs, capacity=4096, end_id=1)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: A trained classifier and a tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
