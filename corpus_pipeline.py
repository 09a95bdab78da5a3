"""The corpus pipeline: quality classifier, near-dedup, substring dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. What a
stage returns is written and read again before the next one starts.

Defined results: rows with null doc_id or null text pass every stage (they are linked with nothing and lose no words) but
mixing, which takes them by their source's rate; of rows equal in doc_id and text near-dedup leaves one; an empty table
gives no pieces; further columns are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import importance, mixing, near_dedup, packing, substring
from orrery.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling rejects."""
    return importance.keep_quality(docs, importance.good_labels(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, with the least id, of each group at similarity 0.8 of 5-word shingles."""
    return near_dedup.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the 13-word windows that documents with smaller ids have."""
    return substring.dedup_substrings(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("source mixing", mixture),
    ("packing", packed),
]

#: Tokenizer ids and signatures are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
