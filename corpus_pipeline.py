"""A corpus from raw documents to batches: each stage's table is written and read again as the next one's documents.

Every stage but the last returns the columns it was given, whatever their names, and works on all rows it was given. Null columns
are carried along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagmill.llm import exactdedup, mixture, packing, partenum, toxicity
from tagmill.llm.common import stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 go.

    Null, empty and blank texts score as texts without evidence; repeated rows and rows without a doc_id are judged by
    their text; very long texts are read whole. Without labels of both classes nothing is toxic.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays.

    Null and empty texts are equal. A null doc_id comes last; of rows that repeat doc_id and text one stays, the same in every run.
    """
    return exactdedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five words the smallest doc_id stays.

    Texts without words and rows without a doc_id stay. Rows that repeat a doc_id stay or go together.
    """
    return partenum.keep_one_of_each(docs, 5, 80, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words have no share of the mix and go. A null source is one of its own. Repeated rows share their places.
    """
    return mixture.mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and place of each row.

    Repeated rows are packed each; null and empty texts have length 0; a text beyond the token budget is a batch alone.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: SQL can't express the toxicity model or the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The tables between stages stay in the shared folder, as what a rerun or an audit reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
