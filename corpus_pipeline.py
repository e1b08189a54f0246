"""A corpus made ready for training: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  run() writes what a stage returns to
the shared checkpoint folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontaminate, language_id, near_dedup, toxicity
from tallyspark.llm.common import can_cut, table
from tallyspark.llm.queries import sentencepiece_digests


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3, all columns; labels are those of the labels table.

    Null and empty texts have the score of the bias alone and stay; repeated
    rows are scored alike; without labels, and on an empty table, nothing goes.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of a language of docs, all columns.

    Null texts and texts without a letter go, and so does every document where
    none has a language to learn from; a tie is near both and stays.
    """
    return language_id.keep_known_languages(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of similarity 0.8 or more (five-word shingles) make, all columns.

    Null texts and texts without words are one group; of rows with the same
    smallest id the one with the smallest digest, then the smallest row, stays.
    """
    return near_dedup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands, all columns; null texts and texts without words stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the text they decode to, a row for each document; null texts have no tokens."""
    return sentencepiece_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Trained and learned stages have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; an empty table gives no rows, extra columns travel up to the last stage."""
    can_cut(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
