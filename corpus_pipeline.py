"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor left and returns them with
the same columns; the last returns packed pieces.  Stages hand over Parquet in
the folder that all executors share, so a lost executor costs at most a stage.

Cases at the edge, in all stages: rows with a null text or id go through (a
null text is scored, packed and searched as an empty one, and is no copy of
anything); empty and very long texts are whole documents like any other; ties
go to the smaller id; repeated rows are kept or dropped alike, but for the near
duplicates, where one of them stays; an empty table gives no rows; columns
beyond those of ``documents``, whatever their names, go along up to the last
stage.  Without labels to learn from the two classifying stages drop nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import neardup, packing, quality, secrets, toxicity
from tidemark.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go (a text without known words stays); the index learns from the labelled rows of ``documents``."""
    return toxicity.kept(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade is under one half go; learns like ``drop_toxic``.  Empty texts get what the thresholds say."""
    return quality.kept(docs, quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near-duplicates (five-word shingles, similarity 0.8); empty texts and null ids stay, different texts of one id are judged each."""
    return neardup.kept(docs, width=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and ``n_chars`` counted anew; all documents stay, null texts null."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place; an empty text is one piece, its end mark; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near-duplicates", one_of_each),
    ("secrets", hide_secrets),
    ("packing", pack),
]
#: Fitted models and tokenizers cannot be told in SQL; tests hold the stages against plain Python over the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
