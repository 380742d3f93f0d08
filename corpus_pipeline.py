"""A training-data pipeline over `documents`: STAGES in order, each written as Parquet and read again by the next.

Labels are those of the query's folds. Every stage but the last returns the columns of documents.

Defined results, in every stage: null and empty texts are empty; texts are read whole; repeated rows are rows of their own (exact copies, of which the third stage
keeps one); null ids, languages and sources are carried as they are; further columns are carried along, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm import bpe, dedup, mixing, quality, toxicity
from partwise.llm.common import put_back, remainder, set_aside, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of 0.7 or more stay."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    space = quality.learn(table(spark, sf_dir, "documents", "doc_id", "text"), labels, remainder("doc_id", 4) != 2)
    own, names = set_aside(docs, "text")
    return put_back(quality.score(own, space, tuple(own.columns)).where("score >= 0.7"), names)


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score under 0.5 stay."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    grammar = toxicity.learn(table(spark, sf_dir, "documents", "doc_id", "text"), labels, remainder("doc_id", 5) != 0)
    own, names = set_aside(docs, "text")
    return put_back(toxicity.score(own, grammar, tuple(own.columns)).where("score < 0.5"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    own, names = set_aside(docs, "doc_id", "text")
    return put_back(dedup.near_duplicates(own).where("kept"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, with as many copies of a row as its source's target weight asks for."""
    own, names = set_aside(docs, "source")
    return put_back(mixing.mixed(own), names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify_quality),
    ("toxicity", filter_toxicity),
    ("near duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("byte-level BPE", tokenize),
]
#: Trained models and iterated components can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
