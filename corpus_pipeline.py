"""A training corpus in five stages: quality, near copies, repeated strings, source weights, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns
of documents. The n-gram Jaccard stage takes five words and a similarity of 0.8.

Defined results, for every stage: a null or empty text has no bytes, words or ids (the classifier scores it as any other text, no copy of
anything, nothing to strip, size 0, no ids); very long texts are worked on whole; similarities at the bound are links, scores at 0.5 are
kept, equal mixing keys are taken in the order of doc_id and size; rows that repeat each other are copies, of which one stays; rows of null
or repeated doc_ids take part by their texts; an empty table goes through as an empty table. Further columns are kept by all stages,
whatever their names, but for `token_ids`, which the last stage replaces, and names that start with `__keyprune_`, which are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyprune.llm import bpe, jaccard, mixing, quality, suffixes
from keyprune.llm.common import read, stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it learns from the labelled ones among docs."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.strip(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding", encoded),
]

#: A trained network and a tokenizer cannot be said in SQL. tests/llm/test_pipeline.py holds run()'s rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
