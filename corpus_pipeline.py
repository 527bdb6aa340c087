"""The corpus pipeline: every stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trovespark.llm.common import labels, new_scratch
from trovespark.llm.language_id import keep_identified
from trovespark.llm.language_id import train as train_language
from trovespark.llm.mixing import mixed
from trovespark.llm.near_copies import one_of_each
from trovespark.llm.packing import pack_documents
from trovespark.llm.queries import tokenizer_path
from trovespark.llm.toxicity import keep_clean
from trovespark.llm.toxicity import train as train_toxicity

#: Scores run from 0 to 1; text that shares nothing with the learned languages scores 0.5.
LEAST_LANGUAGE, TOXIC = 0.25, 0.7
#: What tells unknown text: the top score stands out little from the mean of the languages, or the landmarks hold few of its n-grams.
#: Of held-out rows of the local tables all have 0.79 of their n-grams met, and all but a few of one word stand out by 0.13.
LEAST_MARGIN, LEAST_MET = 0.13, 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that no learned language claims, go."""
    return keep_identified(docs, train_language(docs), LEAST_LANGUAGE, LEAST_MARGIN, LEAST_MET)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which any window scores as toxic go."""
    return keep_clean(docs, train_toxicity(docs, labels(spark, sf_dir)), TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more one document stays, the one with the smallest doc_id."""
    return one_of_each(docs, words=5, least=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the result as often as the mix takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL can't express the trained stages; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
