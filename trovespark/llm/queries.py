"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovespark.llm import bit_sliced, hard_negatives, substring_dedup
from trovespark.llm.common import documents, labels
from trovespark.llm.language_id import language_of_documents
from trovespark.llm.licenses import scan_licences
from trovespark.llm.media import media_of_documents
from trovespark.llm.mixing import mix_documents
from trovespark.llm.near_dedup import near_duplicates
from trovespark.llm.packing import pack_documents
from trovespark.llm.sharding import shard_documents
from trovespark.llm.simhash import fingerprints_with_edits
from trovespark.llm.token_files import token_files
from trovespark.llm.toxicity import toxicity_of_documents


def tokenizer_path() -> str:
    """The file of the byte-level BPE; its place is the installed package's business."""
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=16)


def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path(), window=1024, end_id=0)


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir), shards=16)


def op4_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(documents(spark, sf_dir), folds=4, held_out=2, per_language=500)


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(documents(spark, sf_dir), radius=3, query_every=20)


def op6_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, radius=4)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), tokenizer_path(), end_id=0)


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_of_documents(documents(spark, sf_dir))


def op10_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of_documents(documents(spark, sf_dir), labels(spark, sf_dir), folds=3, held_out=1, threshold=0.7)


def op11_summa_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined_from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), anchor_every=100, noise_every=7, labels=10)


def op12_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(documents(spark, sf_dir), window=50).drop("kept")


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minimax_shards": op1_minimax_shards,
    "op2_bm25_packing": op2_bm25_packing,
    "op3_sainte_lague_mix": op3_sainte_lague_mix,
    "op4_string_kernel_language": op4_string_kernel_language,
    "op5_simhash_fingerprints": op5_simhash_fingerprints,
    "op6_licence_automaton": op6_licence_automaton,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_files": op8_token_files,
    "op9_jpeg_media": op9_jpeg_media,
    "op10_recurrent_toxicity": op10_recurrent_toxicity,
    "op11_summa_hard_negatives": op11_summa_hard_negatives,
    "op12_recompression_dedup": op12_recompression_dedup,
    "op13_bit_sliced_search": op13_bit_sliced_search,
}
ORACLES: dict[str, str] = {"op11_summa_hard_negatives": hard_negatives.SQL, "op12_recompression_dedup": substring_dedup.SQL, "op13_bit_sliced_search": bit_sliced.SQL}
