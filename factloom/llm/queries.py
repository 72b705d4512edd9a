"""Queries of the training-data operators, each over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import read_table
from .collocations import collocations, collocations_sql
from .exact import EXACT_SQL, exact_duplicates
from .imatch import fingerprint_documents
from .jaccard import near_duplicates, near_duplicates_sql
from .licenses import scan_documents, scan_sql
from .media import media_documents
from .mixing import mixing_table
from .packing import pack_documents
from .quality import score_quality
from .sharding import shard_documents
from .suffix import PASSAGE, remove_repeats, remove_repeats_sql
from .toxicity import score_toxicity
from .whitening import whitened_embeddings


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), passage=PASSAGE)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_documents(read_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(read_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_imatch_fingerprints, op2_license_scan, op3_sharding, op4_best_fit_packing, op5_suffix_array_dedup, op6_toxicity, op7_quality_classifier, op8_mixing, op9_media_columns, op10_ngram_jaccard_join, op11_exact_dedup, op12_embedding_whitening, op13_phrase_collocations)
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op2_license_scan": scan_sql(),
    "op5_suffix_array_dedup": remove_repeats_sql(),
    "op10_ngram_jaccard_join": near_duplicates_sql(),
    "op11_exact_dedup": EXACT_SQL,
    "op13_phrase_collocations": collocations_sql(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
