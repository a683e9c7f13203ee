"""Registered queries of the text operators, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitefold.llm import (
    bpe,
    collocations,
    decontaminate,
    exact_dedup,
    licenses,
    ngram_join,
    oracle,
    quality,
    secrets,
    substring_dedup,
    token_counts,
    token_output,
    vector_codes,
    vector_links,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op2_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
        "live_spans",
        "n_live",
        "n_example",
        "owners",
        "repositories",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), exact_dedup.new_index(spark))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_output.write_and_read(_table(spark, sf_dir, "documents"), vocabulary)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), pieces)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), whole_texts=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.vector_links(_table(spark, sf_dir, "embeddings"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join,
            op2_bpe_merge_replay,
            op3_secret_scan,
            op4_exact_dedup,
            op5_token_output,
            op6_token_counts,
            op7_decontamination,
            op8_substring_dedup,
            op9_license_scan,
            op10_quality_classifier,
            op11_vector_codes,
            op12_collocations,
            op13_embedding_links,
        )
    }


def statements() -> dict[str, str]:
    return oracle.statements()
