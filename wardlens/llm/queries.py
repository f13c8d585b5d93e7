"""Registered queries of the language-model operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import (
    decontamination,
    fill_middle,
    jaccard_orders,
    merkle_manifest,
    mixing,
    outliers,
    phrase_automata,
    pii_feistel,
    secret_battery,
    suffix_buckets,
    token_counts,
    va_search,
    warc_chunks,
)

MIX_WEIGHTS = {
    "domain": {"d0": 1, "d1": 3, "d2": 2, "d3": 4},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}
MIX_SHARE = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read with Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_domain(source: str = "source") -> Column:
    """Domain of a source: its number modulo 4; null without a number."""
    number = F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) AS int)")
    return F.concat(F.lit("d"), F.pmod(number, F.lit(4)))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read for a mix of 0.6 of all tokens by domain, language and source weights."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, source_domain(), MIX_WEIGHTS, MIX_SHARE)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents: the best window of each document and item."""
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of every document."""
    return outliers.judge(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that start earlier."""
    return phrase_automata.remove_repeats(table(spark, sf_dir, "documents"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    return warc_chunks.round_trip(table(spark, sf_dir, "pages"))


def op6_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that start anywhere else."""
    return suffix_buckets.remove_repeats(table(spark, sf_dir, "documents"))


def op7_jaccard_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of near duplicates of every document."""
    return jaccard_orders.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data; the key is the session's, if it names one."""
    key = spark.conf.get("spark.wardlens.pseudonymKey", "registered query")
    return pii_feistel.replace_personal_data(table(spark, sf_dir, "documents"), key.encode())


def op9_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_battery.scan(table(spark, sf_dir, "documents"))


def op11_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    return va_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document; a third of them is tampered with and must fail."""
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle_manifest.manifest(merkle_manifest.leaves(table(spark, sf_dir, "documents"), tampered=third))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle order, and restored from it."""
    return fill_middle.digests(fill_middle.pieces(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of this package by name."""
    return {
        "op1_mixing": op1_mixing,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_phrase_automata": op4_phrase_automata,
        "op5_warc_chunks": op5_warc_chunks,
        "op6_suffix_buckets": op6_suffix_buckets,
        "op7_jaccard_orders": op7_jaccard_orders,
        "op8_pii_feistel": op8_pii_feistel,
        "op9_secret_battery": op9_secret_battery,
        "op10_quality_rules": op10_quality_rules,
        "op11_va_search": op11_va_search,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_fill_middle": op13_fill_middle,
    }
