"""Queries of this subpackage: each applies one operator to its whole table and shapes the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import bigru_langid, entropy_mix, html_extract, license_scan, ogg_media, packing, prefix_trie, rindex_dedup, setsketch, source_divergence, swap_packing, token_counts, weak_supervision


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_supervision.judge(table(spark, sf_dir, "documents"))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.read_features(ogg_media.store(table(spark, sf_dir, "documents")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.decisions(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bigru_langid.with_split(table(spark, sf_dir, "documents"))
    net = bigru_langid.train(docs.where("not held_out and lang is not null").select("text", "lang"))
    return bigru_langid.predict(docs.select("doc_id", "text", "held_out"), net)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents")).select(*source_divergence.RESULT)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations")).select(*prefix_trie.NODE)


def op13_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan.duckdb_sql(),
        "op11_divergence_audit": source_divergence.duckdb_sql(),
        "op12_prefix_trie": prefix_trie.duckdb_sql(),
    }
