"""Registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, negatives, topk, urlfilter
from .common import scratch_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_checksums, write_store

    path = scratch_path(spark, "token_store")
    write_store(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return read_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "root")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmlextract import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicated, digests, kept_text

    return deduplicated(table(spark, sf_dir, "documents")).select(*digests(), kept_text().alias("text"), "spans")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_of

    return language_of(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), negatives.relabelled())


QUERIES = {
    "op1_html": op1_html, "op2_token_store": op2_token_store, "op3_topk": op3_topk, "op4_bpe": op4_bpe, "op5_urls": op5_urls, "op6_jaccard": op6_jaccard, "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination, "op9_substrings": op9_substrings, "op10_language": op10_language, "op11_centroids": op11_centroids, "op12_fingerprints": op12_fingerprints,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {"op3_topk": topk.oracle(), "op5_urls": urlfilter.oracle(), "op11_centroids": centroids.oracle(), "op13_negatives": negatives.oracle()}
