"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quilter.llm import bpe, decontaminate, html_text, langid, ngram_join, pii, sharding, spotsig, suffix_dedup, url_filter
from quilter.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsig.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN, with_ids=False)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_html_text": op7_html_text,
    "op8_language": op8_language,
    "op9_ngram_join": op9_ngram_join,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: The others (trained models, code-point scans, components) are tested against brute force.
ORACLES: dict[str, str] = {"op1_sharding": sharding.oracle()}
