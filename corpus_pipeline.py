"""From raw documents to tokens in five stages, each written as Parquet and read again.

language: documents whose language is not determined go. near_duplicates: one document of
each group of near copies stays. decontaminate: documents that hold a benchmark item go. pii:
personal data in texts becomes placeholders. bpe: texts become ids.
All but the last keep the columns of ``documents`` (n_chars follows the text).

Defined results: documents of null or empty text, or without a letter, go with the first stage; an empty table runs
through; of near copies the one of the smallest id stays (a null id last, then by digest of the text), and of rows equal in id and text one;
no stage drops or renames columns of the user's; what a stage decides on a tie is said where its operator is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quilter.llm import bpe, decontaminate, langid, ngram_join, pii
from quilter.llm.common import Staged, table

#: Least mean probability of the best language for a document to stay.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, "doc_id", "text", "lang", LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs, "text", "n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_texts(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]

#: Trained models and byte-pair merges are beyond SQL: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    staged = Staged(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged.put(stage(spark, docs, sf_dir), name)
    return docs
