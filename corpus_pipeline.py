"""A corpus pipeline of five stages over `documents`: each stage's result is written as Parquet and read again as the
next one's input. Every stage but the last returns the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, exact_dedup, minhash, mixing, toxicity
from textloom.llm.common import documents, drop_written, scratch, written


#: Near copies have so many per cent of their shingles in common, or more.
NEAR = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op 6 does not predict toxic. Null and empty texts are clean; repeated rows share their fate; with an empty
    table, or labels of one class, all stay."""
    return toxicity.keep_clean(docs, sf_dir)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id, nulls last; null and empty texts are equal; of
    repeated rows one stays."""
    return exact_dedup.keep_one(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id, nulls last; texts without words all stay; of
    repeated rows one stays."""
    return minhash.keep_one(docs, percent=NEAR)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never: sources come to target shares. A null source is a source;
    null and empty texts have size 0; repeated rows are documents of their own."""
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row; null and empty texts have none."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", one_of_equal),
    ("MinHash near-dedup", one_of_near),
    ("mixing sources to target weights", in_proportion),
    ("byte-level BPE encoding and decoding", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark) as keep:
            before, docs = docs, keep(written(stage(spark, docs, sf_dir), f"pipeline-{i}"))
        drop_written(before)  # the source table is none of ours and stays
    return docs


#: A trained classifier and a tokenizer are not SQL.
ORACLE_SQL = None
