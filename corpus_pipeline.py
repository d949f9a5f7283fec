"""The corpus pipeline: quality, line dedup, near-dedup, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again. All but the last return the columns of documents.

Defined results: null and empty texts pass the quality stage (there is nothing to judge), are one class of copies, and count no words, so that the mix takes none
of them; null ids, languages and sources are values like any other; rows that repeat an id are judged by their texts, and stay together in the
quality stage if one of them stays; a line that many sites hold stays where it occurs first; very long texts go through whole; an empty table gives an empty result; extra
columns of documents are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, lines, mixing, neardup, quality
from spanloom.runtime import table, write_once


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def strip_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.strip(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every copy that the mix holds."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", reject_low_quality), ("line dedup", strip_boilerplate_lines), ("minhash near-dedup", drop_near_duplicates), ("mixing sources", mix_sources), ("byte-level bpe", encode_bytes),
]

#: No SQL: perplexities, hashed sampling and byte-pair merges have none. tests/llm/test_pipeline.py has the brute-force check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
