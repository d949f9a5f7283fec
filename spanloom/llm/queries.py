"""The queries of the training-data operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, chat, langid, lines, media, mixing, neardup, phrases, private, quality, structure, topk, urls
from spanloom.runtime import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), quality.trusted_ids(table(spark, sf_dir, "labels")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.page_verdicts(table(spark, sf_dir, "pages"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.answer_pairs(table(spark, sf_dir, "conversations"))


def op6_preference_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.answer_turns(table(spark, sf_dir, "conversations"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.damaged_report(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.report(table(spark, sf_dir, "documents"))


QUERIES = [op1_quality_classifier, op2_byte_bpe, op3_language_id, op4_mix_sources, op5_url_filters, op6_preference_format, op6_preference_turns, op7_media_chunks, op8_line_dedup, op9_minhash_neardup, op10_exact_topk, op11_conversation_repair, op12_phrase_collocations, op13_personal_data]
ORACLES: dict[str, str] = {"op5_url_filters": urls.PAGES_SQL, "op6_preference_format": chat.PAIRS_SQL, "op6_preference_turns": chat.TURNS_SQL, "op8_line_dedup": lines.REPORT_SQL, "op10_exact_topk": topk.NEAREST_SQL, "op11_conversation_repair": structure.REPAIR_SQL, "op12_phrase_collocations": phrases.COLLOCATIONS_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
