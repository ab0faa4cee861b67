"""The production queries, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import crc_mod, table
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .katz import katz_scores
from .language import identify_language, language_profiles
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .oracles import ORACLES
from .personal_data import span_digests
from .pieces import encode_digests
from .quality import quality
from .toxicity import learn_toxicity, score_toxicity


def piece_model() -> str:
    """The public vocabulary file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return score_toxicity(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, similarity=(9, 10))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), piece_model())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_profiles(docs, crc_mod("doc_id", 4) != 2)
    return identify_language(docs, profiles).withColumn("held_out", crc_mod("doc_id", 4) == 2)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_katz": op2_katz,
    "op3_personal_data": op3_personal_data,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_pieces": op7_pieces,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_html": op10_html,
}

__all__ = ["ORACLES", "QUERIES"]
