"""The queries of this package: (spark, folder of the tables) to a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from salesmart.llm import (
    ann, bpe, conversations, decontaminate, extract, katz, neardup, pii, quality, spelling, substrings,
    tokenfiles, urls)
from salesmart.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), *urls.default_rules(spark))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), path, end_id=0)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_sketched_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), size=20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {query.__name__: query for query in [
    op1_bpe, op2_quality, op3_url_filter, op4_html_text, op5_pii, op6_token_files,
    op7_multi_index, op8_decontaminate, op9_minmax_dedup, op10_katz, op11_turn_repair,
    op12_sketched_repeats, op13_spelling_variants]}

ORACLES: dict[str, str] = {
    "op3_url_filter": urls.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_minmax_dedup": neardup.ORACLE,
    "op11_turn_repair": conversations.ORACLE,
    "op12_sketched_repeats": substrings.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
