"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rainloom.llm import importance, leaks, mixing, neardup, negatives, passages, pieces, pii, quality, secrets, tokens, urls, warc
from rainloom.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the surrogates; a deployment sets its own.
KEY = b"rainloom"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, marks=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents")).drop("part")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_documents(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_key")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_warc_archive, op3_token_counts, op4_pii_surrogates, op5_mixing, op6_substring_dedup, op7_decontamination, op8_url_filter, op9_near_duplicates, op10_secret_scan, op11_importance_resampling, op12_piece_encoding, op13_hard_negatives)
}
ORACLES = {"op2_warc_archive": warc.REPORT_SQL, "op11_importance_resampling": importance.SQL, "op13_hard_negatives": negatives.SQL}
