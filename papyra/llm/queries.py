"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.llm import bpe, chat, fingerprints, hard_negatives, licenses, near_dup, packing, pii, quality, resampling, token_counts, toxicity, url_filter
from papyra.llm.common import table
from papyra.sources.library import spread


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.with_probe(table(spark, sf_dir, "conversations"))).drop("n_tokens", "n_loss_tokens")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def pii_secret(spark: SparkSession) -> str:
    """What the session names; without that a published one, good for the invented persons of the test tables only."""
    return spark.conf.get("spark.papyra.pii.secret", "of the invented tables")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), pii_secret(spark), counts="kinds")


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spread(table(spark, sf_dir, "documents")), keep=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(spread(docs), frequent=token_counts.frequent_pretokens(token_counts.some_files(docs)))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_chat_formatting, op3_best_fit_packing, op4_minhash_near_dedup, op5_pii, op6_bpe_encoding, op7_quality_rules, op8_license_scans, op9_token_counts, op10_url_filters, op11_hard_negatives, op12_importance_resampling, op13_toxicity)}

ORACLES: dict[str, str] = {"op2_chat_formatting": chat.sql(), "op7_quality_rules": quality.sql(), "op8_license_scans": licenses.sql(), "op10_url_filters": url_filter.sql(), "op11_hard_negatives": hard_negatives.sql(), "op12_importance_resampling": resampling.sql()}
