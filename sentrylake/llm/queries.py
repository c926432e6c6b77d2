"""The registered query of each operator, and its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, filter_audit, langid, line_dedup, lm, merkle, mixing, ngram_join, quality, substring, token_counts, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(by: int):
    """crc32 of doc_id's decimal text modulo ``by``; null ids give -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by, F.lit(-1))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(_docs(spark, sf_dir)), "v1")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_docs(spark, sf_dir), size=4, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_table(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_table(_docs(spark, sf_dir), path, public_tokenizers.PATTERN, digests=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_docs(spark, sf_dir))
    return out.select("doc_id", *[F.col(f"_{a}").alias(a) for a in mixing.AXES], "n_tokens", *[F.round(c, 9).alias(c) for c in ("weight", "p", "expected")], "copies", "sampled")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_table(_docs(spark, sf_dir).select("doc_id", "text"), remainder(10) == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    trees = langid.train(docs, remainder(4) != 2)
    held = docs.select("doc_id", "text", (remainder(4) == 2).alias("held_out"))
    return langid.predict(held, trees, keep=("doc_id", "held_out"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_table(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.col("n_chars").cast("decimal(20,0)") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    out = merkle.verify(merkle.manifest(_docs(spark, sf_dir), tampered={"n_chars": tampered}))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.steps(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {"op1_quality_rules": quality.SQL, "op3_line_dedup": line_dedup.SQL, "op5_mixing": mixing.SQL, "op7_warc": warc.SQL, "op12_merkle_manifest": merkle.SQL, "op13_filter_audit": filter_audit.SQL}
