"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing and byte-level BPE, over whole documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import bpe, line_dedup, mixing, ngram_join, quality
from sentrylake.llm.shared import Shared

#: Word shingles and similarity (percent) of the near-duplicate stage.
SHINGLE, SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality.filter_quality(docs, "v1")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; a document without any text left goes. n_chars follows."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    out = line_dedup.dedup_table(packed)
    dropped = F.col("n_dropped") > 0
    text = F.when(dropped, F.col("kept_text")).otherwise(F.col("text"))
    gone = dropped & (F.length(F.trim(F.col("kept_text"), F.lit(line_dedup.SPACE))) == 0)
    chars = F.when(dropped, F.length(text).cast("long")).otherwise(F.col("_row.n_chars").cast("long"))
    row = F.struct(*[{"text": text, "n_chars": chars}.get(c, F.col("_row").getField(c)).alias(c) for c in names])
    # a generator, so that the lines are put together once and not again in a filter
    return out.select(F.inline(F.when(gone, F.slice(F.array(row), 1, 0)).otherwise(F.array(row))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest doc_id."""
    groups = ngram_join.join(docs, size=SHINGLE, percent=SIMILAR)
    later = groups.filter("doc_id <> component_id").select("doc_id")
    later = Shared(spark, "later").save(later, "later")
    # dealt by doc_id at every size, as in the join itself
    names = docs.columns
    packed = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return packed.join(later.hint("merge"), "doc_id", "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in names])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights of sources, languages and topics; documents of rare cells are repeated."""
    return mixing.sample(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_table(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), digests=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bpe),
]
#: SQL has no byte-pair encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    shared = Shared(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
