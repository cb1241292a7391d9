"""Documents to token ids in five stages; each stage's rows are written before the next one reads them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.llm import bag_minhash, byte_bpe, decontamination, line_chunks, line_crf
from covermetrics.llm.rows import written

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAST_QUALITY = 0.3


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they now are."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores under the limit go."""
    model = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score(docs, model, out="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut out wherever they are not the first; every document stays."""
    return _resized(line_chunks.dedup_lines(docs, n_lines="__n_lines", n_removed="__n_removed").drop("__n_lines", "__n_removed"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return bag_minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others."""
    return _resized(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the whole text and the bytes they decode to."""
    path = public_tokenizers.path(RANKS)
    return byte_bpe.encode_and_decode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality classifier", quality_classifier), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination), ("byte-level BPE encoding and decoding", byte_level_bpe)]
ORACLE_SQL = None  # the stages are not expressible in SQL; tests/llm compares them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs, "stage")
    return docs
