"""Documents: chunks, keyword and ranked search, vectors, catalogue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.numbers import hash_bucket, mean, rounded
from covermetrics.functions.strings import token_estimate
from covermetrics.operators.relational import all_of, latest_per_key, top_k_per_group
from covermetrics.operators.topk import TopK
from covermetrics.operators.vector_index import VectorIndex, unit
from covermetrics.session import scratch_path

# Window starts in percent of the text, and window length in characters.
WINDOW_STARTS = (0, 15, 30, 50, 70, 85)
WINDOW_CHARS = 600


def chunk_windows(docs: DataFrame, key: str = "document_id", text: str = "content") -> DataFrame:
    """Six overlapping windows at fixed fractions of the text; they may leave gaps."""
    n = F.length(text)
    windows = []
    for i, pct in enumerate(WINDOW_STARTS, 1):
        offset = F.expr(f"length({text}) * {pct} div 100").cast("int")
        start = F.lit(1) if i == 1 else F.greatest(F.lit(1), offset)
        size = F.least(F.lit(WINDOW_CHARS), n) if i == 1 else F.least(F.lit(WINDOW_CHARS), n - offset + 1)
        windows.append(F.struct(F.lit(i).alias("i"), start.alias("s"), size.alias("z")))
    return docs.select(key, F.col(text).alias("_t"), F.explode(F.array(*windows)).alias("_w")).select(
        key, F.col("_w.i").alias("chunk_index"), F.substring(F.col("_t"), F.col("_w.s"), F.col("_w.z")).alias("chunk_text"),
        token_estimate(F.col("_w.z")).alias("token_count"))


def chunk_fixed(docs: DataFrame, size: int = 2000, overlap: int = 200, key: str = "document_id", text: str = "content") -> DataFrame:
    """Chunks of ``size`` characters that share ``overlap`` with their neighbour and cover the whole text."""
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - F.lit(size)) / F.lit(float(step))).cast("int"))
    numbered = docs.filter(n > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    chunk = F.substring(F.col("_t"), F.col("_k") * step + 1, F.lit(size))
    return numbered.select(key, (F.col("_k") + 1).alias("chunk_index"), chunk.alias("chunk_text"),
                           token_estimate(F.length(chunk)).alias("token_count"))


def keyword_search(docs: DataFrame, chunks: DataFrame, terms: str, k: int = 10, excerpt: int = 1000,
                   key: str = "document_id", text: str = "content", first_term_only: bool = False) -> DataFrame:
    """First k chunks that hold every search term (as written: the first one), with their document; if no chunk
    does, whole documents are searched instead."""
    wanted = terms.split()[:1] if first_term_only else terms.split()

    def holds(c: str) -> Column:
        return all_of(*[F.col(c).ilike(f"%{t.lower()}%") for t in wanted])
    found = chunks.filter(holds("chunk_text"))
    any_chunk = found.agg(F.count(F.lit(1))).scalar()
    by_chunk = found.select(key, "chunk_index", F.substring("chunk_text", 1, excerpt).alias("relevant_text"))
    by_text = docs.filter((any_chunk == 0) & holds(text)).select(
        key, F.lit(0).alias("chunk_index"), F.substring(text, 1, 2 * excerpt).alias("relevant_text"))
    best = by_chunk.unionByName(by_text).orderBy(key, "chunk_index").limit(k)
    return best.join(docs.drop(text), key)


def clause_count(docs: DataFrame, terms: Sequence[str], by: str, text: str = "content") -> DataFrame:
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("documents"),
                                *[F.count_if(F.col(text).ilike(f"%{t}%")).alias(f"mentions_{t}") for t in terms])


def _slices(pdf: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Row slices whose score matrix stays at a few million cells."""
    step = max(1, 4_000_000 // max(1, width))
    for i in range(0, len(pdf), step):
        yield pdf.iloc[i:i + step]


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 5, key: str = "vector_id", vector: str = "vector",
                  qkey: str = "query_id", qvector: str = "query_vector", block: int = 2048) -> DataFrame:
    """Exact cosine top k of each query vector.

    Up to ``block`` queries travel to the rows: each task scores its rows against all of them with one matrix product and
    keeps k rows per query, so only k rows per query and task are shuffled. More queries meet the rows in the cells of a
    `VectorIndex`, so that the corpus is not read again for every block. For repeated searches keep such an index.
    """
    few = queries.select(qkey, qvector).limit(block + 1).collect()  # block + 1 rows at most
    if len(few) > block:
        return VectorIndex(scratch_path(corpus.sparkSession, "vector-index"), key, vector).build(corpus).search(queries, k, qkey, qvector)
    out = _search_block(corpus.select(key, vector), few, k, key, vector, qkey, qvector, queries.schema[qkey].dataType.simpleString())
    return top_k_per_group(out, [qkey], [F.desc("score"), F.col(key)], k)


def _search_block(corpus: DataFrame, rows: list, k: int, key: str, vector: str, qkey: str, qvector: str, qkey_type: str) -> DataFrame:
    ids = np.array([r[qkey] for r in rows])
    q = unit(np.array([r[qvector] for r in rows], dtype=np.float64).reshape(len(rows), -1)).T

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = TopK(len(ids), k)
        for pdf in batches:
            for part in _slices(pdf, max(q.shape)):
                m = unit(np.stack(part[vector].to_numpy()).astype(np.float64))
                best.offer(np.round(m @ q, 6), np.array(part[key].tolist()))
        yield from best.frame(qkey, ids, key)
    return corpus.mapInPandas(score, f"{qkey} {qkey_type}, {key} {corpus.schema[key].dataType.simpleString()}, score double")


def document_stats(docs: DataFrame, chunks: DataFrame, by: str, key: str = "document_id") -> DataFrame:
    per_doc = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.sum("token_count").alias("t"))
    return docs.select(key, by).join(per_doc, key, "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"),
        rounded(F.sum("t").cast("double") / F.nullif(F.sum("c"), F.lit(0)), 0).alias("avg_tokens"))


def chunk_catalogue(chunks: DataFrame, docs: DataFrame, model: Column, key: str = "document_id", preview: int = 150) -> DataFrame:
    """chunk_id, key, chunk_index, chunk_preview, token_count, embedding_model: what the retrieval layer holds of each chunk.

    ``model`` names the model that embeds a document's chunks, from the columns of ``docs``.
    """
    models = docs.select(key, model.alias("embedding_model"))
    return chunks.join(models, key).select(
        F.concat_ws("-", F.lit("CHK"), F.col(key).cast("string"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"),
        key, "chunk_index", F.left("chunk_text", F.lit(preview)).alias("chunk_preview"), "token_count", "embedding_model")


def embedding_stats(catalogue: DataFrame) -> DataFrame:
    """Chunks, documents and mean tokens per embedding model."""
    return catalogue.groupBy("embedding_model").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"), mean("token_count", 0).alias("avg_tokens"))


def document_previews(docs: DataFrame, k: int = 10, key: str = "document_id", text: str = "content", preview: int = 200) -> DataFrame:
    """The first k documents with the beginnings of their texts."""
    return docs.withColumn(text, F.left(text, F.lit(preview))).withColumnRenamed(text, "content_preview").orderBy(key).limit(k)


def retrieval_log_stats(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Queries, mean and percentile response times, mean relevance."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), mean("response_ms", 1).alias("avg_ms"),
        F.percentile_approx("response_ms", 0.95, 100_000).cast("double").alias("p95_ms"), mean("relevance", 3).alias("avg_relevance"))


def document_master(docs: DataFrame, policies: DataFrame, default_state: int, key: str = "document_id") -> DataFrame:
    """Source system, filing state, approval date and form number of each document."""
    filed = latest_per_key(policies.select("policy_id", F.col("state_id").alias("filing_state_id")), ["policy_id"], ["filing_state_id"])
    joined = docs.join(filed, "policy_id", "left")
    bucket = hash_bucket(key, 3, "ss")
    system = F.when(bucket == 0, "PolicyAdmin").when(bucket == 1, "DocGen").otherwise("Legacy")
    days_before = (F.lit(30) + hash_bucket(key, 150, "ra")).cast("int")
    form = F.concat(F.lit("FM-"), F.upper(F.left("document_type", F.lit(3))), F.lit("-"), F.lpad(hash_bucket(key, 999, "fm").cast("string"), 3, "0"))
    return joined.select(
        key, "policy_id", "document_type", "effective_date", system.alias("source_system"),
        F.coalesce("filing_state_id", F.lit(default_state)).alias("filing_state_id"),
        F.date_sub("effective_date", days_before).alias("approval_date"), form.alias("form_number"))


def valid_at(docs: DataFrame, day: str, group: Sequence[str], version: str = "version") -> DataFrame:
    """The highest version of each document in force on a day."""
    d = F.lit(day).cast("date")
    live = docs.filter((F.col("effective_date") <= d) & (F.col("expiration_date").isNull() | (F.col("expiration_date") > d)))
    return latest_per_key(live, group, [version])
