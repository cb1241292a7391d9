"""Resampling towards a target distribution, with importance weights from hashed word n-grams.

A text is lower-cased (A-Z only), every run of separators becomes one space, and overlapped regex matches between word
boundaries give the byte span of each run of 1 to `longest` words, counted by its CRC. The weight of a text is the floored
mean, over its features, of the gain of their buckets: the log ratio, in thousandths, of the smoothed target and corpus
frequencies. Weight plus Gumbel noise from a hash of the id orders the texts, and the best of them are drawn.

Null and empty texts, and texts without words, have no features and weight 0. An empty target gives gains too, as all its
counts are 0 before smoothing. A null id hashes as ''. Every row counts as a document, so repeated rows are drawn apart,
with numbers of their own. An empty corpus gives no rows. Carried columns may have any name: they travel inside a struct.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from covermetrics.llm.rows import written
from covermetrics.operators.relational import number_in_order

SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONGEST = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7


def gram_patterns(longest: int) -> list[regex.Pattern]:
    """One pattern for each n: n words with a single space between them, not cut out of longer words."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, longest + 1)]


def gram_buckets(text: str | None, patterns: Sequence[regex.Pattern], buckets: int) -> list[np.ndarray]:
    """The buckets of the text's n-grams, one array for each pattern, in the order of the text."""
    # bytes.lower() changes A-Z alone, and no byte of a longer character is a separator.
    flat = SEPARATORS.sub(b" ", (text or "").encode().lower()).strip(b" ")
    crc = zlib.crc32
    return [np.fromiter((crc(m[0]) for m in p.finditer(flat, overlapped=True)), np.uint32) % buckets for p in patterns]


def features(docs: DataFrame, text: str = "text", carry: Sequence[str] = (), longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """row (the carried columns), n_words, and grams: the buckets of all features as little-endian 32-bit integers."""
    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("nothing"))
    source = docs.select(row.alias("row"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = gram_patterns(longest)
        for batch in batches:
            found = [gram_buckets(t.as_py(), patterns, buckets) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([len(g[0]) for g in found], pa.int64()),
                pa.array([np.concatenate(g).astype("<u4").tobytes() for g in found], pa.binary())], ["row", "n_words", "grams"])
    return source.mapInArrow(scan, StructType([source.schema["row"]]).add("n_words", "long").add("grams", "binary"))


def flat_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a column of grams and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]].copy().view("<u4"), np.diff(ends) // 4


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: each task adds up its own, so `buckets` sums at most reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(flat_grams(batch.column(0))[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    sums = featured.select("grams").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) for each of the B buckets, in doubles."""
    b, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", carry: Sequence[str] = ("doc_id",),
          longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """row (struct of the carried columns), n_words, n_features and weight of every row of the corpus."""
    featured = written(features(docs, text, carry, longest, buckets), "importance-features")
    wanted = features(target, target_text, (), longest, buckets)
    gain = gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = flat_grams(batch.column("grams"))
            sums = np.concatenate([[0], np.cumsum(gain[grams])])
            ends = np.cumsum(n)
            weights = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), pa.array(n), pa.array(weights)],
                                             ["row", "n_words", "n_features", "weight"])
    kept = StructType([featured.schema["row"]]).add("n_words", "long").add("n_features", "long").add("weight", "long")
    return featured.mapInArrow(mean, kept)


def gumbel(id_column: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the first 8 hex digits of sha256('seed:id'), floored."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, id_column: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Adds score, and rank: 1, 2, 3 ... for the drawn rows, null for the others.

    Of the N rows of `least_words` words or more, floor(percent N / 100) are drawn by score, ties to the smaller id.
    """
    noise = gumbel(F.col("row")[id_column], seed)
    scored = written(weighed.withColumn("score", (F.col("weight") + noise).cast("bigint")), "importance-scores")
    long_enough = scored.where(F.col("n_words") >= least_words)
    most = long_enough.count() * percent // 100
    ranked = number_in_order(long_enough, [F.desc("score"), F.col("row")[id_column].asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The drawn documents with all their columns, whole texts included."""
    drawn = draw(weigh(docs, target, text, carry=docs.columns), id_column, percent=percent)
    return drawn.where(F.col("rank").isNotNull()).select(*[F.col("row")[c].alias(c) for c in docs.columns])
