"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks, with limits that depend on the length.

A null or empty text has no words and fails the base rules. Equal texts get equal verdicts, whatever their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermetrics.llm.buffers import SPACES, Rolling, block_arrays, byte_table, covered, row_of, scramble, spans, sums_by_row

SYMBOLS = b"#*$%&|<>"
SHINGLE = 5
LEVEL = 3
CHUNK = 4096
LONG = 512  # bytes from which a range is hashed by a digest
# (from this many bytes, least ratio, greatest ratio) of bytes to compressed bytes; the last that fits holds.
WHOLE_BANDS = ((0, 0.5, 4.0), (256, 1.15, 5.0), (1024, 1.25, 5.5), (4096, 1.4, 6.0), (65536, 1.4, 8.0))
CHUNK_BAND = (1.25, 8.0)
BAD_CHUNKS = 0.5  # share of the chunks outside their band that rejects a text
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
KIND = "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ",ratio:double,bad_chunks:double,banded:boolean>"


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return scramble(hashes ^ ((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))


def text_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Hashes of byte ranges. Long ranges get a cryptographic digest: from about a thousand bytes on, there are different
    texts (Thue-Morse words) whose polynomials modulo 2**64 agree for every base."""
    keys = rolling.words(data, starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG):
        keys[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return keys


def base_counts(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> dict[str, np.ndarray]:
    """The base statistics of each text."""
    n = len(offsets) - 1
    inside = ~byte_table(SPACES)[data]
    starts, ends = spans(inside, offsets)
    first = np.searchsorted(starts, offsets)
    out = {"n_words": np.diff(first),
           "word_chars": sums_by_row(inside & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": sums_by_row(byte_table(SYMBOLS)[data], offsets)}
    line_starts, line_ends = spans(data != 10, offsets)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    rows = row_of(line_starts, offsets)
    keys = keyed(text_keys(data, line_starts, line_ends, rolling), rows)
    _, kept = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(rows, minlength=n) - np.bincount(rows[kept], minlength=n)
    grams = rolling.grams(text_keys(data, starts, ends, rolling), SHINGLE)
    rows = row_of(starts, offsets)
    at = np.flatnonzero(rows[:len(grams)] == rows[SHINGLE - 1:]) if len(grams) else np.zeros(0, np.int64)
    twice = at[repeated(keyed(grams[at], rows[at]))]
    out["n_repeat_words"] = sums_by_row(covered(len(starts), twice, SHINGLE), first)
    return out


def in_band(size: int, ratio: float) -> bool:
    low, high = next((a, b) for at, a, b in reversed(WHOLE_BANDS) if size >= at)
    return low <= ratio <= high


def ratios(raw: memoryview, press: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, float, bool]:
    """Ratio of the whole, share of its chunks outside their band, and whether the text passes. Chunks are full; the last one
    ends with the text and may overlap the one before, so that every byte of a longer text is judged."""
    size = len(raw)
    if not size:
        return 0.0, 0.0, False
    whole = size / len(press.compress(raw))
    starts = [*range(0, size - chunk + 1, chunk), *([size - chunk] if size > chunk and size % chunk else [])]
    bad = [not CHUNK_BAND[0] <= chunk / len(press.compress(raw[i:i + chunk])) <= CHUNK_BAND[1] for i in starts]
    share = sum(bad) / len(bad) if bad else 0.0
    return whole, share, in_band(size, whole) and share < BAD_CHUNKS


def quality_rules(docs: DataFrame, *, text: str = "text", out: str = "rules") -> DataFrame:
    """The documents with a struct column `out`: base statistics, `base_failed`, `kept`, `ratio` and `bad_chunks`."""
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling, press = Rolling(), zstandard.ZstdCompressor(level=LEVEL)
        for column in batches:
            parts = []
            for data, offsets in block_arrays(column):
                counts = base_counts(data, offsets, rolling)
                raw = memoryview(data.tobytes())
                got = [ratios(raw[a:b], press) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [pa.array(counts[s], pa.int64()) for s in STATS]
                columns += [pa.array(c, t) for c, t in zip(zip(*got), (pa.float64(), pa.float64(), pa.bool_()))]
                parts.append(pa.StructArray.from_arrays(columns, [*STATS, "ratio", "bad_chunks", "banded"]))
            kind = pa.struct([*((s, pa.int64()) for s in STATS), ("ratio", pa.float64()), ("bad_chunks", pa.float64()), ("banded", pa.bool_())])
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    raw = docs.withColumn(out, F.arrow_udf(measure, KIND)(F.col(text)))
    c = F.col
    failed = (c(f"{out}.n_words") < 10) | (100 * c(f"{out}.n_repeat_words") > 20 * c(f"{out}.n_words"))
    return raw.withColumn(out, F.struct(*(c(f"{out}.{s}").alias(s) for s in STATS), failed.alias("base_failed"),
                                        (~failed & c(f"{out}.banded")).alias("kept"), c(f"{out}.ratio").alias("ratio"),
                                        c(f"{out}.bad_chunks").alias("bad_chunks")))
