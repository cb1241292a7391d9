"""Byte-level BPE as a monoid: halves are encoded on their own and joined by re-encoding windows at the seam.

Texts are halved down to leaves, and so are single matches that are long. A joined result is that of the whole because
everything outside the window is proven stable: a match of the splitting pattern depends only on the characters from its
start to two past its end, and a token sequence is the encoding of its bytes if each adjacent pair is.

Null and empty texts have no tokens; a vocabulary must hold all 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.llm.rows import Remembered, for_worker, lean

LEAF_CHARS = 8192
LEAF_BYTES = 64
LOOKAHEAD = 3
NO_RANK = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def split_text(text: str, findall, leaf: int = LEAF_CHARS) -> list[str]:
    """All matches of the pattern, from the matches of both halves."""
    if len(text) <= max(leaf, 1):
        return findall(text)
    half = len(text) // 2
    return join_matches(split_text(text[:half], findall, leaf), split_text(text[half:], findall, leaf), findall)


def join_matches(left: list[str], right: list[str], findall) -> list[str]:
    """Matches of both texts together: those near the end of the left one are matched again with more and more of the right."""
    open_end: list[str] = []
    while left and sum(map(len, open_end)) < LOOKAHEAD:
        open_end.append(left.pop())
    tail = "".join(reversed(open_end))
    take = 8
    while True:
        window = tail + "".join(right[:take])
        again = findall(window)
        if take >= len(right):
            return left + again
        seams, at = {}, len(tail)
        for k, match in enumerate(right[:take]):
            seams[at] = k
            at += len(match)
        at = 0
        for n, match in enumerate(again, 1):
            at += len(match)
            if at > len(window) - LOOKAHEAD:
                break
            if at in seams:
                return left + again[:n] + right[seams[at]:]
        take *= 2


class Encoder:
    """Token ids by the ranks, packed as 32-bit integers; those of single matches are kept up to a number of bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.leaf_chars, self.leaf_bytes = ranks, leaf_chars, leaf_bytes
        self.findall = regex.compile(pattern).findall
        self.matches = Remembered()
        self.pairs = PairTable(ranks)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [split_text(t, self.findall, self.leaf_chars) for t in texts]
        results, leaves = {}, []
        for match in self.matches.unseen(set().union(*split)):
            raw = match.encode()
            if (whole := self.ranks.get(raw)) is not None:
                results[match] = np.uint32(whole).tobytes()
            elif len(raw) <= self.leaf_bytes:
                leaves.append((match, raw))
            else:
                results[match] = np.array([self.ranks[t] for t in self.tokens(raw)], "<u4").tobytes()
        leaves.sort(key=lambda x: len(x[1]))
        for at in range(0, len(leaves), 4096):
            part = leaves[at:at + 4096]
            results.update(zip([m for m, _ in part], self.pairs.merge([raw for _, raw in part])))
        self.matches.learn(results)
        return [b"".join(map(self.matches.now.__getitem__, matches)) for matches in split]

    def tokens(self, raw: bytes) -> list[bytes]:
        if len(raw) <= self.leaf_bytes:
            return merge_bytes(raw, self.ranks)
        half = len(raw) // 2
        return self.join_tokens(self.tokens(raw[:half]), self.tokens(raw[half:]))

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            again = merge_bytes(b"".join(left[-i:] + right[:j]), self.ranks)
            left_stable = i == len(left) or again[0] == left[-i]
            right_stable = j == len(right) or again[-1] == right[j - 1]
            if left_stable and right_stable:
                return left[:-i] + again + right[j:]
            i, j = i if left_stable else 2 * i, j if right_stable else 2 * j


class PairTable:
    """Rank of each pair of token ids that can merge, to merge many short pieces in step."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece: in each step every piece merges its pair of lowest rank, the leftmost of equals."""
        n, width = len(pieces), max(map(len, pieces)) + 1
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        if not len(self.keys):
            return [ids[i, :k].astype("<u4").tobytes() for i, k in enumerate(sizes.tolist())]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        open_rows, column = np.arange(n), np.arange(width)
        while len(open_rows):
            now = rank[open_rows]
            at = now.argmin(1)
            least = now[np.arange(len(open_rows)), at]
            more = least < NO_RANK
            open_rows, at, least, now = open_rows[more], at[more], least[more], now[more]
            if not len(open_rows):
                break
            source = np.minimum(column + (column > at[:, None]), width - 1)
            moved = np.take_along_axis(ids[open_rows], source, 1)
            i = np.arange(len(open_rows))
            moved[i, at] = least
            now = np.take_along_axis(now, np.minimum(source[:, :-1], width - 2), 1)
            now[i, at] = self.rank(moved[i, at], moved[i, at + 1])
            before = np.maximum(at - 1, 0)
            now[i, before] = np.where(at > 0, self.rank(moved[i, before], moved[i, at]), now[i, before])
            ids[open_rows], rank[open_rows] = moved, now
            sizes[open_rows] -= 1
        flat, ends = ids[column < sizes[:, None]].astype("<u4").tobytes(), 4 * np.cumsum(sizes)
        return [flat[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist())]


def merge_bytes(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank."""
    n = len(raw)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(raw[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(raw[before[i]:stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    parts, i = [], 0
    while i < n:
        parts.append(raw[i:end[i]])
        i = end[i]
    return parts


def decode_ids(ids: pa.Array, table: pa.Array, leaf: int = 1 << 18) -> list[pa.Array]:
    """The tokens' bytes of both halves, one after the other."""
    if len(ids) <= max(leaf, 1):
        return [table.take(ids)]
    half = len(ids) // 2
    return decode_ids(ids[:half], table, leaf) + decode_ids(ids[half:], table, leaf)


def decode_lists(lists: pa.ListArray, table: pa.Array, leaf: int = 1 << 18) -> pa.Array:
    """The bytes of each list of ids, looked up for many lists at once; a null list gives no bytes."""
    if lists.null_count:
        lists = pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type))
    starts = lists.offsets.to_numpy().astype(np.int64)
    ids, starts = lists.values[starts[0]:starts[-1]], starts - starts[0]
    if ids.null_count:
        raise ValueError("null among the ids of a text")
    raw, bounds, seen, size = [], np.zeros(len(starts), np.int64), 0, 0
    for tokens in decode_ids(ids, table, leaf) if len(ids) else ():
        ends = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, 8 * tokens.offset)
        here = slice(*np.searchsorted(starts, (seen + 1, seen + len(tokens) + 1)))
        bounds[here] = ends[starts[here] - seen] - ends[0] + size
        raw.append(tokens.buffers()[2][int(ends[0]):int(ends[-1])])
        seen, size = seen + len(tokens), size + int(ends[-1] - ends[0])
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.array(bounds, pa.int32()).buffers()[1], pa.py_buffer(b"".join(raw))])


def _packer(spark: SparkSession, path: str, pattern: str):
    """A function for workers: packed ids of each text of a column, some texts at a time, by the encoder that the worker keeps."""
    table = load_ranks(path)
    ranks = spark.sparkContext.broadcast(table)  # one fixed vocabulary
    key = hashlib.md5(repr((pattern, sorted(table.items()))).encode()).hexdigest()

    def pack(batches: Iterator[pa.Array]) -> Iterator[list[bytes]]:
        encoder = for_worker("matches", key, lambda: Encoder(ranks.value, pattern))
        for column in batches:
            packed = []
            for at in range(0, len(column), 256):
                packed += encoder.encode([t or "" for t in column.slice(at, 256).to_pylist()])
            yield packed
        encoder.matches.rest()
    return pack, ranks


def _id_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32), pa.int32()))


def _by_rank(ranks: dict[bytes, int]) -> pa.Array:
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """The documents with their token ids in the column `out`, an array of int."""
    pack, _ = _packer(docs.sparkSession, path, pattern)

    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for packed in pack(batches):
            yield _id_lists(packed)
    return docs.withColumn(out, F.arrow_udf(lean(ids_of), "array<int>")(F.col(text)))


def decode(tokens: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids in the binary column `out`; null ids give no bytes."""
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(path))

    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _by_rank(ranks.value)
        for column in batches:
            yield decode_lists(column, table)
    return tokens.withColumn(out, F.arrow_udf(lean(bytes_of), "binary")(F.col(ids)))


def encode_and_decode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encode`, then `decode` of its ids, by one worker of each task: two would hold the vocabulary twice and pass the ids between them."""
    pack, ranks = _packer(docs.sparkSession, path, pattern)

    def both_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _by_rank(ranks.value)
        for packed in pack(batches):
            found = _id_lists(packed)
            yield pa.StructArray.from_arrays([found, decode_lists(found, table)], ["ids", "decoded"])
    kind = "struct<ids:array<int>,decoded:binary>"
    both = docs.withColumn("__both", F.arrow_udf(lean(both_of), kind).asNondeterministic()(F.col(text)))  # one run for both columns
    return both.withColumns({ids: F.col("__both.ids"), out: F.col("__both.decoded")}).drop("__both")
