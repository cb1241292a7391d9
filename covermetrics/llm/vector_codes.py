"""Vector codes: parts of integer vectors coded by codebooks, with distances accumulated down a trie of distinct parts.

Every component becomes floor(scale * x). A vector is cut into equal parts, and each part position has a codebook that starts
as that part of the first vectors by id. In each round a task sorts the distinct parts of its rows and walks their trie depth
first: a node holds the vector of squared distances from its prefix to all entries, children add their next component to
it, and leaves take the nearest entry and add their weighted components to its sums. Tasks hand back sums alone.

Rows take no part whose vector is null or empty, holds null or non-finite components, has another length than that of the
smallest id that does, or has a component of 2**17 or more, whose squares would leave 64 bits. A length that does not
divide by the number of parts is padded with zeros. Null ids come last; rows with equal ids are ordered by their vectors;
repeated rows count each. With fewer rows than entries the codebooks have as many entries as rows, and no rows give no
codes. Carried columns may have any name: they travel inside a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from covermetrics.operators.relational import attach_group_facts
from covermetrics.llm.rows import written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
WIDEST = 1 << 17
BLOCK = 1 << 14  # rows whose parts are sorted and walked together
EXACT = 1 << 53


def integer_vectors(df: DataFrame, vector: str, id_column: str, carry: Sequence[str], scale: int = SCALE) -> DataFrame:
    """row (struct of the carried columns), id and v: the vectors that take part, as integers."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WIDEST))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    rows = df.where(F.coalesce(sound, F.lit(False))).select(F.struct(*carry).alias("row"), F.col(id_column).alias("id"), v.alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    return rows.where(F.size("v") == (first[0].n if first else 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows, padded with zeros to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    own = len(flat) // max(len(column), 1)
    out = np.zeros((len(column), width), np.int64)
    out[:, :own] = flat.reshape(len(column), own)
    return out


class Trie:
    """The trie of sorted distinct parts, given as rows, walked with one codebook."""

    def __init__(self, parts: np.ndarray, book: np.ndarray):
        self.parts, self.width = parts, parts.shape[1]
        most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
        # Doubles are exact for these integers as long as no sum leaves 53 bits, and their products are faster.
        self.kind = np.float64 if 4 * self.width * most * most < EXACT else np.int64
        self.book = book.astype(self.kind)
        self.code = np.zeros(len(parts), np.int64)
        self.error = np.zeros(len(parts), np.int64)

    def leaves(self, rows: np.ndarray, depth: int, shared: np.ndarray) -> None:
        """Parts that share no more than their first `depth` components with others: the rest of each is one edge."""
        tail, book = self.parts[rows, depth:].astype(self.kind), self.book[:, depth:]
        total = shared + (tail * tail).sum(1)[:, None] - 2 * (tail @ book.T) + (book * book).sum(1)
        best = total.argmin(1)
        self.code[rows], self.error[rows] = best, total[np.arange(len(rows)), best]

    def walk(self) -> None:
        """Depth first from the root; a stack holds the open subtrees: first row, last row, depth, distances so far."""
        stack = [(0, len(self.parts), 0, np.zeros(len(self.book), self.kind))] if len(self.parts) else []
        while stack:
            lo, hi, depth, shared = stack.pop()
            if depth == self.width or hi - lo == 1:
                self.leaves(np.arange(lo, min(hi, lo + 1)), depth, shared[None])
                continue
            values = self.parts[lo:hi, depth]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [hi - lo]])
            step = values[starts[:-1], None].astype(self.kind) - self.book[:, depth]
            below = shared + step * step
            single = np.diff(starts) == 1
            if single.any():
                self.leaves(lo + starts[:-1][single], depth + 1, below[single])
            for i in np.flatnonzero(~single)[::-1].tolist():
                stack.append((lo + int(starts[i]), lo + int(starts[i + 1]), depth + 1, below[i]))


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parts in order, their counts and each row's place among them, then code and squared distance of each distinct part."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.ones(len(parts), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    trie = Trie(ordered[new], book)
    trie.walk()
    return ordered[new], np.bincount(place, minlength=int(new.sum())), place, trie.code, trie.error


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in blocks of about `size`."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def first_books(rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The codebooks to start from: parts x entries x components."""
    least = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = -(-len(least[0].v) // parts) if least else 0
    vectors = np.zeros((len(least), parts * width), np.int64)
    for i, r in enumerate(least):
        vectors[i, :len(r.v)] = r.v
    return vectors.reshape(len(least), parts, width).transpose(1, 0, 2)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts; parts x entries rows of sums reach the driver."""
    n_parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, entries, width), np.int64)
        count = np.zeros((n_parts, entries), np.int64)
        for batch in blocks(batches):
            vectors = matrix(batch.column("v"), n_parts * width)
            for p in range(n_parts):
                distinct, n, _, code, _ = assign(vectors[:, p * width:(p + 1) * width], books[p])
                np.add.at(total[p], code, distinct * n[:, None])
                count[p] += np.bincount(code, weights=n, minlength=entries).astype(np.int64)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"])
    kind = "part bigint, entry bigint, n bigint, total array<bigint>"
    wide = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(width)]
    out = books.copy()
    for r in rows.select("v").mapInArrow(sums, kind).groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
        out[r.part, r.entry] = [int(Decimal(r[f"d{d}"])) // r.n for d in range(width)]
    return out


def fit_codebooks(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, entries, parts)
    for _ in range(rounds if books.size else 0):
        books = improved(rows, books)
    return books


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds code (the entry of each part) and error (squared distances summed over the parts) to row and id."""
    n_parts, _, width = books.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            vectors = matrix(batch.column("v"), n_parts * width)
            code, error = np.zeros((batch.num_rows, n_parts), np.int64), np.zeros(batch.num_rows, np.int64)
            for p in range(n_parts):
                _, _, place, best, distance = assign(vectors[:, p * width:(p + 1) * width], books[p])
                code[:, p] = best[place]
                error += distance[place]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(list(code), pa.list_(pa.int64())), pa.array(error)], ["row", "id", "code", "error"])
    kind = StructType([rows.schema["row"], rows.schema["id"]]).add("code", ArrayType(LongType())).add("error", "long")
    return rows.mapInArrow(scan, kind)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", carry: Sequence[str] = ("vec_id", "label"),
                   entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes and errors of the vectors that take part, and the codebooks, from which `decode` rebuilds the integers."""
    rows = written(integer_vectors(df, vector, id_column, carry), "integer-vectors")
    books = fit_codebooks(rows, entries, parts, rounds)
    return codes(rows, books), books


def decode(code: Sequence[int], books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p][c] for p, c in enumerate(code)])


def with_group_errors(coded: DataFrame, group: str) -> DataFrame:
    """Adds group_error: the errors summed over rows whose carried column `group` is equal, nulls together."""
    coded = written(coded.withColumn("group", F.col("row")[group]), "vector-codes")
    facts = coded.groupBy("group").agg(F.sum("error").alias("group_error"), F.count(F.lit(1)).alias("group_rows"))
    return attach_group_facts(coded, facts, ["group"]).drop("group", "group_rows")
