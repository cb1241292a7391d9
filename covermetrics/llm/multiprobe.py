"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every distinct vector is hashed in `tables` tables, each by floor((a.x + b) / width) over `dims` Gaussian projections. A
neighbour at distance r moves a projection by a Gaussian of deviation r, which gives every perturbed bucket a chance of
holding it. A query visits buckets in falling order of that chance until the tables together promise `recall`; there is
no other limit. Visited buckets meet their queries in blocks of bounded size: a bucket of many vectors or queries is
split into a grid of blocks, each block is one matrix product, and a task hands on the nearest few of each query. What
comes out is ranked by exact distances in double precision.

r, the width and the number of projections come from the data: r is the distance within which nine tenths of a bounded
sample of vectors have their `k` nearest among all rows. The more the neighbours stand out, the more projections are
used and the smaller the share of vectors that is scored; in uniformly random directions no hashing is selective, and
most vectors are scored.

Equal vectors are one point that carries its k + 1 smallest ids, which is all that k nearest rows can need; a query leaves
out its own row and keeps its other copies. Rows equal in id and vector are one row; rows of one id with different vectors are
different rows. Rows without id, and vectors null, empty, zero, of another length than most, or holding null or
non-finite components take no part. Ties go to the smaller id. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from covermetrics.llm.rows import written
from covermetrics.operators.relational import top_k_per_group

K = 10
TABLES = 4
RECALL = 0.97
SAMPLE = 256  # vectors whose nearest distances are measured against all rows
FILL = 64  # vectors a bucket should hold
PROBES = 128  # buckets a query should visit in a table, on average; more come from fewer projections, never from a cut
BLOCK = 2048  # vectors, and queries, in a block
HELD = 1 << 18  # candidate pairs that a task holds before it thins them out
REACH = 6.0  # deviations beyond which no perturbed bucket is considered
C = F.col


def sound_rows(df: DataFrame, vector: str, id_column: str) -> DataFrame:
    """id and v of the rows that take part, each once; single precision stays as it is, anything else becomes double."""
    kind = df.schema[vector].dataType.simpleString()
    rows = df.select(C(id_column).cast("long").alias("id"), C(vector).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    sound = C("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (length[0].n if length else 0))


def points(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: point (smallest id), tag (hash of the vector), ids (the k + 1 smallest) and v."""
    least = top_k_per_group(rows, ["v"], [C("id")], k + 1)
    return least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.array_min("ids").alias("point"), F.xxhash64("v").alias("tag"), "ids", "v")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; not exact, as close to zero its terms cancel."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, added up component by component."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += (a[:, d] - b[:, d]) ** 2
    return total


@dataclass(frozen=True)
class Hashing:
    """The hash functions of all tables, and the distance r that probing is made for."""

    width: float
    r: float
    dims: int
    tables: int
    length: int
    seed: int = 5

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.tables, self.dims, self.length)), rng.uniform(0, self.width, (self.tables, self.dims, 1))

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each table, projection and vector: the cell and the place in it, from 0 to the width."""
        a, b = self.functions()
        at = a @ vectors.T + b
        cell = np.floor(at / self.width)
        return cell.astype(np.int64), at - cell * self.width

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells along the second axis from the end; equal cells always agree."""
        out = np.zeros(cells.shape[:-2] + cells.shape[-1:], np.uint64)
        for d in range(cells.shape[-2]):
            out = (out ^ cells[..., d, :].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.astype(np.int64)


def chances(place: np.ndarray, width: float, r: float) -> np.ndarray:
    """Chance that a neighbour at distance r lies -m..m cells away, for each place in a cell."""
    m = max(1, math.ceil(REACH * r / width))
    edges = (np.arange(-m, m + 2) * width - place[..., None]) / (r * math.sqrt(2))
    below = 0.5 + 0.5 * np.array([math.erf(x) for x in edges.ravel()]).reshape(edges.shape)
    return np.diff(below, axis=-1)


def best_first(chance: np.ndarray, promise: float) -> np.ndarray:
    """Perturbations (rows of cell offsets) in falling order of their chance, until the chances add up to the promise.

    Partial perturbations are extended projection by projection and only the best are kept: any among the best n has
    all its prefixes among the best n, so nothing is missed; n doubles until the promise is met.
    """
    dims, options = chance.shape
    middle, n = options // 2, 64
    while True:
        value, offsets = np.ones(1), np.zeros((1, 0), np.int64)
        for d in range(dims):
            grown = (value[:, None] * chance[d]).ravel()
            order = np.argsort(-grown, kind="stable")[:n]
            order = order[grown[order] > 0]
            offsets = np.column_stack([offsets[order // options], order % options - middle])
            value = grown[order]
        reached = np.cumsum(value)
        if reached[-1] >= promise or len(value) < n:
            return offsets[:int(np.searchsorted(reached, promise)) + 1]
        n *= 2


def nearest_distances(found: DataFrame, sample: np.ndarray, k: int) -> np.ndarray:
    """For each sampled vector the distance of its k-th nearest among all rows: tasks hand on k distances each."""
    length = sample.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(sample), k + 1), np.inf)
        for batch in batches:
            vectors = matrix(batch.column("v"), length)
            copies = pc.list_value_length(batch.column("ids")).to_numpy()
            for i in range(0, len(vectors), BLOCK):
                block = np.repeat(vectors[i:i + BLOCK], copies[i:i + BLOCK], axis=0)
                best = np.partition(np.column_stack([best, squared(sample, block)]), k, axis=1)[:, :k + 1]
        q, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, at])], ["q", "d"])
    each = found.select("ids", "v").mapInArrow(scan, "q bigint, d double")
    # The nearest of all is the sampled row itself.
    kth = top_k_per_group(each, ["q"], [C("d")], k + 1).groupBy("q").agg(F.max("d").alias("d")).collect()
    return np.sqrt([row.d for row in kth])


def fit(found: DataFrame, tables: int = TABLES, recall: float = RECALL, k: int = K, sample: int = SAMPLE) -> Hashing | None:
    """Hash functions for these points; the driver sees `sample` vectors and their distances, whatever the number of rows."""
    taken = found.orderBy("tag", "point").select("v").limit(sample).collect()
    if not taken:
        return None
    vectors = np.array([row.v for row in taken])
    rows = found.count()
    spread = math.sqrt(((vectors - vectors.mean(0)) ** 2).sum(1).mean()) or float(np.abs(vectors).max())
    r = max(float(np.quantile(nearest_distances(found, vectors, k), 0.9)), spread * 1e-3)
    width = 2 * spread
    promise = 1 - (1 - recall) ** (1 / tables)
    dims = max(1, round(math.log2(max(rows, 2) / FILL)))
    while dims > 1:
        h = Hashing(width, r, dims, tables, vectors.shape[1])
        _, place = h.cells(vectors[:32])
        visited = [len(best_first(chances(place[0, :, i], width, r), promise)) for i in range(place.shape[-1])]
        if np.mean(visited) <= PROBES:
            break
        dims -= 1
    return Hashing(width, r, dims, tables, vectors.shape[1])


def hashed(found: DataFrame, h: Hashing) -> DataFrame:
    """Each point once for each table, with its bucket."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = h.buckets(h.cells(matrix(batch.column("v"), h.length))[0])
            for t in range(h.tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(bucket[t]), *batch.columns], ["part", "bucket", *batch.schema.names])
    return found.mapInArrow(scan, StructType().add("part", "integer").add("bucket", "long").add("point", "long").add("tag", "long")
                            .add(found.schema["ids"]).add(found.schema["v"]))


def probes(queries: DataFrame, h: Hashing, recall: float) -> DataFrame:
    """part, bucket and query of every bucket to visit; recall is shared out evenly over the tables."""
    promise = 1 - (1 - recall) ** (1 / h.tables)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, place = h.cells(matrix(batch.column("v"), h.length))
            for t in range(h.tables):
                chance = chances(place[t].T, h.width, h.r)
                found = [np.unique(h.buckets((cells[t, :, i] + best_first(chance[i], promise)).T)) for i in range(batch.num_rows)]
                n = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(sum(n), t), pa.int32()), pa.array(np.concatenate(found)),
                     *(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("point", "tag"))], ["part", "bucket", "point", "tag"])
    return queries.select("point", "tag", "v").mapInArrow(scan, "part int, bucket long, point long, tag long")


def thinned(pairs: list[np.ndarray], k: int) -> np.ndarray:
    """The k nearest different candidates of each query, from rows of (query, its tag, distance, candidate, its tag, ...)."""
    rows = np.concatenate(pairs)
    rows = rows[np.lexsort((rows["ctag"], rows["cpoint"], rows["d"], rows["tag"], rows["point"]))]
    new = np.ones(len(rows), bool)
    new[1:] = rows[["point", "tag", "cpoint", "ctag"]][1:] != rows[["point", "tag", "cpoint", "ctag"]][:-1]
    rows = rows[new]
    starts = np.ones(len(rows), bool)
    starts[1:] = rows[["point", "tag"]][1:] != rows[["point", "tag"]][:-1]
    first = np.flatnonzero(starts)
    rank = np.arange(len(rows)) - first[np.cumsum(starts) - 1]
    return rows[rank < k]


PAIR = np.dtype([("point", "<i8"), ("tag", "<i8"), ("d", "<f8"), ("cpoint", "<i8"), ("ctag", "<i8")])
PAIR_KIND = "point long, tag long, d double, cpoint long, ctag long"


def score_block(q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int) -> np.ndarray:
    """The k nearest points of the block for each of its queries, all ties included, with exact distances."""
    near = squared(q["v"], c["v"])
    kept = min(k, near.shape[1])
    limit = np.partition(near, kept - 1, axis=1)[:, kept - 1]
    slack = 1e-9 * ((q["v"] ** 2).sum(1) + (c["v"] ** 2).sum(1).max())
    i, j = np.nonzero(near <= (limit + slack)[:, None])
    out = np.empty(len(i), PAIR)
    out["point"], out["tag"], out["cpoint"], out["ctag"] = q["point"][i], q["tag"][i], c["point"][j], c["tag"][j]
    out["d"] = exact(q["v"][i], c["v"][j])
    return out


def score_blocks(blocks: DataFrame, length: int, k: int) -> DataFrame:
    """Rows sorted by block, queries before points, scored block by block; a block holds a bounded number of either."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in whole_blocks(batches):
            side = block.column("is_point").to_numpy(zero_copy_only=False)
            if side.all() or not side.any():
                continue
            rows = {c: block.column(c).to_numpy(zero_copy_only=False) for c in ("point", "tag")} | {"v": matrix(block.column("v"), length)}
            pairs = score_block({c: x[~side] for c, x in rows.items()}, {c: x[side] for c, x in rows.items()}, k)
            held.append(pairs)
            n += len(pairs)
            if n >= HELD:
                held = [thinned(held, k)]
                n = len(held[0])
                if 2 * n >= HELD:
                    yield as_batch(held.pop())
                    n = 0
        if held:
            yield as_batch(thinned(held, k))
    return blocks.select("part", "bucket", "row_block", "query_block", "is_point", "point", "tag", "v").mapInArrow(scan, PAIR_KIND)


def as_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[c])) for c in PAIR.names], list(PAIR.names))


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block together, from batches sorted by block."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("part", "bucket", "row_block", "query_block")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        last = rest and [rest[-1].column(c)[-1].as_py() for c in ("part", "bucket", "row_block", "query_block")]
        for a, b in zip(bounds, bounds[1:]):
            if rest and last != keys[a].tolist():
                yield pa.concat_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = keys[a].tolist()
    if rest:
        yield pa.concat_batches(rest)


def candidates(found: DataFrame, queries: DataFrame, h: Hashing, recall: float, k: int) -> DataFrame:
    """The k nearest points of each query among those in the buckets that it visits."""
    index, visits = hashed(found, h), written(probes(queries, h, recall), "probes")
    key = ["part", "bucket"]
    sizes = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points")).join(visits.groupBy(*key).agg(F.count(F.lit(1)).alias("n_queries")), key)
    grid = written(sizes.select(*key, *[F.ceil(C(n) / BLOCK).cast("int").alias(b) for n, b in (("n_points", "row_blocks"), ("n_queries", "query_blocks"))]), "probed-buckets")

    def dealt(rows: DataFrame, own: str, other: str, is_point: bool) -> DataFrame:
        """Rows of visited buckets: in one of their side's blocks, copied to each block of the other side."""
        each = rows.join(grid, key).withColumn(own, F.pmod(F.xxhash64("point", "tag"), C(f"{own}s")).cast("int"))
        each = each.withColumn(other, F.explode(F.sequence(F.lit(0), C(f"{other}s") - 1)))
        return each.select(*key, "row_block", "query_block", F.lit(is_point).alias("is_point"), "point", "tag", "v")
    asked = visits.join(queries, ["point", "tag"])
    both = dealt(index, "row_block", "query_block", True).unionByName(dealt(asked, "query_block", "row_block", False))
    block = [*key, "row_block", "query_block"]
    blocks = both.repartition(*block).sortWithinPartitions(*block, "is_point")
    return score_blocks(blocks, h.length, k)


def nearest(df: DataFrame, is_query: Column, vector: str = "embedding", id_column: str = "vec_id", k: int = K,
            tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, id and score: the k nearest rows found for each query row; is_query is a condition on the id, named `id`."""
    rows = sound_rows(df, vector, id_column).distinct()
    found = written(points(rows, k), "points")
    asking = written(rows.where(is_query).join(found.select("point", "tag", "v"), "v"), "queries")
    h = fit(found, tables, recall, k)
    if h is None:
        pairs = df.sparkSession.createDataFrame([], PAIR_KIND)
    else:
        pairs = candidates(found, asking.select("point", "tag", "v").dropDuplicates(["point", "tag"]), h, recall, k + 1)
    # Tasks found the same pair in several tables; pairs of a query meet once, and both steps below use that dealing.
    single = pairs.repartition("point", "tag").dropDuplicates(["point", "tag", "cpoint", "ctag"])
    best = top_k_per_group(single, ["point", "tag"], [C("d"), C("cpoint"), C("ctag")], k + 1).drop("rank")
    named = best.join(found.select(C("point").alias("cpoint"), C("tag").alias("ctag"), "ids"), ["cpoint", "ctag"])
    each = F.transform("ids", lambda i: F.struct(C("d").alias("d"), i.alias("id"), C("ctag").alias("ctag"), C("cpoint").alias("cpoint")))
    lists = named.groupBy("point", "tag").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("rows"))
    own = lambda x: (x["id"] == C("id")) & (x["ctag"] == C("tag")) & (x["cpoint"] == C("point"))
    others = F.slice(F.filter("rows", lambda x: ~own(x)), 1, k)
    out = asking.select("id", "point", "tag").join(lists, ["point", "tag"]).select(C("id").alias("query_id"), F.posexplode(others).alias("at", "row"))
    return out.select("query_id", (C("at") + 1).cast("int").alias("rank"), C("row.id").alias("id"), F.sqrt("row.d").alias("score"))
