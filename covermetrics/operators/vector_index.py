"""An exact cosine search over cells: triangle bounds skip the cells that cannot hold one of the k best."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.operators.relational import top_k_per_group
from covermetrics.session import staged

SAMPLE = 4096  # vectors that the centroids are fitted on
MOST_CELLS = 1024  # centroids that travel to every task
BLOCK = 4096  # rows, and queries, that meet in a group
ASKED = 256  # queries of a group that are scored at once
VISITS = 65_536  # pairs of queries and cells that a task looks at together
NO_DIRECTION = -1  # cell of zero vectors, which have a cosine of 0 with everything
SLACK = 2e-6  # scores are rounded to six digits
C = F.col


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def matrix(column: pd.Series) -> np.ndarray:
    return unit(np.stack(column.to_numpy()).astype(np.float64)) if len(column) else np.zeros((0, 1))


def centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centres of the sample by a few rounds of means; empty cells keep their first vector."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(0)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def districts(centres: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """A district for each cell: cells are halved along their widest axis until a part holds ``most`` rows or is one cell."""
    out, n, left = np.zeros(len(sizes), np.int64), 0, [np.arange(len(sizes))]
    while left:
        own = left.pop()
        if len(own) == 1 or sizes[own].sum() <= most:
            out[own] = n
            n += 1
            continue
        own = own[np.argsort(centres[own, np.ptp(centres[own], axis=0).argmax()], kind="stable")]
        upto = np.cumsum(sizes[own])
        cut = min(max(int(np.searchsorted(upto, upto[-1] / 2)), 1), len(own) - 1)
        left += [own[:cut], own[cut:]]
    return out


@dataclass(frozen=True)
class VectorIndex:
    """Unit vectors dealt to the cells of their nearest centroid, stored by cell, with each cell's size and radius.

    Cosine order is distance order on unit vectors. A query first scores its nearest cells that hold k rows; the k-th score found
    bounds the distance of anything better, and the triangle inequality rules out every cell whose centroid is further
    than that bound and the cell's radius. All other cells are scored, so the result is exact. Centroids are
    fitted on a bounded sample, which moves work and never results. NULL vectors take no part. Queries travel to cells in
    blocks of neighbours and cells to blocks in districts, so that a vector is copied once for each block, not for each cell.
    """

    root: str
    key: str = "vector_id"
    vector: str = "vector"

    def _path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def build(self, corpus: DataFrame) -> VectorIndex:
        rows = corpus.select(self.key, self.vector).filter(C(self.vector).isNotNull() & (F.size(self.vector) > 0))
        sample = self._sample(rows)
        centres = centroids(sample, max(1, min(MOST_CELLS, len(sample), round(rows.count() ** 0.5)))) if len(sample) else np.zeros((0, 1))
        key, vector = self.key, self.vector

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                m = matrix(pdf[vector])
                near = distances(m, centres)
                own = near.argmin(1)
                zero = ~m.any(1)
                yield pdf.assign(away=np.where(zero, 0.0, near[np.arange(len(m)), own]), cell=np.where(zero, NO_DIRECTION, own).astype(np.int32))
        kinds = f"{key} {rows.schema[key].dataType.simpleString()}, {vector} {rows.schema[vector].dataType.simpleString()}, away double, cell int"
        dealt = rows.mapInPandas(assign, kinds) if len(sample) else rows.withColumns({"away": F.lit(0.0), "cell": F.lit(0)})
        dealt.hint("rebalance", C("cell")).write.partitionBy("cell").parquet(self._path("rows"))
        stored = rows.sparkSession.read.schema(kinds).parquet(self._path("rows"))
        stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).write.parquet(self._path("cells"))
        named = [(i, c.tolist()) for i, c in enumerate(centres)]
        rows.sparkSession.createDataFrame(named, "cell int, centre array<double>").coalesce(1).write.parquet(self._path("centres"))
        return self

    def _sample(self, rows: DataFrame) -> np.ndarray:
        taken = rows.orderBy(F.xxhash64(self.vector), self.key).select(self.vector).limit(SAMPLE).collect()
        if not taken:
            return np.zeros((0, 1))
        m = unit(np.array([r[0] for r in taken], np.float64))
        return m[m.any(1)] if m.any() else m[:1]

    def _cells(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell numbers, centres, sizes and radii: at most MOST_CELLS + 1 rows."""
        sizes = spark.read.schema("cell int, n bigint, radius double").parquet(self._path("cells"))
        centres = spark.read.schema("cell int, centre array<double>").parquet(self._path("centres"))
        rows = sizes.join(centres, "cell", "left").orderBy("cell").collect()
        width = max((len(r.centre) for r in rows if r.centre), default=1)
        centres = np.array([r.centre or [0.0] * width for r in rows], np.float64).reshape(len(rows), width)
        return np.array([r.cell for r in rows]), centres, np.array([r.n for r in rows]), np.array([r.radius for r in rows])

    def search(self, queries: DataFrame, k: int = 5, qkey: str = "query_id", qvector: str = "query_vector") -> DataFrame:
        """qkey, key, score (cosine, six digits), rank: the k best rows of each query, ties to the smaller key."""
        return self.search_with_visits(queries, k, qkey, qvector)[0]

    def search_with_visits(self, queries: DataFrame, k: int = 5, qkey: str = "query_id", qvector: str = "query_vector") -> tuple[DataFrame, DataFrame]:
        """The result, and (qkey, cell, n) of every cell that a query scored: the share of vectors scored is the sum of n over
        queries times rows."""
        spark = queries.sparkSession
        cells, centres, sizes, radii = self._cells(spark)
        q = queries.select(qkey, qvector).filter(C(qvector).isNotNull())
        qtypes = f"{qkey} {q.schema[qkey].dataType.simpleString()}, {qvector} {q.schema[qvector].dataType.simpleString()}"
        visited = f"{qkey} {q.schema[qkey].dataType.simpleString()}, cell int, n bigint"
        if not len(cells):
            qtype = q.schema[qkey].dataType.simpleString()
            return (spark.createDataFrame([], f"{qkey} {qtype}, {self.key} bigint, score double, rank int"),
                    spark.createDataFrame([], visited))
        always = cells == NO_DIRECTION
        home = districts(centres, sizes, BLOCK)

        def first_cells(m: np.ndarray, _: pd.DataFrame) -> np.ndarray:
            """For each query its nearest cells that hold k rows, as a mask."""
            order = np.argsort(np.where(always, np.inf, distances(m, centres)), axis=1, kind="stable")
            before = np.cumsum(np.where(always, 0, sizes)[order], axis=1) - np.where(always, 0, sizes)[order]
            mask = np.zeros((len(m), len(cells)), bool)
            np.put_along_axis(mask, order, before < k, axis=1)
            return mask | always

        def within_reach(m: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
            """The cells that may hold a row as near as the k-th found so far: those of the rows found are among them."""
            reach = np.sqrt(np.maximum(2 - 2 * (pdf["kth"].to_numpy(np.float64) - SLACK), 0)) + 1e-9
            return (distances(m, centres) - radii <= reach[:, None]) | always

        def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A query may visit every cell, so a batch is taken in parts."""
            step = max(1, VISITS // len(cells))
            for pdf in batches:
                yield from (pdf.iloc[i:i + step] for i in range(0, len(pdf), step))

        def emit(pdf: pd.DataFrame, mask: np.ndarray) -> pd.DataFrame:
            i, j = np.nonzero(mask)
            return pdf[[qkey]].iloc[i].assign(cell=cells[j].astype(np.int32), n=sizes[j].astype(np.int64))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in few(batches):
                yield emit(pdf, first_cells(matrix(pdf[qvector]), pdf))

        def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in few(batches):
                m = matrix(pdf[qvector])
                yield emit(pdf, within_reach(m, pdf) & ~first_cells(m, pdf))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in few(batches):
                own = np.where(always, np.inf, distances(matrix(pdf[qvector]), centres)).argmin(1)
                yield pdf.assign(home=home[own].astype(np.int32))
        placed = q.mapInPandas(place, f"{qtypes}, home int").withColumn("turn", F.monotonically_increasing_id())
        asked = self._blocks(staged(placed, "placed-queries"))
        layout = cells, sizes, home
        found = top_k_per_group(self._scored(asked.withColumn("kth", F.lit(-2.0)), first_cells, layout, k, qkey, qvector),
                                [qkey], [F.desc("score"), C(self.key)], k)
        kth = found.groupBy(qkey).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("kth"))
        open_q = staged(asked.join(kth, qkey, "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0))), "bounded-queries")
        hits = self._scored(open_q, within_reach, layout, k, qkey, qvector)
        visits = q.mapInPandas(near, visited).unionByName(open_q.select(qkey, qvector, "kth").mapInPandas(rest, visited))
        return top_k_per_group(hits, [qkey], [F.desc("score"), C(self.key)], k), visits

    def _blocks(self, placed: DataFrame) -> DataFrame:
        """Queries with a block number: those of a home are dealt in turn to blocks of bounded size."""
        counts = placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).orderBy("home").collect()  # as many as districts
        blocks = [-(-r.n // BLOCK) for r in counts]
        first = np.cumsum([0, *blocks])[:-1].tolist()
        listed = placed.sparkSession.createDataFrame([(r.home, f, b) for r, f, b in zip(counts, first, blocks)], "home int, first int, blocks int")
        return placed.join(listed, "home").withColumn("block", (C("first") + F.pmod("turn", "blocks")).cast("int")).drop("home", "turn", "first", "blocks")

    def _scored(self, asked: DataFrame, wanted, layout: tuple, k: int, qkey: str, qvector: str) -> DataFrame:
        """The k best rows that each query finds in each part of the rows, not below the query's ``kth``.

        Cells that lie together form districts, which are parts of bounded size; only parts with a cell that a query of the block
        wants meet the block, and there each query is scored against the cells that it wants, by one matrix product.
        """
        key, vector = self.key, self.vector
        spark, (cells, sizes, home) = asked.sparkSession, layout
        splits = -(-np.bincount(home, sizes).astype(np.int64) // BLOCK)  # above 1 where a cell exceeds a block
        first = np.cumsum(splits) - splits
        place = spark.createDataFrame([(int(c), int(first[h]), int(splits[h])) for c, h in zip(cells, home)], "cell int, first int, splits int")
        stored = spark.read.parquet(self._path("rows")).select(key, vector, "cell").withColumn("turn", F.monotonically_increasing_id())
        dealt = stored.join(place, "cell").withColumn("part", (C("first") + F.pmod("turn", "splits")).cast("int")).select("part", "cell", key, vector)
        step = max(1, VISITS // len(cells))

        def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at:at + step]
                    mask, block = wanted(matrix(part[qvector]), part), part["block"].to_numpy()
                    for b in np.unique(block):
                        near = np.unique(home[mask[block == b].any(0)])
                        yield pd.DataFrame({"block": np.full(len(near), b, np.int32), "first": first[near].astype(np.int32), "splits": splits[near].astype(np.int32)})
        met = asked.mapInPandas(meetings, "block int, first int, splits int").distinct()
        met = staged(met.select("block", F.explode(F.sequence("first", C("first") + C("splits") - 1)).alias("part")), "meetings")
        rows, wants = dealt.join(met, "part"), asked.join(met, "block")
        at_cell = {int(c): i for i, c in enumerate(cells)}

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({qkey: right[qkey][:0], key: left[key][:0], "score": np.zeros(0)})
            if not len(left) or not len(right):
                return out
            left = left.sort_values("cell", kind="stable")
            own = np.array([at_cell[c] for c in left["cell"]])
            here, begins = np.unique(own, return_index=True)
            ends = np.append(begins[1:], len(own))
            ids, names, x, m = left[key].to_numpy(), right[qkey].to_numpy(), matrix(left[vector]).T, matrix(right[qvector])
            floor = right["kth"].to_numpy(np.float64) - SLACK  # products of other shapes may round otherwise
            found = [out]
            for at in range(0, len(m), ASKED):
                some = m[at:at + ASKED]
                mask = wanted(some, right.iloc[at:at + ASKED])[:, here]
                pieces = [(0, len(own), np.arange(len(some)))] if mask.all() else [
                    (b, e, np.flatnonzero(mask[:, c])) for c, (b, e) in enumerate(zip(begins, ends)) if mask[:, c].any()]
                hits = []
                for begin, end, who in pieces:
                    scores = some[who] @ x[:, begin:end]
                    i, j = np.nonzero(scores >= floor[at + who][:, None])
                    hits.append((who[i], j + begin, np.round(scores[i, j], 6)))
                if not hits:
                    continue
                i, j, s = (np.concatenate(parts) for parts in zip(*hits))
                order = np.lexsort((ids[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append(pd.DataFrame({qkey: names[at + i[best]], key: ids[j[best]], "score": s[best]}))
            return pd.concat(found[1:]) if len(found) > 1 else out
        kinds = f"{qkey} {asked.schema[qkey].dataType.simpleString()}, {key} {stored.schema[key].dataType.simpleString()}, score double"
        return rows.groupBy("block", "part").cogroup(wants.groupBy("block", "part")).applyInPandas(score, kinds)
