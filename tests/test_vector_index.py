"""The cell index equals a full search, and skips cells where vectors lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covermetrics.operators import documents as doc
from covermetrics.operators import vector_index
from covermetrics.operators.vector_index import VectorIndex
from covermetrics.session import scratch_path


def corpus_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vector_id long, vector array<double>")


def queries_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, query_vector array<double>")


def by_hand(x, q, k):
    scores = np.round(vector_index.unit(q) @ vector_index.unit(x).T, 6)
    out = []
    for i, s in enumerate(scores):
        order = np.lexsort((np.arange(len(x)), -s))[:k]
        out += [(i, n, int(j), s[j]) for n, j in enumerate(order, 1)]
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.vector_id, r.score) for r in df.collect())


@pytest.fixture
def index(spark):
    return VectorIndex(scratch_path(spark, "t-vectors"))


def test_equals_a_full_search(spark, index, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 6)), rng.integers(-1, 2, (60, 6)).astype(float), np.zeros((3, 6))])
    x[20:26] = x[3]
    q = np.concatenate([x[:30], rng.normal(size=(10, 6)), np.zeros((1, 6))])
    nulls = spark.createDataFrame([(999, None), (998, [])], "vector_id long, vector array<double>")
    index.build(corpus_of(spark, x).unionByName(nulls).repartition(4))
    assert found(index.search(queries_of(spark, q), 5)) == by_hand(x, q, 5)


def test_skips_cells_of_clustered_vectors(spark, index):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(1200, 8)) * 0.01
    hits, visits = index.build(corpus_of(spark, x)).search_with_visits(queries_of(spark, x[::60]), 4)
    assert found(hits) == by_hand(x, x[::60], 4)
    share = visits.agg(F.sum("n")).first()[0] / (20 * 1200)
    assert share < 0.2


def test_many_queries_use_the_cells(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(200, 4)), rng.normal(size=(30, 4))
    for block in (8, 2048):
        got = doc.vector_search(corpus_of(spark, x), queries_of(spark, q), k=3, block=block)
        assert [r[:3] for r in found(got)] == [r[:3] for r in by_hand(x, q, 3)]


def test_nothing_to_search(spark, index):
    index.build(corpus_of(spark, np.zeros((0, 4))))
    assert index.search(queries_of(spark, np.ones((2, 4))), 3).count() == 0
    few = VectorIndex(scratch_path(spark, "t-vectors")).build(corpus_of(spark, np.eye(4)[:2]))
    assert [r[:3] for r in found(few.search(queries_of(spark, np.ones((1, 4))), 3))] == [(0, 1, 0), (0, 2, 1)]


def test_visits_are_made_in_small_parts(spark, index, monkeypatch):
    sizes = []
    monkeypatch.setattr(vector_index, "VISITS", 32)
    x = np.random.default_rng(4).normal(size=(200, 4))
    index.build(corpus_of(spark, x))
    frames = type(spark.range(1)).mapInPandas
    def watched(self, make, schema):
        if "cell int, n bigint" in schema:
            pdf = queries_of(spark, x).toPandas().assign(kth=-2.0)
            sizes.extend(len(part) for part in make(iter([pdf])))
        return frames(self, make, schema)
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", watched)
    assert found(index.search(queries_of(spark, x), 3)) == by_hand(x, x, 3)
    assert sizes and max(sizes) <= 32


def test_vectors_travel_to_blocks_not_to_cells(spark, index, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    monkeypatch.setattr(vector_index, "ASKED", 16)
    x = np.random.default_rng(5).normal(size=(200, 5))
    x[50:110] = x[7]  # a cell of more rows than a block
    kinds, frames = [], type(spark.range(1)).mapInPandas

    def watched(self, make, schema):
        kinds.append(schema)
        return frames(self, make, schema)
    index.build(corpus_of(spark, x))
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", watched)
    assert found(index.search(queries_of(spark, x), 3)) == by_hand(x, x, 3)
    assert kinds and not any("cell int" in k and "query_vector" in k for k in kinds)


def test_repeated_and_missing_keys_are_one_group(spark, index):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vector_id long, vector array<double>")
    asked = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (None, [1.0, 0.0])], "query_id long, query_vector array<double>")
    got = index.build(rows).search(asked, 3).collect()
    assert sorted((str(r.query_id), r["rank"], r.vector_id, r.score) for r in got) == [
        ("5", 1, 1, 1.0), ("5", 2, 1, 1.0), ("5", 3, 3, 1.0), ("None", 1, 1, 1.0), ("None", 2, 1, 1.0), ("None", 3, 2, 0.995037)]


def test_districts_hold_neighbouring_cells():
    centres = np.array([[0.0, 0], [9, 0], [1, 0], [8, 0], [20, 0]])
    home = vector_index.districts(centres, np.array([3, 5, 3, 5, 30]), 10)
    assert home[0] == home[2] != home[1] == home[3] and len(set(home)) == 3
