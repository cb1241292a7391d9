"""Nearest neighbours, vector codes and importance resampling against plain Python."""

import hashlib
import math
import os
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_operators import ITEMS, SCHEMA, corpus  # noqa: E402

from check_oracle import rows_of  # noqa: E402
from covermetrics.llm import importance, multiprobe, queries, vector_codes  # noqa: E402

C = F.col


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, v string, tag string, point int")


def with_names(rows):
    """Rows with columns that the operators also use inside."""
    return [(k, v, label, "v", "tag", 3) for k, v, label in rows]


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def single(v):
    return tuple(float(np.float32(x)) for x in v)


ODD = [(900, None, 1), (901, [1.0, None, 0.0, 0.5], 1), (902, [math.nan, 0.0, 0.0, 1.0], None), (903, [math.inf, 0.0, 0.0, 1.0], 2), (904, [], 2),
       (905, [0.5, 0.5], 1)]


# Nearest neighbours.

def nearest_by_hand(rows, k):
    """(query, rank, id, distance) of every query; rows equal in id and vector are one."""
    kept = sorted({(i, single(v)) for i, v, _ in rows if i is not None and sound(v) and any(v) and len(v) == 4})
    out = []
    for i, v in kept:
        if i % 100 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, j) for j, w in kept if (j, w) != (i, v))[:k]
            out += [(i, rank, j, d) for rank, (d, j) in enumerate(near, 1)]
    return sorted(out)


def test_multiprobe_equals_a_full_search_on_a_small_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 5, [float(x) for x in rng.integers(-3, 4, 4) / 4], 1) for i in range(300)]  # many ties and copies
    rows += [(i, [0.25, 0.5, 0.25, 1.0], 1) for i in range(2000, 2400, 4)] + ODD + [(1000, [0.0] * 4, 1), (None, [1.0, 0.0, 0.0, 0.0], 1), (2000, [0.25, 0.5, 0.25, 1.0], 1)]
    found = multiprobe.nearest(embeddings(spark, with_names(rows)).repartition(5), C("id") % 100 == 0, recall=0.9999)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("id", "bigint"), ("score", "double")]
    assert sorted(map(tuple, found.collect())) == nearest_by_hand(rows, 10)


def test_multiprobe_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids, x = np.array(sorted(table)), np.array([table[k] for k in sorted(table)])
    found = {}
    for r in queries.op11_multiprobe_search(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, {})[r.rank] = r
    asked = [i for i in ids if i % 100 == 0]
    assert sorted(found) == asked
    hits = 0
    for q in asked:
        d = np.sqrt(((x - table[q]) ** 2).sum(1))
        d[np.searchsorted(ids, q)] = np.inf
        hits += len({r.vec_id for r in found[q].values()} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert sorted(found[q]) == list(range(1, 11))
        assert all(abs(r.score - d[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in found[q].values())
    assert hits >= 0.9 * 10 * len(asked)


def test_multiprobe_scores_few_vectors_where_neighbours_stand_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 16))
    x = (np.repeat(centres, 12, axis=0) + rng.normal(size=(4800, 16)) * 0.02).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows = multiprobe.points(multiprobe.sound_rows(df, "embedding", "vec_id"), 10)
    h = multiprobe.fit(rows, multiprobe.TABLES, multiprobe.RECALL, 10)
    assert h.dims >= 5 and h.r < 0.3
    _, place = h.cells(x[:50].astype(np.float64))
    visited = [len(multiprobe.best_first(multiprobe.chances(place[0, :, i], h.width, h.r), 0.6)) for i in range(50)]
    assert np.mean(visited) < 8
    found = {}
    for r in multiprobe.nearest(df, C("id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    assert np.mean([len([j for j in found[q] if j // 12 == q // 12]) / 10 for q in range(0, 4800, 100)]) > 0.9


def test_hot_buckets_are_split_into_blocks_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(600, 8)) * 0.001, rng.normal(size=(300, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i * 20, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    whole = sorted(map(tuple, multiprobe.nearest(df, C("id") % 100 == 0).collect()))
    monkeypatch.setattr(multiprobe, "BLOCK", 64)
    monkeypatch.setattr(multiprobe, "HELD", 500)
    assert sorted(map(tuple, multiprobe.nearest(df, C("id") % 100 == 0).collect())) == whole


def test_perturbed_buckets_come_in_order_of_their_chance():
    chance = multiprobe.chances(np.array([0.2, 1.1, 1.9]), 2.0, 0.7)
    options = chance.shape[1]
    every = sorted((-np.prod([chance[d, o] for d, o in enumerate(at)]), at) for at in np.ndindex(*(options,) * 3))
    got = multiprobe.best_first(chance, 0.95)
    values = [np.prod([chance[d, o + options // 2] for d, o in enumerate(row)]) for row in got]
    assert np.allclose(values, [-v for v, _ in every[:len(values)]])
    assert sum(values) >= 0.95 > sum(values[:-1])
    assert np.allclose(chance.sum(1), 1, atol=1e-6)


def test_multiprobe_of_nothing(spark):
    assert multiprobe.nearest(embeddings(spark, []), C("id") % 100 == 0).count() == 0
    assert multiprobe.nearest(embeddings(spark, with_names(ODD[:5])), C("id") % 100 == 0).count() == 0
    one = [(100, [1.0, 2.0, 3.0, 4.0], 1), (7, [1.0, 2.0, 3.0, 5.0], 1)]
    assert [tuple(r) for r in multiprobe.nearest(embeddings(spark, with_names(one)), C("id") % 100 == 0).collect()] == [(100, 1, 7, 1.0)]
    assert multiprobe.nearest(embeddings(spark, with_names(one[1:])), C("id") % 100 == 0).count() == 0
    assert multiprobe.nearest(embeddings(spark, with_names(one[:1])), C("id") % 100 == 0).count() == 0


# Vector codes.

def codes_by_hand(rows, entries, parts, rounds):
    kept = sorted(((i is None, i or 0, [math.floor(1024 * x) for x in single(v)], label) for i, v, label in rows if sound(v) and all(abs(x) < 1 << 17 for x in v)),
                  key=lambda r: r[:3])
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = -(-len(kept[0][2]) // parts)
    cut = [[(r[2] + [0] * width * parts)[p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for (null, i, _, label), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((None if null else i, label, [k for _, k in best], sum(d for d, _ in best)))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    return sorted(((i, c, e, sums[label]) for i, label, c, e in out), key=str), books


@pytest.mark.parametrize("length, entries, parts", [(4, 3, 2), (4, 256, 4), (6, 5, 4)])
def test_vector_codes(spark, length, entries, parts):
    rng = np.random.default_rng(length)
    rows = [(int(i), [float(x) for x in rng.normal(size=length)], int(i) % 3 or None) for i in rng.permutation(400)]
    rows += [(i, [0.125, -0.25, 0.5] * 2 if length == 6 else [0.125, -0.25, 0.5, 0.0], 1) for i in range(500, 700)]
    rows += ODD + [(None, [0.5] * length, 1), (3, [0.25] * length, None), (3, [0.25] * length, None), (800, [2.0 ** 18] + [0.0] * (length - 1), 1)]
    df = embeddings(spark, with_names(rows)).repartition(6)
    coded, books = vector_codes.encode_vectors(df, carry=df.columns, entries=entries, parts=parts, rounds=3)
    got = vector_codes.with_group_errors(coded, "label").select("row.*", "code", "error", "group_error")
    want, want_books = codes_by_hand(rows, entries, parts, 3)
    assert sorted([(r.vec_id, list(r.code), r.error, r.group_error) for r in got.collect()], key=str) == want
    assert books.tolist() == want_books
    assert set(df.columns) < set(got.columns)
    r = got.where("vec_id = 600").first()
    assert ((vector_codes.decode(r.code, books)[:length] - np.floor(1024 * np.array(r.embedding))) ** 2).sum() == r.error


def test_vector_codes_of_nothing(spark):
    for rows in ([], with_names(ODD[:5])):
        coded, books = vector_codes.encode_vectors(embeddings(spark, rows))
        assert coded.count() == 0 and books.size == 0 and vector_codes.with_group_errors(coded, "label").count() == 0
        assert vector_codes.books_digest(books) == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("low, high", [(-2, 3), (-600, 600), (-(1 << 26), 1 << 26)])
def test_trie_finds_the_nearest_entry(low, high):
    rng = np.random.default_rng(high)
    parts, book = rng.integers(low, high, (300, 5)), rng.integers(low, high, (40, 5))
    parts = np.concatenate([parts, parts[:30], book[:10]])
    distinct, n, place, code, error = vector_codes.assign(parts, book)
    distances = ((parts[:, None].astype(object) - book[None].astype(object)) ** 2).sum(-1)
    assert (distinct[place] == parts).all() and n.sum() == len(parts) and len(np.unique(distinct, axis=0)) == len(distinct)
    assert (code[place] == distances.argmin(1)).all() and (error[place] == distances.min(1)).all()


# Importance resampling.

def importance_by_hand(rows, targets, percent=25):
    def grams(text):
        words = brute.ITEM_WORDS.findall(brute.lower(text))
        return words, [" ".join(words[i:i + n]) for n in (1, 2) for i in range(len(words) - n + 1)]

    def bucket(gram):
        return zlib.crc32(gram.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)[1]))
    for text in targets:
        t.update(map(bucket, grams(text)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for k, text in rows:
        words, found = grams(text)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(words)])
    drawn = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): n for n, r in enumerate(drawn[:percent * len(drawn) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def weighed_rows(df, target):
    return sorted((tuple(r) for r in importance.draw(importance.weigh(df, target)).select("row.doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_importance(spark, nothing):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", "x", "x", "x") for k, t in rows], SCHEMA).repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert weighed_rows(docs, items) == importance_by_hand(rows, [t for _, t in ITEMS])
    assert weighed_rows(docs, nothing) == importance_by_hand(rows, [])
    assert weighed_rows(nothing, items) == []


def test_importance_of_repeated_rows_and_null_ids(spark, nothing):
    text = " ".join(f"w{i} Wörter" for i in range(30))
    rows = [(None, text)] * 3 + [(7, text)] * 4 + [(None, None), (8, None), (9, "ONE two"), (9, "one TWO.")]
    df = spark.createDataFrame([(k, t, *"abcd") for k, t in rows], SCHEMA)
    assert weighed_rows(df, nothing) == importance_by_hand(rows, [])
    assert [r[4] for r in weighed_rows(df, nothing) if r[4]] == [1]


def test_resample_returns_whole_documents_of_any_columns(spark):
    rows = [(i, " ".join(f"word{(i * j) % 50}" for j in range(40))) for i in range(40)]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id bigint, text string, row int, score int, grams int")
    kept = importance.resample(df, df.where("doc_id < 3"))
    assert kept.columns == df.columns and kept.count() == 10 and kept.exceptAll(df).count() == 0


def test_grams_are_words_between_boundaries():
    patterns = importance.gram_patterns(3)
    found = [[m[0].decode() for m in p.finditer("ab ab  abc é9".replace("  ", " ").encode(), overlapped=True)] for p in patterns]
    assert found == [["ab", "ab", "abc", "é9"], ["ab ab", "ab abc", "abc é9"], ["ab ab abc", "ab abc é9"]]


@pytest.mark.parametrize("name", ["op12_trie_codes", "op13_overlapped_regex_resampling"])
def test_registered_queries_equal_their_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    found = con.execute(queries.SQL[name])
    want = rows_of([d[0] for d in found.description], found.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
