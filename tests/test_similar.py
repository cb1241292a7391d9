"""The similarity self-join against all pairs compared by hand."""

import random

import pytest

from covermetrics.operators.quality import similar

SCHEMA = "id bigint, block string, text string"


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b):
            now.append(min(before[j + 1] + 1, now[j] + 1, before[j] + (x != y)))
        before = now
    return before[-1]


def classes(rows, at_least):
    """(id, class, members, links) by comparing all texts of each block."""
    values = {}
    for key, block, text in rows:
        if text is not None:
            values.setdefault((block, text.lower()), []).append(key)
    parent, links = {v: v for v in values}, dict.fromkeys(values, 0)

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    nodes = sorted(values, key=str)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            longest = max(len(a[1]), len(b[1]))
            if a[0] == b[0] and longest and round(1 - distance(a[1], b[1]) / longest, 4) >= at_least:
                parent[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    groups = {}
    for v in values:
        groups.setdefault(root(v), []).extend(values[v])
    return sorted((k, min(groups[root(v)]), len(groups[root(v)]), links[v]) for v, keys in values.items() for k in keys if len(groups[root(v)]) > 1)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde 12") for _ in range(rng.randint(0, 24))) for _ in range(n // 6)] + ["aaaaaaaaaa", "abababababab", "a", "ab", ""]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(text))
            if rng.random() < 0.5:
                text[at:at + rng.randint(0, 1)] = rng.choice("abz")
            else:
                text[at:at + 1] = []
        out.append((i, rng.choice(["x", "y", None]), "".join(text)))
    return out + [(500, "x", None), (501, "x", None), (502, "y", "SAME text"), (503, "y", "same TEXT"), (503, "y", "same text"), (504, "z", "same text")]


def found(spark, rows, *args):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in similar.similarity_classes(df, ["block"], "id", "text", *args).collect())


@pytest.mark.parametrize("seed, at_least, slice_size", [(1, 0.8, 512), (2, 0.8, 3), (3, 0.65, 512), (4, 0.9, 512)])
def test_classes_equal_all_pairs(spark, seed, at_least, slice_size):
    rows = rows_of(seed)
    want = classes(rows, at_least)
    assert want and found(spark, rows, at_least, slice_size) == want


def test_members_like_each_other_but_not_the_first_come_out(spark):
    rows = [(1, "Ann", "completely other"), (2, "Ann", "ann.smith@x.org"), (3, "Ann", "ann.smyth@x.org"), (4, "Ann", "anna.smyth@x.org")]
    assert found(spark, rows, 0.9) == [(2, 2, 3, 1), (3, 2, 3, 2), (4, 2, 3, 1)]


def test_long_chains_close(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("a", "b")], "a string, b string")
    assert {(r.component, r.node >= "a") for r in similar.components(links).collect()} == {("000", False), ("a", True)}


def test_nothing_to_link(spark):
    assert found(spark, []) == [] and found(spark, [(1, "x", "one"), (2, "y", "one"), (3, "x", None)]) == []
    with pytest.raises(ValueError):
        found(spark, [], 0.3)


def test_copies_make_no_pairs(spark):
    rows = [(i, "x", "the very same") for i in range(2000)] + [(2000, "x", "the very samE!")]
    got = found(spark, rows, 0.9)
    assert len(got) == 2001 and {r[1:] for r in got} == {(0, 2001, 1)}


def test_crowded_keys_take_in_further_grams(spark):
    rows = spark.createDataFrame([("x", f"customer.{i:06}@place.example.com") for i in range(0, 90000, 90)], "block string, v string")
    def most(crowd):
        met = similar.prefixes(rows, ["block"], 0.95, 2, crowd).groupBy("gram").agg({"v": "count"})
        return max(r[1] for r in met.collect())
    assert most(20) <= 20 < most(10 ** 6)
    def pairs():
        return {(r.a, r.b) for r in similar.similar_pairs(rows, ["block"], 0.95, 2).collect()}
    fine = pairs()
    assert fine and all(round(1 - distance(a, b) / len(a), 4) >= 0.95 for a, b in list(fine)[:50])


@pytest.mark.parametrize("seed, at_least", [(5, 0.8), (6, 0.65), (7, 0.9)])
def test_pairs_under_longer_keys_equal_all_pairs(spark, monkeypatch, seed, at_least):
    plain = similar.prefixes
    monkeypatch.setattr(similar, "prefixes", lambda *args: plain(*args, 2))
    rows = rows_of(seed)
    want = classes(rows, at_least)
    assert want and found(spark, rows, at_least) == want


@pytest.mark.parametrize("seed", [8, 9])
def test_texts_two_edits_apart_meet(spark, seed):
    rng = random.Random(seed)
    texts = {"", "a", "b", "aa", "aaa", "ab", "abab", "ba"} | {"".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(60)}
    rows = spark.createDataFrame([(b, t) for t in texts for b in ("x", None)], "block string, v string")
    met = {(r._x._b.block, *sorted((r._x.v, r._y.v))) for r in similar.close_pairs(rows, ["block"]).collect()}
    near = {(b, x, y) for x in texts for y in texts for b in ("x", None) if x < y and distance(x, y) <= 2}
    assert near and near <= met


def test_dense_numbers_are_not_compared_in_crowds(spark):
    rows = spark.createDataFrame([("x", f"customer.{i:09}@household.example.com") for i in range(0, 60000, 20)], "block string, v string")
    met = similar.close_pairs(rows, ["block"])
    near = met.filter("levenshtein(_x.v, _y.v) <= 2").count()
    assert near <= met.count() <= 4 * near
