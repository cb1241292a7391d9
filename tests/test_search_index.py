"""The stored search index: segments, replacements, replays and compaction against a ranking of all texts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from covermetrics.operators import documents as doc
from covermetrics.operators import search
from covermetrics.session import scratch_path
from covermetrics.streaming import jobs

SCHEMA = "document_id bigint, content string"
QUESTIONS = [(1, "amber fox"), (2, "the river"), (3, "unheardof word"), (4, "")]


def texts(seed, ids):
    rng = random.Random(seed)
    words = ["amber", "fox", "river", "the", "stone", "übung", "cloud", "9th"]
    return [(i, " ".join(rng.choices(words, weights=[1, 2, 3, 20, 2, 1, 2, 1], k=rng.randint(1, 90)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def whole_ranking(spark, rows, index, k=5):
    chunks = doc.chunk_fixed(frame(spark, rows), index.size, index.overlap)
    return hits(search.ranked_search(chunks, questions(spark), k, ["document_id", "chunk_index"], "chunk_text"))


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")


def hits(df):
    return sorted((r.question_id, r["rank"], r.document_id, r.chunk_index, r.score) for r in df.collect())


def vocabulary(rows):
    return Counter(w for _, t in rows for w in set(re.findall(r"\w+", (t or "").lower())))


@pytest.fixture
def index(spark):
    return search.SearchIndex(scratch_path(spark, "t-index"), size=120, overlap=20, buckets=8)


def test_search_over_segments_equals_ranking_of_all_texts(spark, index):
    first, second = dict(texts(1, range(40))), dict(texts(2, range(30, 60)))
    second |= {5: None, 6: "", 7: "amber amber amber"}
    index.add(frame(spark, list(first.items())), 0)
    assert hits(index.search(questions(spark))) == whole_ranking(spark, list(first.items()), index)
    index.add(frame(spark, list(second.items())), 1)
    now = list((first | second).items())
    assert hits(index.search(questions(spark))) == whole_ranking(spark, now, index)
    assert {r.term: r.documents for r in index.terms(spark).collect()} == vocabulary(now)
    again = {30: "river of stone", 5: "fox again"}
    index.add(frame(spark, list(again.items())), 2)
    now = list((first | second | again).items())
    assert hits(index.search(questions(spark))) == whole_ranking(spark, now, index)
    assert {r.term: r.documents for r in index.terms(spark).collect()} == vocabulary(now)
    assert index.with_text(index.search(questions(spark), 1000)).filter("document_id = 5").select("chunk_text").distinct().collect() == [("fox again",)]
    assert index.table(spark, "totals").agg(F.sum("documents")).first()[0] == len(now)
    small = index.compacted(spark, scratch_path(spark, "t-index"))
    assert hits(small.search(questions(spark))) == hits(index.search(questions(spark)))
    assert small.table(spark, "chunks").count() == index.chunks(spark).count() < index.table(spark, "chunks").count()
    small.add(frame(spark, [(30, "amber fox"), (99, "fox")]), 3)
    now = dict(now) | {30: "amber fox", 99: "fox"}
    assert hits(small.search(questions(spark))) == whole_ranking(spark, list(now.items()), index)


def test_replayed_segment_counts_once(spark, index):
    rows = texts(3, range(20))
    for segment in (0, 1, 1):
        index.add(frame(spark, rows[segment * 10:segment * 10 + 12]), segment)
    assert hits(index.search(questions(spark))) == whole_ranking(spark, rows, index)


def test_repeated_ids_in_a_batch_keep_one_text(spark, index):
    index.add(frame(spark, [(1, "amber"), (1, "fox"), (1, "fox"), (2, "river")]), 0)
    assert hits(index.search(questions(spark))) == whole_ranking(spark, [(1, "fox"), (2, "river")], index)


def test_search_of_nothing(spark, index):
    assert index.search(questions(spark)).count() == 0
    index.add(frame(spark, []), 0)
    assert index.search(questions(spark)).count() == 0 and index.compacted(spark, scratch_path(spark, "t-index")).terms(spark).count() == 0


def test_search_reads_no_text_and_only_asked_buckets(spark, index):
    index.add(frame(spark, texts(4, range(30))), 0)
    one = spark.createDataFrame([(1, "amber")], "question_id int, question string")
    plan = index.search(one)._jdf.queryExecution().executedPlan().toString()
    assert "chunk_text" not in plan and "content" not in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and "term#" in line]
    assert scans and all("PartitionFilters" in line and "bucket" in line for line in scans)


def test_hot_words_are_sliced_without_changing_the_ranking(spark):
    rows = texts(5, range(200))
    found = search.postings(frame(spark, rows), ["document_id"], "content").filter("term <> ''")
    asked = search.asked_words(questions(spark), "question_id", "question")
    n, average = F.lit(200.0), F.lit(40.0)
    a, b = (sorted(map(tuple, search.rank(found, asked, n, average, ["document_id"], "question_id", 9, split).collect())) for split in (10, 10 ** 6))
    assert a == b and a


def test_index_stream_drains_batches(spark, index):
    folder, checkpoint = scratch_path(spark, "t-filings"), scratch_path(spark, "t-filings-checkpoint")
    rows = texts(6, range(30))
    for part in (rows[:12], rows[12:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        jobs.drain(jobs.index_stream(jobs.file_stream(spark, folder, frame(spark, []).schema), index, checkpoint))
    assert index.table(spark, "totals").count() == 2
    assert hits(index.search(questions(spark))) == whole_ranking(spark, rows, index)


def test_texts_and_questions_that_share_words_are_never_rows(spark):
    found = search.postings(frame(spark, texts(7, range(60)) + [(None, "amber stone"), (None, "stone")]), ["document_id"], "content").filter("term <> ''")
    asked = search.asked_words(spark.createDataFrame([*QUESTIONS, (1, "amber fox"), (None, "stone")], "question_id int, question string"), "question_id", "question")
    best = search.rank(found, asked, F.lit(62.0), F.lit(40.0), ["document_id"], "question_id", 100, 20)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "question_id" in x and "document_id" in x]
    twice = {(r.question_id, r.document_id): r.score for r in best.collect()}
    once = {r.document_id: r.score for r in search.rank(found, asked.distinct(), F.lit(62.0), F.lit(40.0), ["document_id"], "question_id", 100).collect() if r.question_id == 1}
    assert once and all(abs(twice[1, d] - 2 * s) < 3e-5 for d, s in once.items())  # a question that comes twice counts twice
    assert (None, None) in twice


def test_words_of_a_chunk_are_counted_without_a_shuffle(spark):
    rows = [(1, 1, "Red red blue"), (1, 2, "blue"), (2, 1, ""), (None, 1, None), (3, 1, "é é É x")]
    texts = spark.createDataFrame(rows, "document_id bigint, chunk_index int, chunk_text string")
    key = ["document_id", "chunk_index"]
    found = search.row_postings(texts, key, "chunk_text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = search.postings(texts, key, "chunk_text")
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
