import base64
import os
import sys

import public_tokenizers
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from covermetrics.llm import line_crf  # noqa: E402
from covermetrics.llm.rows import written  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_equals_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, steps = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, FOLDER), "test-stage")
        steps.append((name, before, {r.doc_id: r for r in docs.collect()}))
        if n < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    quality, lines, near, benchmark, tokens = steps

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1]
    bad = [k for k, q in labels.items() if q == 0]
    assert all(k in quality[2] for k in good) and sum(k not in quality[2] for k in bad) >= 0.8 * len(bad)
    assert all(quality[2][k].text == quality[1][k] for k in quality[2])

    assert {k: r.text for k, r in lines[2].items()} == brute.dedup_lines(lines[1].items())
    assert all(r.n_chars == len(r.text) for r in lines[2].values())

    worded = [(k, t) for k, t in near[1].items() if brute.words(t)]
    classes = brute.near_classes(worded)
    assert set(near[2]) == set(classes.values()) | {k for k, t in near[1].items() if not brute.words(t)}

    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    judged = {k: brute.hits(t, items) for k, t in benchmark[1].items()}
    assert set(benchmark[2]) == {k for k, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    assert all(brute.hits(r.text, items)[1] == 0 or judged[k][1] for k, r in benchmark[2].items())
    assert all(r.text == benchmark[1][k] for k, r in benchmark[2].items() if not judged[k][1])

    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, text in tokens[1].items():
        assert tokens[2][k].ids == theirs.encode_ordinary(text) and bytes(tokens[2][k].decoded) == text.encode()


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, hits string"
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (None, "some plain words", "en", "s", 16, "x", "y"),
            (3, "some plain words", "en", "s", 16, "x", "y"), (3, "some plain words", "en", "s", 16, "x", "y")]
    for name, data in (("full", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted(str(r.doc_id) for r in got) == (["1", "2", "3"] if data else [])


def test_score_column_is_not_an_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    assert line_crf.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")) is not None
