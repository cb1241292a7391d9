import math
import re

import numpy as np
from pyspark.sql import functions as F

from covermetrics.operators import documents as doc
from covermetrics.operators import feedback, intake, matching, search


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id long, content string")


def test_fixed_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5003))
    rows = sorted(doc.chunk_fixed(docs_of(spark, [text, "short", ""]), 1000, 100).collect(), key=lambda r: (r.document_id, r.chunk_index))
    mine = [r.chunk_text for r in rows if r.document_id == 0]
    assert mine[0] + "".join(c[100:] for c in mine[1:]) == text
    assert [r.chunk_text for r in rows if r.document_id == 1] == ["short"]
    assert not [r for r in rows if r.document_id == 2]


def test_document_stats_of_the_whole_text(spark, tmp_path):
    from covermetrics.plans.registry import Book, all_plans
    rows = [(1, "x" * 20000, "en", "web", 20000, "", ""), (2, "short", "en", "web", 5, "", "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, hits string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = all_plans()["document_stats_whole"].build(Book(spark, str(tmp_path))).collect()
    # eleven chunks of the long text, 500 tokens each, and one of two tokens
    assert [(r.documents, r.chunks, r.avg_tokens) for r in got] == [(2, 12, 459.0)]


def test_keyword_search_falls_back_to_whole_texts(spark):
    docs = docs_of(spark, ["alpha beta", "gamma delta"]).withColumn("title", F.lit("t"))
    chunks = spark.createDataFrame([(0, 1, "alpha")], "document_id long, chunk_index int, chunk_text string")
    assert [r.document_id for r in doc.keyword_search(docs, chunks, "alpha clause", first_term_only=True).collect()] == [0]
    assert [r.document_id for r in doc.keyword_search(docs, chunks, "alpha beta").collect()] == [0]
    assert doc.keyword_search(docs, chunks, "alpha clause").count() == 0
    assert [r.document_id for r in doc.keyword_search(docs, chunks, "DELTA").collect()] == [1]


def test_ranked_search_equals_brute_force(spark):
    texts = ["the red fox runs", "the blue fox sleeps sleeps", "the green bird", "red red red bird", "the the the", "a lonely owl"]
    questions = ["red fox", "sleeps bird", "the nothing"]
    got = {(r.question_id, r.document_id): r.score for r in search.ranked_search(
        docs_of(spark, texts), spark.createDataFrame(list(enumerate(questions)), "question_id long, question string"), k=3).collect()}
    words = [re.findall(r"\w+", t) for t in texts]
    n, avg = len(texts), sum(map(len, words)) / len(texts)
    want = {}
    for qi, q in enumerate(questions):
        scores = {}
        for t in set(q.split()):
            df = sum(t in w for w in words)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            if not df:
                continue
            for di, w in enumerate(words):
                tf = w.count(t)
                if tf:
                    scores[di] = scores.get(di, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        for di, s in sorted(scores.items(), key=lambda x: (-round(x[1], 5), x[0]))[:3]:
            want[(qi, di)] = round(s, 5)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_vector_search_equals_brute_force_in_one_or_many_blocks(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(200, 8)), rng.normal(size=(9, 8))
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vector_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, query_vector array<double>")
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = {(i, int(j)) for i in range(9) for j in np.argsort(-s[i])[:4]}
    for block in (2048, 4):
        got = doc.vector_search(corpus, queries, k=4, block=block).collect()
        assert {(r.query_id, r.vector_id) for r in got} == want


def test_sentiment_and_themes_with_the_fixed_lists(spark):
    texts = spark.createDataFrame([(1, "Great service, helpful agent!"), (2, "Claim denied, slow and rude"), (3, "Hello there"), (4, None)], "id int, t string")
    bands = {r.id: r.band for r in feedback.sentiment(texts, feedback.default_lexicon(spark), ["id"], "t").collect()}
    assert bands == {1: "Positive", 2: "Negative", 3: "Neutral", 4: "Neutral"}
    themes = {r.id: r.theme for r in feedback.classify(spark.createDataFrame([(1, "invoice charge and billing fee"), (2, "renewal will expire")], "id int, t string"),
                                                      feedback.theme_keywords(spark), ["id"], "t").collect()}
    assert themes == {1: "Billing Issues", 2: "Policy Renewal"}


def test_match_prefers_exact_names(spark):
    ours = spark.createDataFrame([("Auto Elite", 110.0), ("Home Plus", 90.0)], "name string, price double")
    theirs = spark.createDataFrame([("auto elite", 100.0), ("Home Guard Plus", 100.0), ("Boat", 5.0)], "name string, price double")
    got = {r.name: (r.match, r.price_delta_pct) for r in matching.match_products(ours, theirs).collect()}
    assert got == {"Auto Elite": ("auto elite", 10.0), "Home Plus": ("Home Guard Plus", -10.0)}


def test_intake_statuses_and_fallbacks(spark):
    good = ('{"policy_number": "HO-12345", "policy_type": "Commercial Auto", "named_insured": "ACME", "annual_premium": "$1,200", "effective_date": "2024-01-01",'
            ' "expiration_date": "soon", "coverages": [{"line": "Wind deductible", "deductible": "5"}, {"line": "Coverage A", "limit": "250,000"},'
            ' {"line": "Deductible", "deductible": "$500"}], "property": {"year_built": "1999"}}')
    raw = spark.createDataFrame([("a", "```json\n" + good + "\n```"), ("b", "{broken json here"), ("c", "x"), ("d", '{"policy_number": "null"}'), ("e", None)],
                                "file_name string, extracted string")
    out = intake.intake_policies(raw, "2024-06-30", short_ids=True)
    assert {r.file_name: r.status for r in out.log.collect()} == {
        "a": "SUCCESS", "b": "JSON_PARSE_FAILED", "c": "PARSE_FAILED", "d": "NO_POLICY_NUMBER", "e": "PARSE_FAILED"}
    p = out.policies.collect()[0]
    assert (p.policy_id, p.line_of_business, p.premium, p.coverage, p.deductible, p.expiration_date) == ("HO-12345", "Commercial Lines", 1200.0, 250000.0, 500.0, None)
    assert out.customers.collect()[0].first_name == "ACME"
    assert [r.child_id for r in out.coverages.orderBy("child_id").collect()] == ["COV-12345-01", "COV-12345-02", "COV-12345-03"]
    assert out.vehicles.count() == 0 and out.property.collect()[0].year_built == 1999


def catalogue_of(spark, names):
    return spark.createDataFrame([(n, 100.0 + i) for i, n in enumerate(names)], "name string, price double")


def test_words_used_alike_get_alike_vectors(spark):
    names = [f"{kind} {word} plan" for kind in ("gold", "silver", "basic") for word in ("auto", "car")] + ["deep sea cargo", "river cargo hull"]
    both = catalogue_of(spark, names)
    frequencies = matching.word_frequencies(both)
    vectors = {}
    for r in matching.word_vectors(both, 32).collect():
        vectors.setdefault(r.w, np.zeros(32))[r.dim] = r.x
    cosine = lambda a, b: vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])
    assert cosine("auto", "car") > 0.999 > 0.5 > cosine("auto", "hull")  # they never stand together, but with the same words
    lengths = matching.name_vectors(both, matching.word_vectors(both, 32), frequencies).groupBy("name").agg(F.sum(F.col("x") * F.col("x")).alias("l")).collect()
    assert len(lengths) == len(names) and all(abs(r.l - 1) < 1e-9 for r in lengths)


def test_semantic_score_prefers_the_word_used_alike(spark):
    ours = catalogue_of(spark, ["gold auto plan", "silver auto plan", "basic auto plan", "unheard"])
    theirs = catalogue_of(spark, ["gold car plan", "gold sea plan", "silver car plan", "basic car plan", "deep sea hull", "cold sea hull"])
    got = {r.name: r for r in matching.match_products_semantic(ours, theirs).collect()}
    assert got["gold auto plan"].match == "gold car plan" and got["gold auto plan"].semantic > 0.9
    assert got["unheard"].match is None and got["unheard"].score is None


def test_sliced_words_make_the_same_pairs(spark):
    names = [f"common w{i % 7} v{i}" for i in range(60)]
    a = spark.createDataFrame([(n, w) for n in names for w in n.split()], "name string, w string")
    b = a.withColumnRenamed("name", "match")
    pairs = [sorted(map(tuple, matching.word_pairs(a, b, size).collect())) for size in (7, 10 ** 6)]
    assert pairs[0] == pairs[1] == sorted((x, y) for x in names for y in names)


def test_compare_items_and_attributes(spark):
    a = spark.createDataFrame([(1, "Flood", 5.0), (1, "Theft", 1.0)], "k int, name string, amount double")
    b = spark.createDataFrame([(1, "Flood", 9.0), (2, "Quake", None)], a.schema)
    assert sorted(map(tuple, matching.compare_items(a, b, ["k"], "name", "amount").collect())) == [
        (1, "Flood", "both", 5.0, 9.0), (1, "Theft", "only a", 1.0, None), (2, "Quake", "only b", None, None)]
    x = spark.createDataFrame([(1, 1950, None, "x")], "k int, year int, roof string, zone string")
    y = spark.createDataFrame([(1, 1960, None, "x")], x.schema)
    assert [tuple(r) for r in matching.compare_attributes(x, y, ["k"], ["year", "roof", "zone"]).collect()] == [(1, "year", "1950", "1960")]


def test_group_terms_count_documents_of_several_rows_once(spark):
    rows = [(1, "x", "red red blue"), (1, "x", "red green"), (2, "x", "blue"), (2, "y", "blue"), (None, "y", "red"), (None, "y", "red"), (3, None, "green"), (4, "y", None)]
    got = feedback.group_terms(spark.createDataFrame(rows, "id int, g string, t string"), "g", "id", "t", k=9)
    want = {("x", "red"): (3, 2), ("y", "red"): (2, 2), ("x", "blue"): (2, 3), ("y", "blue"): (1, 3), ("x", "green"): (1, 2), (None, "green"): (1, 2)}
    assert {(r.g, r.term): (r.tf, r.weight) for r in got.collect()} == {
        k: (tf, round(tf * math.log(8 / df), 4)) for k, (tf, df) in want.items()}


def test_group_terms_shuffle_the_vocabulary_and_not_the_words_of_each_text(spark, monkeypatch):
    written = []
    monkeypatch.setattr(feedback, "staged", lambda df, purpose: written.append((purpose, df._jdf.queryExecution().executedPlan().toString())) or df)
    texts = spark.createDataFrame([(i, "x", "red blue red") for i in range(20)], "id int, g string, t string")
    feedback.group_terms(texts, "g", "id", "t").collect()
    plan = dict(written)["group-words"]
    assert "hashpartitioning(g" in plan and "hashpartitioning(id" not in plan


def test_classify_filters_words_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(feedback, "staged", lambda df, purpose: df)
    texts = spark.createDataFrame([(1, "invoice invoice and renewal"), (1, "fee"), (2, "nothing"), (None, "renewal")], "id int, t string")
    found = feedback.classify(texts, feedback.theme_keywords(spark), ["id"], "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert {(r.id, r.theme, r.strength) for r in found.collect()} == {(1, "Billing Issues", 3.0), (2, None, None), (None, None, None)}


def test_best_sentence_alone_carries_its_text(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(feedback, "staged", lambda df, purpose: staged.append(purpose) or df)
    texts = spark.createDataFrame([(1, "x", "Red sky. Red sea and sky"), (2, "x", "Red sky"), (2, "x", "Red sky"), (3, "y", None)], "id int, g string, t string")
    got = feedback.central_sentences(texts, "g", "id", "t").collect()
    assert [(r.g, r.id, r.pos, r.score, r.sentence) for r in got] == [("x", 1, 0, 3.0, "Red sky")] and "best-sentences" in staged
