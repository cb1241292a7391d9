"""Free text from customers: sentiment, themes, term summaries, key sentences.

Models are replaced by word lists: a text scores by the words it holds. Words are counted
per text first; then each distinct (text, word) meets the list once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.functions.numbers import rounded
from covermetrics.functions.strings import tokens
from covermetrics.operators.relational import attach_group_facts, top_k_per_group
from covermetrics.session import staged

# A bound for the rows of a broadcast: fewer words than this are more than its share of all uses.
SENTENCE_WORDS = 50_000

# A small general lexicon and the eight customer themes with their cue words.
POSITIVE = ("good", "great", "excellent", "easy", "fast", "quick", "helpful", "friendly", "happy", "satisfied", "smooth", "clear", "fair", "recommend", "thanks")
NEGATIVE = ("bad", "poor", "slow", "delay", "delayed", "denied", "expensive", "confusing", "rude", "unhappy", "frustrated", "error", "wrong", "late", "cancel")
THEMES: Mapping[str, Sequence[str]] = {
    "Claims Speed": ("claim", "claims", "slow", "fast", "quick", "delay", "adjuster"),
    "Premium Pricing": ("premium", "price", "pricing", "expensive", "rate", "cost", "increase"),
    "Coverage Gaps": ("coverage", "covered", "exclusion", "denied", "gap", "limit"),
    "Agent Service": ("agent", "helpful", "rude", "friendly", "service", "representative"),
    "Billing Issues": ("bill", "billing", "invoice", "payment", "charge", "charged", "fee"),
    "Policy Renewal": ("renew", "renewal", "expire", "expiration", "cancel"),
    "Communication": ("call", "email", "response", "contact", "explain", "confusing", "update"),
    "General Satisfaction": ("happy", "satisfied", "great", "good", "excellent", "recommend", "thanks"),
}


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, 1.0) for w in POSITIVE] + [(w, -1.0) for w in NEGATIVE], "term string, weight double")


def theme_keywords(spark: SparkSession, themes: Mapping[str, Sequence[str]] = THEMES) -> DataFrame:
    return spark.createDataFrame([(t, w, 1.0) for t, words in themes.items() for w in words], "theme string, term string, weight double")


def word_counts(texts: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Distinct words of each text with their counts."""
    return texts.select(*key, F.explode(tokens(text)).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))


def sentiment(texts: DataFrame, lexicon: DataFrame, key: Sequence[str], text: str, cut: float = 0.05) -> DataFrame:
    """Mean word weight of each text and its band; texts without known words are neutral.

    The texts are split into words once. A frequent word's postings never gather in one task: they meet its weight by
    broadcast.
    """
    counts = staged(word_counts(texts, key, text), "word-counts")
    uses = counts.groupBy("term").agg(F.count(F.lit(1)).alias("group_rows"))
    known = attach_group_facts(counts, staged(uses.join(lexicon, "term"), "word-weights"), ["term"])
    score = known.groupBy(*key).agg((F.sum(F.col("n") * F.col("weight")) / F.sum("n")).alias("_s"))
    joined = texts.select(*key).join(score, list(key), "left").withColumn("sentiment", rounded(F.coalesce("_s", F.lit(0.0)), 4))
    band = F.when(F.col("sentiment") > cut, "Positive").when(F.col("sentiment") < -cut, "Negative").otherwise("Neutral")
    return joined.drop("_s").withColumn("band", band)


def induced_lexicon(texts: DataFrame, key: str, text: str, positive: str, at_least: int = 1) -> DataFrame:
    """Word weights from rated texts: share of positive texts less share of negative texts with the word.
    Words in fewer than `at_least` rated texts are left out."""
    sides = texts.agg(F.struct(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))).scalar()
    words = texts.select(key, positive, F.explode(F.array_distinct(tokens(text))).alias("term"))
    freq = words.groupBy("term").agg(F.count_if(positive).alias("a"), F.count_if(~F.col(positive)).alias("b"))
    kept = freq.filter(F.col("a") + F.col("b") >= at_least).withColumn("_s", sides)
    return kept.select("term", rounded((F.col("a") + 0.5) / (F.col("_s.p") + 1) - (F.col("b") + 0.5) / (F.col("_s.q") + 1), 6).alias("weight"))


def classify(texts: DataFrame, keywords: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """The theme with the greatest summed keyword weight; ties go to the first name. A text with none of the keywords has
    NULL theme and strength.

    The theme list is written once, so that its size is known; only its words are counted per text.
    """
    keywords = staged(keywords, "keywords")
    words = texts.select(*key, F.explode(tokens(text)).alias("term")).join(keywords.select("term").distinct(), "term", "left_semi")
    counts = words.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))
    scores = counts.join(keywords, "term").groupBy(*key, "theme").agg(
        rounded(F.sum(F.col("n") * F.col("weight")), 6).alias("s"))
    best = scores.groupBy(*key).agg(F.min_by("theme", F.struct(-F.col("s"), F.col("theme"))).alias("theme"), F.max("s").alias("strength"))
    return texts.select(*key).distinct().join(best, list(key), "left")


def group_terms(texts: DataFrame, group: str, key: str, text: str, k: int = 5, min_docs: int = 1) -> DataFrame:
    """Words that set a group apart: k best by term count times log(documents / document count), of the words that
    `min_docs` documents or more use.

    A document that is one row counts its own words, so what is shuffled is the vocabulary of each task; only documents
    of several rows are carried word by word.
    """
    counts = staged(_group_counts(texts.select(key, group, text), group, key, text), "group-words")
    n = texts.agg(F.count(F.lit(1))).scalar()
    df = counts.groupBy("term").agg(F.sum("users").alias("df")).filter(F.col("df") >= min_docs)
    tf = counts.select(group, "term", "tf")
    weight = rounded(F.col("tf") * F.log(n.cast("double") / F.col("df")), 4)
    return top_k_per_group(tf.join(df, "term").withColumn("weight", weight), [group], [F.desc("weight"), F.col("term")], k).drop("df")


def _group_counts(texts: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, term, tf, users): how often a group uses a word, and in how many of its documents."""
    repeated = staged(texts.groupBy(key, group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.col(key).alias("_key"), F.col(group).alias("_group")), "repeated-documents")
    again = F.col(key).eqNullSafe(F.col("_key")) & F.col(group).eqNullSafe(F.col("_group"))
    several = not repeated.isEmpty()
    single = texts.join(repeated, again, "left_anti") if several else texts
    words = tokens(text)
    uses = F.concat(F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(False).alias("first"))),
                    F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("term"), F.lit(True).alias("first"))))
    found = single.select(group, F.explode(uses).alias("_w")).groupBy(group, F.col("_w.term").alias("term")).agg(
        F.count_if(~F.col("_w.first")).alias("tf"), F.count_if(F.col("_w.first")).alias("users"))
    if not several:
        return found
    rest = word_counts(texts.join(repeated, again, "left_semi"), [key, group], text).groupBy(group, "term").agg(
        F.sum("n").alias("tf"), F.count(F.lit(1)).alias("users"))
    return found.unionByName(rest).groupBy(group, "term").agg(F.sum("tf").alias("tf"), F.sum("users").alias("users"))


def central_sentences(texts: DataFrame, group: str, key: str, text: str, min_chars: int = 0) -> DataFrame:
    """One extractive summary sentence per group: the sentence whose distinct words are, on
    average, used by most texts of the group. Sentences under `min_chars` characters do not stand.

    Words that make up more than one use in SENTENCE_WORDS meet their counts by broadcast; the sentence itself travels only
    for the best of each group."""
    sentences = texts.select(group, key, F.posexplode(F.split(text, r"[.!?]\s+|\n+")).alias("pos", "sentence")).filter(F.length("sentence") >= min_chars)
    shares = texts.select(group, F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("group_rows"))
    shares = staged(shares, "term-shares")
    words = sentences.select(group, key, "pos", F.explode(F.array_distinct(tokens("sentence"))).alias("term"))
    scored = attach_group_facts(words, shares, [group, "term"], share=SENTENCE_WORDS, total=shares.agg(F.sum("group_rows")).scalar()).groupBy(group, key, "pos").agg(rounded(F.avg("group_rows"), 4).alias("score"))
    best = scored.groupBy(group).agg(F.max_by(F.struct(key, "pos", "score"), F.struct("score", -F.col(key), -F.col("pos"))).alias("b")) \
        .select(group, f"b.{key}", "b.pos", "b.score")
    return staged(best, "best-sentences").join(sentences, [group, key, "pos"])
