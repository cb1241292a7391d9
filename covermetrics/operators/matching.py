"""Matching products and comparing policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.numbers import hash_bucket, percent, ratio, rounded
from covermetrics.functions.strings import edit_similarity, token_jaccard, tokens
from covermetrics.operators.relational import attach_group_facts
from covermetrics.session import staged

# Ours: weights of the hybrid score.
HYBRID = {"exact": 0.2, "fuzzy": 0.4, "words": 0.4}
FOUR = {"exact": 0.1, "fuzzy": 0.3, "words": 0.3, "semantic": 0.3}
# Names of a word that a join key holds on either side.
WORD_SLICE = 2000


def catalogue(products: DataFrame, name: str, price: str) -> DataFrame:
    """Distinct product names with mean price: matching works on names, not on rows."""
    return products.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("products"), ratio(F.sum(price), F.count(price), 2).alias("price"))


def _rare_words(names: DataFrame, frequencies: DataFrame, at_least: float) -> DataFrame:
    """The words a name must share one of to reach the wanted word overlap: all but the
    most frequent ``ceil(at_least * words) - 1`` of its words."""
    words = names.select("name", F.explode(F.array_distinct(tokens("name"))).alias("w"))
    ranked = attach_group_facts(words, frequencies, ["w"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("group_rows", "w"))).alias("ws"))
    keep = F.size("ws") - F.ceil(F.size("ws") * F.lit(at_least)) + 1
    return ranked.select("name", F.explode(F.slice(F.col("ws.w"), F.lit(1), keep.cast("int"))).alias("w"))


def word_pairs(a: DataFrame, b: DataFrame, slice_size: int = WORD_SLICE) -> DataFrame:
    """(name, match) of the names that share one of their rarer words, each pair once.

    The names of a word are cut into slices on both sides and every pair of slices is a join key of its own, so a word that
    many names carry does not meet in one task.
    """
    sizes = staged(a.groupBy("w").agg(F.count(F.lit(1)).alias("a_rows")).join(b.groupBy("w").agg(F.count(F.lit(1)).alias("b_rows")), "w").select(
        "w", "a_rows", "b_rows", F.ceil(F.col("a_rows") / slice_size).cast("int").alias("a_n"), F.ceil(F.col("b_rows") / slice_size).cast("int").alias("b_n")), "word-slices")

    def dealt(side: DataFrame, rows: str, own: str, other: str, column: str) -> DataFrame:
        tied = attach_group_facts(side, sizes.select("w", rows, "a_n", "b_n"), ["w"], rows)
        place = F.pmod(F.xxhash64(column), F.col(f"{own}_n")).cast("int")
        return tied.select("w", column, place.alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1)).alias(other))
    left = dealt(a, "a_rows", "a", "b", "name")
    right = dealt(b, "b_rows", "b", "a", "match")
    return left.join(right, ["w", "a", "b"]).select("name", "match").distinct()


def word_frequencies(names: DataFrame) -> DataFrame:
    """(w, group_rows): in how many names each word stands."""
    counts = names.select(F.explode(F.array_distinct(tokens("name"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("group_rows"))
    return staged(counts, "word-frequencies")


def candidate_pairs(ours: DataFrame, theirs: DataFrame, frequencies: DataFrame, at_least: float) -> DataFrame:
    a = staged(_rare_words(ours, frequencies, at_least), "rare-words")
    b = staged(_rare_words(theirs, frequencies, at_least).withColumnRenamed("name", "match"), "rare-words")
    return word_pairs(a, b)


def word_vectors(names: DataFrame, dims: int = 64) -> DataFrame:
    """(w, dim, x): vectors of words from the words that they stand with in the names of a catalogue.

    Each neighbour word falls on one of ``dims`` dimensions with a sign, both from its digest, and adds the logarithm of one
    more than the number of names that hold both: words used alike get alike vectors, also when no name holds both.
    """
    words = names.select("name", F.array_distinct(tokens("name")).alias("ws"))
    each = words.select(F.explode("ws").alias("w"), "ws").select("w", F.explode("ws").alias("c")).filter("w <> c")
    together = each.groupBy("w", "c").agg(F.count(F.lit(1)).alias("n"))
    sign = F.when(hash_bucket("c", 2, "sign") == 0, 1.0).otherwise(-1.0)
    return together.groupBy("w", hash_bucket("c", dims, "dim").alias("dim")).agg(
        rounded(F.sum(rounded(F.log(F.col("n") + F.lit(1.0)), 6) * sign), 6).alias("x")).filter("x <> 0")


def name_vectors(names: DataFrame, vectors: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(name, dim, x): the sum of a name's word vectors, rare words weighing more, of length one."""
    words = names.select("name", F.explode(F.array_distinct(tokens("name"))).alias("w"))
    total = names.agg(F.count(F.lit(1)).cast("double")).scalar()
    weight = rounded(F.log(F.lit(1.0) + total / F.col("group_rows")), 6)
    per_word = vectors.groupBy("w").agg(F.collect_list(F.struct("dim", "x")).alias("v"))  # as many entries as dimensions
    facts = frequencies.join(per_word, "w")
    tied = attach_group_facts(words, facts, ["w"]).select("name", weight.alias("weight"), F.explode("v").alias("e"))
    summed = tied.groupBy("name", F.col("e.dim").alias("dim")).agg(F.sum(F.col("weight") * F.col("e.x")).alias("x"))
    length = summed.groupBy("name").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length")).filter("length > 0")
    return summed.join(length, "name").select("name", "dim", (F.col("x") / F.col("length")).alias("x"))


def match_products_semantic(ours: DataFrame, theirs: DataFrame, at_least: float = 0.3, dims: int = 64) -> DataFrame:
    """Best counterpart per name by the four strategies: exact, fuzzy, words, and the cosine of vectors learnt from both
    catalogues. Candidates and the other columns are those of ``match_products``; a name of unknown words has semantic 0."""
    ours, theirs = staged(ours, "our-names"), staged(theirs, "their-names")
    both = staged(ours.select("name").unionByName(theirs.select("name")).distinct(), "names")
    frequencies = word_frequencies(both)
    pairs = candidate_pairs(ours, theirs, frequencies, at_least)
    near = pairs.withColumn("words", token_jaccard("name", "match")).filter(F.col("words") >= at_least)
    learnt = name_vectors(both, staged(word_vectors(both, dims), "word-vectors"), frequencies)
    lists = learnt.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("v"))  # as many entries as dimensions
    with_both = near.join(lists, "name", "left").join(lists.select(F.col("name").alias("match"), F.col("v").alias("u")), "match", "left")
    products = F.transform(F.map_entries("v"), lambda e: e["value"] * F.coalesce(F.try_element_at("u", e["key"]), F.lit(0.0)))
    cosine = F.coalesce(rounded(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), 4), F.lit(0.0))
    exact = F.when(F.lower("name") == F.lower("match"), 1.0).otherwise(0.0)
    scored = with_both.withColumn("semantic", cosine).withColumn("fuzzy", edit_similarity(F.lower("name"), F.lower("match"))) \
        .withColumn("score", rounded(exact * FOUR["exact"] + F.col("fuzzy") * FOUR["fuzzy"] + F.col("words") * FOUR["words"] + F.col("semantic") * FOUR["semantic"], 4))
    best = scored.groupBy("name").agg(F.min_by(F.struct("match", "score", "fuzzy", "words", "semantic"), F.struct(-F.col("score"), F.col("match"))).alias("m"))
    priced = ours.select("name", "price").join(best.select("name", "m.*"), "name", "left") \
        .join(theirs.select(F.col("name").alias("match"), F.col("price").alias("match_price")), "match", "left")
    return priced.select("name", "match", "score", "fuzzy", "words", "semantic",
                         percent(F.col("price") - F.col("match_price"), F.col("match_price"), 1).alias("price_delta_pct"))


def compare_items(a: DataFrame, b: DataFrame, keys: Sequence[str], item: str, amount: str) -> DataFrame:
    """Endorsements of two policies: in both, only in the first, or only in the second, with both limits."""
    left = a.groupBy(*keys, item).agg(F.max(amount).alias("limit_a")).withColumn("_a", F.lit(True))
    right = b.groupBy(*keys, item).agg(F.max(amount).alias("limit_b")).withColumn("_b", F.lit(True))
    both = left.join(right, [*keys, item], "full")
    held = F.when(F.col("_a").isNull(), "only b").when(F.col("_b").isNull(), "only a").otherwise("both")
    return both.select(*keys, item, held.alias("held_by"), "limit_a", "limit_b")


def compare_attributes(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Attributes that differ between two policies or properties, one row each, values as text; NULL equals NULL."""
    text = lambda df, name: df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(keys), list(columns), "attribute", name)
    both = text(a, "value_a").join(text(b, "value_b"), [*keys, "attribute"], "full")
    return both.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def match_products(ours: DataFrame, theirs: DataFrame, at_least: float = 0.3) -> DataFrame:
    """Best counterpart per name by hybrid score, with the price delta in percent.

    Candidates overlap in at least ``at_least`` of their words (Jaccard). Two such names
    always share one of their rarer words, so only those are joined and a word that a third
    of all names carry makes no pairs. The best candidate is an aggregate, so pairs are
    reduced where they are made. A name without a candidate keeps its row, with NULL match and score.
    """
    ours, theirs = staged(ours, "our-names"), staged(theirs, "their-names")
    both = ours.select("name").unionByName(theirs.select("name"))
    pairs = candidate_pairs(ours, theirs, word_frequencies(both), at_least)
    exact = F.when(F.lower("name") == F.lower("match"), 1.0).otherwise(0.0)
    scored = pairs.withColumn("words", token_jaccard("name", "match")).filter(F.col("words") >= at_least) \
        .withColumn("fuzzy", edit_similarity(F.lower("name"), F.lower("match"))) \
        .withColumn("score", rounded(exact * HYBRID["exact"] + F.col("fuzzy") * HYBRID["fuzzy"] + F.col("words") * HYBRID["words"], 4))
    best = scored.groupBy("name").agg(F.min_by(F.struct("match", "score", "fuzzy", "words"), F.struct(-F.col("score"), F.col("match"))).alias("m"))
    priced = ours.select("name", "price").join(best.select("name", "m.*"), "name", "left") \
        .join(theirs.select(F.col("name").alias("match"), F.col("price").alias("match_price")), "match", "left")
    return priced.select("name", "match", "score", "fuzzy", "words",
                         percent(F.col("price") - F.col("match_price"), F.col("match_price"), 1).alias("price_delta_pct"))


def compare_lines(a: DataFrame, b: DataFrame, keys: Sequence[str], line: str, amount: str) -> DataFrame:
    """Coverage lines of two policies side by side: who has the line, and the difference."""
    left = a.select(*keys, line, F.col(amount).alias("amount_a"), F.lit(True).alias("in_a"))
    right = b.select(*keys, line, F.col(amount).alias("amount_b"), F.lit(True).alias("in_b"))
    both = left.join(right, [*keys, line], "full")
    zero = F.lit(0).cast("decimal(18,2)")
    return both.select(
        *keys, line, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"),
        (F.coalesce("amount_b", zero) - F.coalesce("amount_a", zero)).cast("double").alias("difference"))
