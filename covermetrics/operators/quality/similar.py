"""Similarity self-join: rows of a block whose texts are within an edit distance, and the classes that the links form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.strings import edit_similarity
from covermetrics.operators.relational import attach_group_facts
from covermetrics.session import staged

# Distinct texts that a slice of a block's gram holds; a pair of slices is what one join key compares.
SLICE = 512
# Texts that may meet under one key before the key takes in a further gram, and the grams that a key may have.
CROWD = 64
LEVELS = 6
CLOSE = 2  # edits up to which texts meet by what is left without the characters that they may differ in
END = "\x03"  # closes the key of a text that has no further grams to be met under
C = F.col


def grams(text: Column, q: int) -> Column:
    """The distinct q-grams of a text, padded so that its ends count too."""
    padded = F.concat(F.lit("\x01" * (q - 1)), text, F.lit("\x02" * (q - 1)))
    starts = F.sequence(F.lit(1), F.length(padded) - q + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(q))))


def edits_allowed(text: Column, at_least: float) -> Column:
    """Most edits between the text and any text that is similar enough: the other is longer by 1 / at_least at most."""
    longest = F.floor(F.length(text) / F.lit(at_least))
    return F.floor(longest * F.lit(1 - at_least) + F.lit(1e-9)).cast("int")


def prefixes(values: DataFrame, block: Sequence[str], at_least: float, q: int, crowd: int = CROWD) -> DataFrame:
    """block, v, and the keys under which a text meets all texts similar to it, with the number of texts of the key.

    d edits touch q d grams at most, so two similar texts share one of their q d + 1 rarest grams, in any order that is the
    same for both; rare grams make small groups. Where more than ``crowd`` texts share a gram, they meet by it and the next gram
    that they share, which is one of their q d + 2 rarest, and so on: groups stay small however many texts there are. Two texts
    that both have too few grams need not share a further one; such texts also meet under the key as it is, closed by END.
    """
    least = at_least - 0.00005  # similarities are rounded to four digits
    each = values.withColumn("_g", grams(C("v"), q)).withColumn("_free", edits_allowed(C("v"), least) * q)
    listed = each.select(*block, "v", "_free", F.size("_g").alias("_have"), F.explode("_g").alias("gram"))
    counts = listed.groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("texts"))
    known = attach_group_facts(listed, counts, [*block, "gram"], "texts")
    ordered = known.groupBy(*block, "v", "_free", "_have").agg(F.array_sort(F.collect_list(F.struct("texts", "gram"))).alias("_o"))
    rare = F.transform(F.slice("_o", F.lit(1), C("_free") + LEVELS), lambda x: x["gram"])
    texts = [*block, "v", "_free", "_have"]
    rows, met = staged(ordered.select(*texts, rare.alias("_p"), F.lit("").alias("gram"), F.lit(0).alias("_at")), "rare-grams"), None
    for level in range(1, LEVELS + 1):
        last = F.least(F.size("_p"), C("_free") + level)
        ahead = F.when(C("_at") < last, F.sequence(C("_at") + 1, last)).otherwise(F.array().cast("array<int>"))
        ends = F.when(C("_have") < C("_free") + level, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        longer = rows.select(*texts, "_p", C("gram").alias("_key"), F.explode(F.concat(ahead, ends)).alias("_at")).select(
            *texts, "_p", F.concat("_key", F.when(C("_at") == 0, END).otherwise(F.try_element_at("_p", C("_at")))).alias("gram"), "_at")
        keyed = staged(longer, "gram-keys")
        sizes = keyed.groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
        sized = staged(attach_group_facts(keyed, sizes, [*block, "gram"], "texts"), "sized-keys")
        open_ = (C("texts") > crowd) & (C("_at") > 0) if level < LEVELS else F.lit(False)
        here = sized.filter(~open_).select(*block, "v", "gram", "texts")
        met, rows = here if met is None else met.unionByName(here), sized.filter(open_).drop("texts")
        if level == LEVELS or rows.isEmpty():
            return met


def branchings(texts: DataFrame, backwards: bool) -> DataFrame:
    """_id, at: the places (from 0) of a text before which it agrees with another text of its block, from its start or, if
    ``backwards``, from its end, and at which it does not agree with it."""
    text = F.reverse("v") if backwards else C("v")
    end = F.length("v")  # a place of its own: a text may end where another goes on
    listed = texts.select("_id", "_b", text.alias("v")).select("_id", "_b", "v", F.explode(F.sequence(F.lit(0), end)).alias("at"))
    listed = listed.select("_id", "at", F.xxhash64("_b", F.left("v", C("at"))).alias("_start"), F.substring("v", C("at") + 1, F.lit(1)).alias("_next"))
    facts = listed.groupBy("_start").agg(F.min("_next").alias("_low"), F.max("_next").alias("_high"), F.count(F.lit(1)).alias("_n"))
    facts = staged(facts.filter("_low <> _high").select("_start", "_n"), "branchings")
    return attach_group_facts(listed, facts, ["_start"], "_n").select("_id", "at")


def close_pairs(values: DataFrame, block: Sequence[str]) -> DataFrame:
    """_x, _y: a superset of the pairs of texts of a block that are two edits apart or less, as rows of block and v.

    What two texts share before their first edit ends at a place where the one branches off from the other, and what they share
    behind their last edit begins at such a place seen from the end. So both lose at most one character at each of these
    two places and are equal then; only if one of them lacks two neighbouring characters, these are the first place and the next.
    Texts meet under what is left of them, hashed; a text branches off at few places however many texts there are.
    """
    texts = staged(values.select(F.monotonically_increasing_id().alias("_id"), F.struct(*block).alias("_b") if block else F.lit(0).alias("_b"), "v"), "numbered-texts")
    places = [branchings(texts, backwards).withColumn("back", F.lit(backwards)) for backwards in (False, True)]
    found = places[0].unionByName(places[1]).groupBy("_id").agg(*[
        F.collect_list(F.when(C("back") == b, C("at"))).alias(name) for b, name in ((False, "_fore"), (True, "_aft"))])
    n = F.length("v")
    fore = F.filter("_fore", lambda p: p < n)
    aft = F.transform(F.filter("_aft", lambda p: p < n), lambda p: n - 1 - p)
    spots = texts.join(found, "_id").select("_id", "_b", "v", fore.alias("_f"), aft.alias("_a"))
    without = lambda p: F.concat(F.left("v", p), F.substring("v", p + 2, n))
    without_two = lambda p, r: F.concat(F.left("v", p), F.substring("v", p + 2, r - p - 1), F.substring("v", r + 2, n))
    last = lambda p: F.filter(F.array_union("_a", F.array(p + 1)), lambda r: (r > p) & (r < n))
    two = F.flatten(F.transform("_f", lambda p: F.transform(last(p), lambda r: without_two(p, r))))
    left = F.concat(F.array("v"), F.transform(F.array_union("_f", "_a"), without), two)
    hashes = F.array_distinct(F.transform(left, lambda t: F.xxhash64("_b", t)))
    keyed = staged(spots.select("_id", F.explode(hashes).alias("_key")), "left-overs")
    met = keyed.withColumnRenamed("_id", "_i").join(keyed.withColumnRenamed("_id", "_j"), "_key").filter("_i < _j").select("_i", "_j").distinct()
    side = lambda i, name: texts.select(C("_id").alias(i), F.struct("_b", "v").alias(name))
    pairs = met.join(side("_i", "_x"), "_i").join(side("_j", "_y"), "_j")
    return pairs.filter(C("_x._b").eqNullSafe(C("_y._b"))).select("_x", "_y")


def similar_pairs(values: DataFrame, block: Sequence[str], at_least: float, q: int, slice_size: int = SLICE) -> DataFrame:
    """block, a, b (a < b): the different texts v of a block that are similar enough, each pair once.

    Pairs of which one text allows ``CLOSE`` edits at most are found by `close_pairs`: the other is longer by as many at most. All
    other pairs are of texts that allow more, and meet by grams.
    """
    least = at_least - 0.00005  # similarities are rounded to four digits
    allowed, of_shorter = (edits_allowed(text, least) for text in (C("v"), F.left("v", F.greatest(F.length("v") - CLOSE, F.lit(0)))))
    wide = values.filter(allowed > CLOSE)
    found = close_pairs(values.filter((allowed > 0) & (of_shorter <= CLOSE)), block)
    a, b = C("_x.v"), C("_y.v")
    near = F.call_function("levenshtein", a, b, _edits(a, b, at_least)) >= 0
    found = found.filter(near).filter(edit_similarity(a, b) >= at_least).select(
        *[C(f"_x._b.{k}").alias(k) for k in block], F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return found if wide.isEmpty() else found.unionByName(gram_pairs(wide, block, at_least, q, slice_size)).distinct()


def _edits(a: Column, b: Column, at_least: float) -> Column:
    return F.floor(F.greatest(F.length(a), F.length(b)) * F.lit(1 - at_least + 0.00005) + F.lit(1e-9)).cast("int")


def gram_pairs(values: DataFrame, block: Sequence[str], at_least: float, q: int, slice_size: int = SLICE) -> DataFrame:
    """As `similar_pairs`, by grams alone.

    Groups that share a gram are cut into slices and every pair of slices is a join key of its own, so no task has to hold
    or compare a whole group; only verified pairs leave the join.
    """
    rows = prefixes(values, block, at_least, q).withColumn("_n", F.ceil(C("texts") / slice_size).cast("int"))
    own = F.pmod(F.xxhash64("v"), C("_n")).cast("int")
    every = F.sequence(F.lit(0), C("_n") - 1)
    left = rows.select(*block, "gram", own.alias("_i"), F.explode(every).alias("_j"), C("v").alias("a"))
    right = rows.select(*block, "gram", F.explode(every).alias("_i"), own.alias("_j"), C("v").alias("b"))
    left, right = (side.withColumnsRenamed({k: f"_{s}{i}" for i, k in enumerate(block)}) for side, s in ((left, "a"), (right, "b")))
    same = [C(f"_a{i}").eqNullSafe(C(f"_b{i}")) for i in range(len(block))]
    right = right.withColumnsRenamed({"gram": "_gram", "_i": "_k", "_j": "_l"})
    on = (C("gram") == C("_gram")) & (C("_i") == C("_k")) & (C("_j") == C("_l"))
    for s in same:
        on = on & s
    near = (F.length("a") >= F.length("b") * F.lit(at_least - 0.001)) & (F.length("b") >= F.length("a") * F.lit(at_least - 0.001))
    close = F.call_function("levenshtein", C("a"), C("b"), _edits(C("a"), C("b"), at_least)) >= 0  # stops counting at more edits than allowed
    found = left.join(right, on).filter((C("a") < C("b")) & near).filter(close).filter(edit_similarity(C("a"), C("b")) >= at_least)
    return found.select(*[C(f"_a{i}").alias(k) for i, k in enumerate(block)], "a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of the undirected links (a, b).

    Each round a node takes the least component among its neighbours and itself, then the component of that component, so
    long chains shorten by halves. Every round's labels are written; nothing is collected.
    """
    both = staged(links.select("a", "b").unionByName(links.select(C("b").alias("a"), C("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), C("a")).alias("component")).withColumnRenamed("a", "node"), "components")
    while True:
        reach = both.join(labels, C("b") == C("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(reach, C("node") == C("a")).select("node", F.least("component", "near").alias("lower"), C("component").alias("old"))
        onward = labels.select(C("node").alias("lower"), C("component").alias("further"))
        new = staged(lower.join(onward, "lower", "left").select("node", "old", F.least("lower", "further").alias("component")), "components")
        if new.filter("old != component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def similarity_classes(df: DataFrame, same: Sequence[str], key: str, compare: str, at_least: float = 0.8,
                       slice_size: int = SLICE) -> DataFrame:
    """key, class_id (least key of the class), members, links: the rows whose class has two members or more.

    Rows meet inside the blocks of equal ``same`` columns (NULL is a block like any other) and are linked when their lower-cased
    texts are equal or at least ``at_least`` similar; links close to classes. ``links`` counts the different texts a row's text
    is similar to. NULL texts are never linked; empty texts are equal. Equal texts are one node, so copies make no pairs.
    """
    if not 0.6 <= at_least < 1:
        raise ValueError("at_least must lie between 0.6 and 1")
    q = 2 if at_least >= 0.75 else 1
    block = [f"_s{i}" for i in range(len(same))]
    rows = df.select(C(key).alias("_key"), *[C(c).alias(b) for b, c in zip(block, same)], F.lower(C(compare)).alias("v")).filter("v IS NOT NULL")
    values = staged(rows.groupBy(*block, "v").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_copies")), "entity-values")
    pairs = staged(similar_pairs(values.select(*block, "v"), block, at_least, q, slice_size), "similar-pairs")
    # A node is a text of a block; 16 bytes of a digest stand for it.
    node = lambda v: F.substring(F.unhex(F.sha2(F.to_json(F.struct(*block, C(v).alias("v"))), 256)), 1, 16)
    links = pairs.select(node("a").alias("a"), node("b").alias("b"))
    named = values.withColumn("node", node("v")).join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    classes = named.groupBy("component").agg(F.min("_least").alias("class_id"), F.sum("_copies").alias("members"))
    facts = named.join(classes.filter("members > 1"), "component").join(degree, "node", "left").select(
        *block, "v", "class_id", "members", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), C("_copies"))
    tied = attach_group_facts(rows, facts, [*block, "v"], "_copies")
    return tied.select(C("_key").alias(key), "class_id", "members", "links")
