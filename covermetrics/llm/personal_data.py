"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are base matches: emails, IPv4 addresses, card numbers that pass Luhn, phone numbers. Seeds and other tokens that
hold a digit or an @ are instances; the words around an instance are its patterns (the two words before it; the word before
and the word after). Each round scores every pattern on the graph of patterns and instances: how many distinct known
instances support it, their share, and that share against the seeds' share of the corpus: it must be `lift` times as high,
or the unknown share `lift` times as low, which can be reached however many instances are seeds. Patterns over all three
limits turn their unknown instances into found ones, which support patterns of the next round. The limits stay and support
only grows, so a pattern of one round is one of all later rounds; rounds go on until one adds no pattern.

Offsets count code points, ends are exclusive. A null or empty text has no spans. Rows equal in id and text share their spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.llm.rows import written

C = F.col
# Fixed patterns. Possessive forms match the same strings as the plain ones and keep long runs linear: a run that fails
# from its first character fails from all others, so a match starts at a run's start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
KINDS = ("email", "ip", "card", "phone")
PART = "^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
SPANS = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"
LEAST_SUPPORT = 5
LEAST_SHARE = 0.8
LEAST_LIFT = 1.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    backwards = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: p.rlike(PART)),
        "card": F.when(n.between(16, 19), passes_luhn(digits(value))).otherwise(False),
        "phone": n.between(8, 15),
        "token": F.lit(True),
    }[kind]


def with_spans(df: DataFrame, kind: str, pattern: str, hint: Column) -> DataFrame:
    """The rows with a column of the kind's spans. `hint` is a cheap condition that every match needs."""
    found, pieces = f"__{kind}_found", f"__{kind}_pieces"
    df = df.withColumn(found, F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split("text", pattern, -1)))
    n = F.size(found)
    parts = F.zip_with(F.zip_with(F.slice(pieces, F.lit(1), n), C(found), lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
                       F.slice(pieces, F.lit(2), n), lambda x, q: F.struct(x["p"].alias("p"), x["m"].alias("m"), q.alias("q")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("value"), F.right(x["p"], F.lit(80)).alias("before"), F.left(x["q"], F.lit(80)).alias("after"))
        return F.struct(stop.alias("at"), F.when(valid(kind, x["m"]), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return df.withColumn(kind, F.when(n > 0, F.aggregate(parts, start, add)["out"]).otherwise(F.array().cast(SPANS))).drop(found, pieces)


def patterns(span: Column) -> Column:
    """The contexts of a span: two words before; one before and one after. Digits read as 0."""
    def words(text: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"\s+"), lambda w: w != "")
    before, after = words(span["before"]), words(span["after"])
    n = F.size(before)
    two = F.when(n >= 2, F.concat(F.lit("<"), F.get(before, n - 2), F.lit(" "), F.get(before, n - 1)))
    around = F.when((n >= 1) & (F.size(after) >= 1), F.concat(F.get(before, n - 1), F.lit(" _ "), F.get(after, F.lit(0))))
    return F.filter(F.array(two, around), lambda p: p.isNotNull())


def found_spans(instances: DataFrame, support: int, share: float, lift: float) -> DataFrame:
    """(id, key, start, stop) of the unknown instances in patterns over the limits."""
    edges = written(instances.select("id", "key", "start", "stop", "value", "known", F.explode(C("patterns")).alias("pattern")), "pattern-graph")
    pairs = written(edges.groupBy("pattern", "value").agg(F.max("known").alias("known"), F.count("*").alias("n")), "pattern-pairs")
    total = pairs.agg(F.avg(C("known").cast("double"))).first()[0] or 0.0  # of the seeds, before anything is found
    least = max(share, min(lift * total, 1 - (1 - total) / lift))
    n_accepted = -1
    while True:
        scored = pairs.groupBy("pattern").agg(F.count_if("known").alias("support"), F.count("*").alias("size"))
        accepted = scored.where((C("support") >= support) & (C("support") >= least * C("size"))).select("pattern")
        accepted = written(accepted, "patterns")
        before, n_accepted = n_accepted, accepted.count()
        if n_accepted in (0, before):
            break
        fresh = pairs.where("NOT known").join(accepted, "pattern", "left_semi").select("value").distinct().withColumn("fresh", F.lit(True))
        pairs = written(pairs.join(fresh, "value", "left").select("pattern", "value", (C("known") | F.coalesce("fresh", F.lit(False))).alias("known"), "n"), "pattern-pairs")
    return edges.where("NOT known").join(accepted, "pattern", "left_semi").select("id", "key", "start", "stop")


def personal_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", support: int = LEAST_SUPPORT,
                   share: float = LEAST_SHARE, lift: float = LEAST_LIFT) -> DataFrame:
    """doc_id and an array of (start, stop) for each base kind and for `found`, each in text order."""
    rows = docs.select(C(doc_id).alias("doc_id"), F.coalesce(C(doc_id).cast("string"), F.lit("")).alias("id"), F.xxhash64(doc_id, text).alias("key"), C(text).alias("text"))
    has = C("text").contains
    rows = with_spans(rows, "email", EMAIL, has("@"))
    rows = with_spans(rows, "ip", IP, has("."))
    rows = with_spans(rows, "card", CARD, C("text").rlike("[0-9]"))
    rows = with_spans(rows, "phone", PHONE, has("+"))
    rows = with_spans(rows, "token", TOKEN, C("text").rlike("[0-9@]"))
    base = written(rows.drop("text"), "spans")
    seeds = F.flatten(F.array(*KINDS))
    other = F.filter("token", lambda t: ~F.exists(C("seeds"), lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))

    def instance(known: bool):
        return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), F.lit(known).alias("known"), patterns(s).alias("patterns"))
    instances = base.withColumn("seeds", seeds).withColumn("other", other) \
        .select("id", "key", F.explode_outer(F.concat(F.transform("seeds", instance(True)), F.transform("other", instance(False)))).alias("s")) \
        .where("s IS NOT NULL").select("id", "key", "s.*")  # an outer explode: the plain form computes the array twice
    found = found_spans(instances, support, share, lift).groupBy("id", "key") \
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("found"))
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias(k) for k in KINDS]
    return base.join(found, ["id", "key"], "left").select(
        C("doc_id").alias(doc_id), *bare, F.coalesce("found", F.array().cast("array<struct<start:int,stop:int>>")).alias("found"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of the kinds, comma-joined in that order."""
    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))
    texts = [named(k) for k in kinds]
    return F.array_join(F.flatten(F.array(*texts)), ",")
