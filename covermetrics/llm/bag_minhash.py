"""Near-duplicate classes by BagMinHash over the multiset of five-word shingles.

Each shingle and each level of its multiplicity ([0,1), [1,2), [2,4), ...) is a Poisson process; a register keeps the
earliest point dealt to it, so two registers agree with the probability of the weighted Jaccard similarity. Signatures are
banded; texts of one bucket are compared by signature, and likely pairs are verified by exact multiset overlap.

No link is lost to hot buckets: they are split into blocks, and after a first round of links every text outside its bucket's
main component meets all blocks, so each pair of different components that shares a bucket is compared. Pairs inside one
component need no check. What remains is the chance of the signatures: a pair at similarity 0.8 misses all bands with
probability 3e-5, and its estimate falls under the verification line with 8e-4.

Equal texts are one class without comparison. A null text or one without words is a class of its own; a text of fewer words
than a shingle is one shingle. A class is named by its least id (null if it has none); repeated rows share a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.llm.buffers import SPACES, Rolling, block_arrays, byte_table, scramble, spans, text_bytes
from covermetrics.llm.rows import give_back, lean, written

C = F.col
SHINGLE = 5
REGISTERS = 256
BANDS, BAND_ROWS = 20, 4
SIMILARITY = 0.8
LIKELY = 0.72  # signature estimate from which a pair is verified
BLOCK = 512
BEST = 3
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle."""
    starts, ends = spans(~byte_table(SPACES)[data], offsets)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    words = rolling.words(data, starts, ends)
    rows = np.repeat(np.arange(len(n_words)), n_words)
    grams = rolling.grams(words, SHINGLE)
    at = np.flatnonzero(rows[:len(grams)] == rows[SHINGLE - 1:]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    whole = rolling.ranges(words, first[short], first[short + 1], int(GOLDEN)) if len(short) else np.zeros(0, np.uint64)
    return np.concatenate([rows[at], short]), np.concatenate([grams[at], whole])


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, hash) and how often each occurs."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[new], h[new], np.diff(np.append(new, len(r)))


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """m point hashes of each of the n texts; texts without shingles get zeros."""
    registers = np.zeros(n * m, np.uint64)
    weight = np.bincount(rows, counts, minlength=n)
    horizon = np.where(weight > 0, (np.log(m) + 4) / np.maximum(weight, 1), 0.0)  # a guess: texts with registers left look further
    row, seed, size, limit = [rows], [scramble(hashes)], [np.ones(len(rows))], [counts]
    level = 1
    while (at := np.flatnonzero(counts > 1 << (level - 1))).size:
        row.append(rows[at])
        seed.append(scramble(hashes[at] + np.full(1, GOLDEN) * np.uint64(level)))
        size.append(np.full(len(at), float(1 << (level - 1))))
        limit.append(counts[at] - (1 << (level - 1)))
        level += 1
    row, seed, size, limit = map(np.concatenate, (row, seed, size, limit))
    left, best = weight > 0, np.full(n * m, np.inf)
    while left.any():
        at = np.flatnonzero(left[row])
        r, s, w, c, time = row[at] * m, seed[at], size[at], limit[at], np.zeros(len(at))
        last, rate = horizon[row[at]], m * w
        while len(r):
            s = scramble(s + GOLDEN)
            time = time - np.log(((s >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
            on = time <= last
            if not on.all():
                r, s, w, c, time, last, rate = (x[on] for x in (r, s, w, c, time, last, rate))
            place = scramble(s ^ np.uint64(0xD6E8FEB86659FD93))
            slot = r + (place % np.uint64(m)).astype(np.int64)
            inside = (place >> np.uint64(16)) & (w.astype(np.uint64) - np.uint64(1)) < c.astype(np.uint64)  # sizes are powers of two
            inside &= time <= best[slot]
            slot, found, place = slot[inside], time[inside], place[inside]
            np.minimum.at(best, slot, found)
            first = best[slot] == found
            registers[slot[first]] = place[first]
        left &= ~np.isfinite(best.reshape(n, m)).all(1)
        horizon[left] *= 1.5
    return registers.reshape(n, m)


def bands(registers: np.ndarray) -> np.ndarray:
    used = registers[:, :BANDS * BAND_ROWS].reshape(len(registers), BANDS, BAND_ROWS)
    out = np.full(used.shape[:2], GOLDEN, np.uint64)
    for k in range(BAND_ROWS):
        out = scramble(out * np.uint64(31) + used[:, :, k])
    return out.astype(np.int64)


SIGNATURE = "struct<n:bigint,bands:array<bigint>,marks:binary>"


def signed(column: pa.Array, rolling: Rolling) -> pa.StructArray:
    """Number of shingles, band hashes and one byte of each register, of each text."""
    n_all, bands_all, marks_all = [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)], []
    # A short text has as many points as a long one, but one after another: texts of a length go together.
    order = np.argsort(pc.binary_length(column).fill_null(0).to_numpy(), kind="stable")
    for data, offsets in block_arrays(column.take(pa.array(order)), 1 << 19):
        n = len(offsets) - 1
        rows, hashes, counts = counted(*shingles(data, offsets, rolling))
        registers = signatures(rows, hashes, counts, n)
        n_all.append(np.bincount(rows, counts, minlength=n).astype(np.int64))
        bands_all.append(bands(registers))
        marks = (registers >> np.uint64(40)).astype(np.uint8).tobytes()
        marks_all += [marks[i * REGISTERS:(i + 1) * REGISTERS] for i in range(n)]
    flat = np.concatenate(bands_all).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
    found = pa.StructArray.from_arrays([pa.array(np.concatenate(n_all)), lists, pa.array(marks_all, pa.binary())], ["n", "bands", "marks"])
    return found.take(pa.array(np.argsort(order)))


def signature(text: Column) -> Column:
    """`signed` of the text."""
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling = Rolling()
        for column in batches:
            yield signed(column, rolling)
    return F.arrow_udf(lean(measure), SIGNATURE)(text)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole (bucket, block) groups, which come sorted, with a group number for each row."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.stack([held.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "block")])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if len(new):
            yield held.slice(0, new[-1]), np.searchsorted(new, np.arange(new[-1]), "right")
            held = held.slice(new[-1])
    if held is not None and held.num_rows:
        key = np.stack([held.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "block")])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        yield held, np.searchsorted(new, np.arange(held.num_rows), "right")


def _likely_pairs(buckets: DataFrame, best_only: bool) -> DataFrame:
    """Pairs (a, b, share) of different components in one block whose signatures agree enough; with `best_only` the best
    partner of each text.

    A row is at home in one block of its bucket; rows outside the main component also visit the others. A pair is compared
    where both are at home, or where the one at home is in the main component or has the lower digest. Without `best_only`
    it is reported only in the first band whose hashes agree (column `bands`), which is one of its buckets.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches):
            n = rows.num_rows
            marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(n, REGISTERS)
            text = rows.column("t")
            codes = rows.column("component").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            names = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.argsort(np.array(text.to_pylist(), dtype="S16"), kind="stable").argsort()
            home, main, band = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("home", "main", "band"))
            if not best_only:
                hashes = rows.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(n, BANDS)
            share, partner = np.zeros(n), np.full(n, -1)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for d in range(1, n):
                i = np.flatnonzero(group[d:] == group[:-d])
                if not len(i):
                    break
                j = i + d
                lone = np.where(home[i], main[i] | (order[i] < order[j]), main[j] | (order[j] < order[i]))
                i = i[(codes[i] != codes[j]) & (names[i] != names[j]) & (home[i] & home[j] | (home[i] ^ home[j]) & lone)]
                for part in np.array_split(i, max(1, len(i) >> 14)):
                    agree = ((marks[part] == marks[part + d]).mean(1) * 256 - 1) / 255
                    part, agree = part[agree >= LIKELY], agree[agree >= LIKELY]
                    if not best_only:
                        earliest = (hashes[part] == hashes[part + d]).argmax(1) == band[part]
                        found.append((part[earliest], part[earliest] + d, agree[earliest]))
                        continue
                    for x, y in ((part, part + d), (part + d, part)):
                        better = agree > share[x]
                        share[x[better]], partner[x[better]] = agree[better], y[better]
            if best_only:
                x = np.flatnonzero(partner >= 0)
                found = [(x, partner[x], share[x])]
            a, b, s = map(np.concatenate, zip(*found))
            yield pa.RecordBatch.from_arrays([text.take(pa.array(a)), text.take(pa.array(b)), pa.array(s, pa.float64())], ["a", "b", "share"])
        give_back()
    dealt = buckets.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(compare, "a binary, b binary, share double")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts have the similarity, with it."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = one.join(texts.select(C("t").alias("a"), C("text").alias("left")), "a").join(texts.select(C("t").alias("b"), C("text").alias("right")), "b")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = [counted(*shingles(*text_bytes(part.column(s)), rolling)) for s in ("left", "right")]
                total = [np.bincount(r, c, minlength=part.num_rows) for r, _, c in sides]
                (r, h, c), (r2, h2, c2) = sides
                rows, hashes, counts = np.concatenate([r, r2]), np.concatenate([h, h2]), np.concatenate([c, c2])
                order = np.lexsort((hashes, rows))
                rows, hashes, counts = rows[order], hashes[order], counts[order]
                same = np.flatnonzero((rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1]))
                shared = np.bincount(rows[same], np.minimum(counts[same], counts[same + 1]), minlength=part.num_rows)
                similarity = shared / np.maximum(total[0] + total[1] - shared, 1)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similarity)], ["a", "b", "similarity"])
        give_back()
    return both.mapInArrow(overlap, "a binary, b binary, similarity double").where(C("similarity") >= SIMILARITY)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(t, component) of every text that has a link: least-label spreading with label jumping, a written table each round."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(C("a").alias("t"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.t).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.t == near.a).select("t", F.least("component", "near").alias("lower"), "component")
        of_label = labels.select(C("t").alias("lower"), C("component").alias("jump"))
        new = written(lower.join(of_label, "lower", "left").select("t", F.least("lower", "jump").alias("component"), C("component").alias("old")), "labels")
        if new.where("component != old").isEmpty():
            return new.select("t", "component")
        labels = new.select("t", "component")


def text_classes(rows: DataFrame) -> DataFrame:
    """(t, least, component) of each distinct text with words. `rows` has id, text and the digest t."""
    spark = rows.sparkSession
    signed = rows.select("id", "t", signature(C("text")).alias("s")).where("s.n > 0")
    texts = written(signed.groupBy("t").agg(F.first("s").alias("s"), F.min("id").alias("least")), "signatures")
    banded = texts.select("t", F.posexplode("s.bands").alias("band", "hash")).select("t", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(shared, "bucket"), "buckets")
    near = members.select("t").distinct()
    marked = written(near.join(texts.select("t", "s.marks", "s.bands"), "t"), "marks")
    lookup = written(rows.select("t", "text").join(near, "t", "left_semi").dropDuplicates(["t"]), "texts")
    n_blocks = F.ceil(C("size") / BLOCK)
    block = F.pmod(F.xxhash64("t", "bucket"), n_blocks).cast("bigint")

    first = members.join(marked.drop("bands"), "t").select(
        "bucket", block.alias("block"), "t", "band", "marks", C("t").alias("component"), F.lit(True).alias("home"), F.lit(False).alias("main"))
    best = _likely_pairs(first, best_only=True).groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("share", "b")), False), 1, BEST).alias("p"))
    links = written(_verified(best.select("a", F.explode("p").alias("p")).select("a", C("p.b").alias("b")), lookup), "verified")

    named = members.join(components(spark, links), "t", "left").withColumn("component", F.coalesce("component", "t"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_rows = named.join(main, "bucket").withColumn("inside", C("component") == C("main.component"))
    every_block = F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)
    spread = open_rows.withColumn("block", F.explode(F.when(C("inside"), F.array(block)).otherwise(every_block))).join(marked, "t") \
        .select("bucket", "block", "t", "band", "marks", "bands", "component", (C("block") == block).alias("home"), C("inside").alias("main"))
    more = _verified(_likely_pairs(spread, best_only=False), lookup)
    links = written(links.union(more), "verified")
    found = components(spark, links)

    classes = texts.select("t", "least").join(found, "t", "left").withColumn("component", F.coalesce("component", "t"))
    return written(classes, "classes")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(C(doc_id).alias("id"), C(text).alias("text")).withColumn("t", F.unhex(F.md5("text")))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_copies (rows of the class)."""
    rows = _rows(docs, doc_id, text)
    classes = text_classes(rows)
    named = rows.select("id", "t").join(classes.select("t", "component"), "t", "left")
    sizes = classes.join(rows.select("t").groupBy("t").agg(F.count("*").alias("n")), "t") \
        .groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_copies"))
    alone = C("component").isNull()
    return named.join(sizes, "component", "left").select(
        C("id").alias(doc_id), F.when(alone, C("id")).otherwise(C("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: the one of least id (nulls last). Rows without words stay; rows equal in id and text are one."""
    rows = _rows(docs, doc_id, text)
    classes = text_classes(rows)
    first = classes.groupBy("component").agg(F.min(F.struct(C("least").isNull().alias("none"), "least", "t")).alias("first")) \
        .select("first.least", "first.t")
    stays = rows.select("id", "t").join(classes.select("t", F.lit(True).alias("worded")), "t", "left") \
        .join(first.withColumn("is_first", F.lit(True)), "t", "left") \
        .where(C("worded").isNull() | (C("is_first") & C("id").eqNullSafe(C("least"))))
    key = [F.coalesce(C("id").cast("string"), F.lit("")).alias("__id"), C("id").isNull().alias("__none"), F.coalesce("t", F.lit(b"")).alias("__t")]
    keyed = docs.withColumns({"__id": F.coalesce(C(doc_id).cast("string"), F.lit("")), "__none": C(doc_id).isNull(),
                              "__t": F.coalesce(F.unhex(F.md5(text)), F.lit(b""))})
    names = ["__id", "__none", "__t"]
    return keyed.join(stays.select(*key).distinct(), names, "left_semi").dropDuplicates(names).drop(*names)
