"""Benchmark decontamination: documents stream through a suffix automaton of the normalised test items.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are runs of
letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty texts have no words and no hits; repeated item
rows count once for each item id; a null item id reads as ''. An empty item table hits nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.llm.automaton import SuffixAutomaton
from covermetrics.llm.buffers import Rolling, block_arrays, row_of, spans, text_bytes
from covermetrics.llm.rows import lean, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "struct<n_words:bigint,words:array<struct<first:bigint,stop:bigint>>,bytes:array<struct<first:bigint,stop:bigint>>,items:array<string>>"


def word_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the lower-casing table."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return np.array([WORD.match(bytes([b])) is not None for b in lower]), lower


class ItemIndex:
    """Automaton of some items. `owners` maps a window's state to its items, `short` whole short items."""

    def __init__(self, items, window: int):
        self.window, self.ids, self.owners, self.short = window, {}, {}, {}
        self.automaton = SuffixAutomaton()
        lists = []
        for item, text in items:
            words = WORD.findall((text or "").encode().lower())
            seq = tuple(self.ids.setdefault(w, len(self.ids)) for w in words)
            if len(seq) >= window:
                self.automaton.add(seq)
                lists.append((item, seq))
            elif seq:
                self.short.setdefault(len(seq), {}).setdefault(seq, set()).add(item)
        for item, seq in lists:
            for _, state in self.automaton.windows(seq, window):
                self.owners.setdefault(state, set()).add(item)
        self.shortest = min([*self.short, window] if lists else self.short, default=0)

    def hits(self, words: list[bytes]):
        """(start, stop, items) of every window that occurs in the words."""
        seq = [self.ids.get(w, -1) for w in words]
        for end, state in self.automaton.windows(seq, self.window):
            yield end - self.window, end, self.owners[state]
        for n, whole in self.short.items():
            for i in range(len(seq) - n + 1):
                if items := whole.get(tuple(seq[i:i + n])):
                    yield i, i + n, items


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_texts(column: pa.Array, index: ItemIndex, rolling: Rolling, tables) -> pa.Array:
    """One struct per text. Runs of words that any item knows are found by hash; only those pass the automaton."""
    inside, lower = tables
    known = np.sort(rolling_vocabulary(index.ids, rolling))
    rows = []
    for data, offsets in block_arrays(column):
        data = lower[data]
        starts, ends = spans(inside[data], offsets)
        first = np.searchsorted(starts, offsets)
        n_words = np.diff(first)
        found: dict[int, tuple[list, set]] = {}
        if index.shortest and len(starts):
            hashes = rolling.words(data, starts, ends)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            a, b = spans(known[at] == hashes, first)
            long_enough = b - a >= index.shortest
            raw = data.tobytes() if long_enough.any() else b""
            for i, j in zip(a[long_enough].tolist(), b[long_enough].tolist()):
                words = [raw[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())]
                for p, q, items in index.hits(words):
                    row = int(row_of(starts[i:i + 1], offsets)[0])
                    got = found.setdefault(row, ([], set()))
                    got[0].append((i + p, i + q))
                    got[1].update(items)
        for row, n in enumerate(n_words.tolist()):
            ranges, items = found.get(row, ((), ()))
            ranges, base, origin = _merged(ranges), int(first[row]), int(offsets[row])
            rows.append({
                "n_words": n, "words": [{"first": p - base, "stop": q - base} for p, q in ranges],
                "bytes": [{"first": int(starts[p]) - origin, "stop": int(ends[q - 1]) - origin} for p, q in ranges],
                "items": sorted(items)})
    span = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("words", span), ("bytes", span), ("items", pa.list_(pa.string()))]))


def rolling_vocabulary(words, rolling: Rolling) -> np.ndarray:
    data, offsets = text_bytes(pa.array([w.decode() for w in words] or [""], pa.string()))
    return rolling.words(data, offsets[:-1], offsets[1:])


def _scanner(spark, items, window: int):
    index = spark.sparkContext.broadcast(cloudpickle.dumps(ItemIndex(items, window)))  # by value: executors need no package
    tables = word_bytes()

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling, automaton = Rolling(), pickle.loads(index.value)
        for column in batches:
            yield scan_texts(column, automaton, rolling, tables)
    # Else a filter on the hits moves below them, and a second worker of each task scans the texts again.
    return F.arrow_udf(lean(scan), HITS).asNondeterministic()


def find_items(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               window: int = 13, max_item_bytes: int = 32 << 20, out: str = "hits") -> DataFrame:
    """The documents with a struct column `out`: n_words, hit ranges in words and in bytes, and ids of the items hit.

    An automaton is broadcast, so its items are bounded: beyond `max_item_bytes` of text the items are dealt into parts of
    that size, and the documents pass one part's automaton after the other (a written table between the passes).
    """
    spark = docs.sparkSession
    chosen = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")) \
        .where(F.col("text").isNotNull())
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // max_item_bytes) or 1
    for part in range(parts):
        one = chosen if parts == 1 else chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        got = _scanner(spark, [tuple(r) for r in one.collect()], window)(F.col(text))
        if part == 0:
            docs = docs.withColumn(out, got)
        else:
            docs = written(docs, "items").withColumn("__more", got).withColumn(out, F.struct(
                F.col(f"{out}.n_words").alias("n_words"), F.concat(f"{out}.words", "__more.words").alias("words"),
                F.concat(f"{out}.bytes", "__more.bytes").alias("bytes"),
                F.array_distinct(F.concat(f"{out}.items", "__more.items")).alias("items"))).drop("__more")
    return docs


def n_covered(ranges: Column) -> Column:
    """How many positions the ranges cover; overlaps count once."""
    done = F.aggregate(
        F.array_sort(ranges), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("stop")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), r["stop"] - F.greatest(r["first"], acc["stop"]))).alias("n"),
                                F.greatest(acc["stop"], r["stop"]).alias("stop")))
    return done["n"]


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def without_ranges(text: Column, ranges: Column) -> Column:
    """The text without the byte ranges."""
    raw = text.cast("binary")
    done = F.aggregate(
        F.array_sort(ranges), F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, r: F.struct(
            F.concat(acc["kept"], F.substring(raw, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("bigint"), r["first"] - acc["at"]).cast("int"))).alias("kept"),
            F.greatest(acc["at"], r["stop"]).alias("at")))
    return F.concat(done["kept"], F.substring(raw, (done["at"] + 1).cast("int"), F.octet_length(text))).cast("string")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", share: int = 20, **kinds) -> DataFrame:
    """Documents whose share of hit words exceeds the limit go; from the rest the hit passages are cut out.

    Other columns stay as they are. A null text stays null.
    """
    hits = "__hits"
    found = find_items(docs, items, text=text, out=hits, **kinds)
    clean = found.where(~contaminated(n_covered(F.col(f"{hits}.words")), F.col(f"{hits}.n_words"), share))
    cut = F.when(F.size(f"{hits}.bytes") > 0, without_ranges(F.col(text), F.col(f"{hits}.bytes"))).otherwise(F.col(text))
    return clean.withColumn(text, cut).drop(hits)
