"""Substring dedup: matching statistics against suffix automata of reference shards.

The reference is the corpus itself. A window is `window` consecutive words; it goes if its words also start anywhere else.
Each window is dealt to a shard by its minimiser (the least hash of its short grams), so equal windows always meet. The
text of neighbouring windows with one minimiser is a segment; a shard builds the automaton of its segments, each counted
with its copies, streams the segments through it, and a window whose state has two occurrences or more is repeated.

Shards are routed rather than broadcast: broadcasting every shard to every task costs corpus times corpus. Minimisers that
occur once cannot hold a repeated window and send no text. Segments of a minimiser that occurs more than `HOT` times are
dealt window by window, so no shard holds an unbounded group.

Null and empty texts have no words. Rows equal in id and text are separate occurrences, so their windows repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermetrics.llm.automaton import SuffixAutomaton
from covermetrics.llm.buffers import SPACES, Rolling, block_arrays, byte_table, spans, text_bytes

C = F.col
WINDOW = 35
GRAM = 8
HOT = 2000
SHARD_WORDS = 50_000
HELD_SEGMENTS = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<least:bigint,start:int,n:int>>"
ORDER_BITS = 22  # a block holds fewer words than 2**22


def minimiser_runs(words: np.ndarray, first: np.ndarray, rolling: Rolling, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, minimiser, first window, windows) of each run of windows with one minimiser position."""
    grams = rolling.grams(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    low = np.uint64((1 << ORDER_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, window - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    least = least[:n]
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(rows[:n] == rows[window - 1:])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least, rows = least[at], rows[at]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])]))
    return rows[new], (least[new] >> np.uint64(ORDER_BITS)).astype(np.int64), at[new] - first[rows[new]], np.diff(np.append(new, len(at)))


def _runs(window: int, gram: int):
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling = Rolling()
        for column in batches:
            parts, sizes = [], [np.zeros(1, np.int64)]
            for data, offsets in block_arrays(column):
                starts, ends = spans(~byte_table(SPACES)[data], offsets)
                first = np.searchsorted(starts, offsets)
                found = [np.zeros(0, np.int64)] * 4
                # positions must fit the low bits of a gram's hash; only a single huge text has more words
                if len(starts) < 1 << ORDER_BITS:
                    found = minimiser_runs(rolling.words(data, starts, ends), first, rolling, window, gram)
                else:
                    words, step, pieces = rolling.words(data, starts, ends), 1 << (ORDER_BITS - 1), []
                    for a in range(0, len(words) - window + 1, step):
                        piece = words[a:a + step + window - 1]
                        r, m, s, k = minimiser_runs(piece, np.array([0, len(piece)]), rolling, window, gram)
                        pieces.append((r, m, s + a, k))
                    found = [np.concatenate(x) for x in zip(*pieces)]
                parts.append(found[1:])
                sizes.append(np.bincount(found[0], minlength=len(offsets) - 1))
            least, start, n = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
            inner = pa.StructArray.from_arrays([pa.array(least, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["least", "start", "n"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), inner)
    return F.arrow_udf(find, RUNS)


def _cut(batch: pa.RecordBatch, rolling: Rolling, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, shard, start, segment) of each run of the column `list`; windows of hot runs one by one."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends = spans(~byte_table(SPACES)[data], offsets)
    first = np.searchsorted(starts, offsets)
    hashes = rolling.grams(rolling.words(data, starts, ends), window).astype(np.int64)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    for i, runs in enumerate(batch.column("list").to_pylist()):
        for run in runs:
            a, n = int(first[i]) + run["start"], run["n"]
            if not run["hot"]:
                yield i, run["least"], run["start"], b" ".join(words[a:a + n + window - 1])
                continue
            for k in range(n):
                yield i, int(hashes[a + k]), run["start"] + k, b" ".join(words[a + k:a + k + window])


def _segment_counts(docs: DataFrame, window: int) -> DataFrame:
    """(shard, segment, copies): each task adds up the copies it sees, a bounded number of segments at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held = Rolling(), Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.binary()).cast(pa.string()),
                                               pa.array(held.values(), pa.int64())], ["shard", "segment", "copies"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.update((shard, segment) for _, shard, _, segment in _cut(batch.slice(at, 256), rolling, window))
                if len(held) > HELD_SEGMENTS:
                    yield flush()
                    held.clear()
        yield flush()
    return docs.mapInArrow(count, "shard bigint, segment string, copies bigint")


def _segment_places(docs: DataFrame, window: int) -> DataFrame:
    """(id, key, shard, start, digest of the segment) of each segment."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(i, shard, start, hashlib.md5(segment).digest()) for i, shard, start, segment in _cut(part, rolling, window)]
                index, shard, start, digest = zip(*found) if found else ((), (), (), ())
                rows = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("key").take(rows), pa.array(shard, pa.int64()), pa.array(start, pa.int32()),
                     pa.array(digest, pa.binary())], ["id", "key", "shard", "start", "digest"])
    return docs.mapInArrow(place, "id string, key bigint, shard bigint, start int, digest binary")


def repeated_windows(segments: list[tuple[list[str], int]], window: int) -> list[list[int]]:
    """For each (words, copies) the windows that occur twice or more among all segments and copies."""
    automaton = SuffixAutomaton()
    for words, copies in segments:
        automaton.add(words, copies)
    count = automaton.finish().count
    return [[end - window for end, state in automaton.windows(words, window) if count[state] > 1] for words, _ in segments]


def _judged(counts: DataFrame, window: int) -> DataFrame:
    """(shard, digest, windows) of the distinct segments that hold a repeated window."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, int]] = []
        group: Counter = Counter()
        size, now = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_windows([(t.split(" "), n) for _, t, n in held], window)
            keep = [(s, hashlib.md5(t.encode()).digest(), w) for (s, t, _), w in zip(held, found) if w]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in keep], pa.int64()), pa.array([t for _, t, _ in keep], pa.binary()),
                 pa.array([w for _, _, w in keep], pa.list_(pa.int32()))], ["shard", "digest", "windows"])

        for batch in batches:
            for shard, text, copies in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "copies"))):
                if shard != now:
                    held += [(now, t, n) for t, n in group.items()]
                    size += sum(t.count(" ") + 1 for t in group)
                    group.clear()
                    now = shard
                    if size >= SHARD_WORDS:
                        yield flush()
                        held, size = [], 0
                group[text] += copies
        held += [(now, t, n) for t, n in group.items()]
        if held:
            yield flush()
    dealt = counts.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(judge, "shard bigint, digest binary, windows array<int>")


def _kept(window: int):
    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, cuts in batches:
            n_words, n_removed, kept = [], [], []
            for text, cut in zip(texts, cuts):
                words = WORD.findall(text.as_py() or "")
                n_words.append(len(words))
                if cut.is_valid:
                    delta = np.zeros(len(words) + 1, np.int32)
                    at = cut.values.to_numpy()
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + window, -1)
                    stay = np.cumsum(delta[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(" ".join(words))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])
    return F.arrow_udf(keep, "struct<n_words:bigint,n_removed:bigint,kept:string>")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the remaining words joined by one space."""
    gram = min(gram, window)
    rows = docs.select(C(doc_id).alias("doc_id"), F.coalesce(C(doc_id).cast("string"), F.lit("")).alias("id"), F.xxhash64(doc_id, text).alias("key"), C(text).alias("text"))
    runs = rows.select("id", "key", F.explode(_runs(window, gram)(C("text"))).alias("run")).select("id", "key", "run.*")
    counts = runs.groupBy("least").agg(F.count("*").alias("n_runs")).where("n_runs > 1")
    lists = runs.join(counts, "least").groupBy("id", "key").agg(F.collect_set(F.struct("least", "start", "n", (C("n_runs") > hot).alias("hot"))).alias("list"))
    # The same columns of the rows as in the last join, so that both read one shuffle of the texts.
    listed = rows.join(lists, ["id", "key"])
    judged = _judged(_segment_counts(listed, window), window)
    found = _segment_places(listed, window).join(judged, ["shard", "digest"])
    cuts = found.select("id", "key", F.transform("windows", lambda w: w + C("start")).alias("at")) \
        .groupBy("id", "key").agg(F.flatten(F.collect_list("at")).alias("cuts"))
    done = rows.join(cuts, ["id", "key"], "left").withColumn("r", _kept(window)(C("text"), C("cuts")))
    return done.select(C("doc_id").alias(doc_id), "r.n_words", "r.n_removed", "r.kept")
