"""Token ids in files of grammar-compressed blocks.

Documents are sorted by id (nulls first, ties by text) and dealt to shards by range. A shard's ids are cut into blocks of
whole documents. In each block frequent pairs of ids are replaced by new symbols until no pair can be replaced four times;
a block's row holds the rules, how many ids each rule expands to, and the symbols of each document, so that a document or a range of its
ids is decoded without the rest. The rows are a Parquet table, so any store that Spark writes to will do.

A null or empty text is its end id alone; an empty table gives a table without blocks; repeated rows are stored each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covermetrics.llm.rows import Known, for_worker, give_back

BLOCK_IDS = 1 << 18
LEAST_COUNT = 4  # a rule takes three numbers, so fewer uses would not pay
SPACE = pa.scalar(" ", pa.large_string())
RUN = re.compile(r"[^\W\d_]+|(?:(?! )[\W\d_])+| ")
JOINED = re.compile("'|<[|]|İ")  # İ lower-cases to a letter and a mark
ROWS, BYTES = 2048, 8 << 20  # texts that are encoded at once
BLOCK = ("shard int, block int, n_tokens bigint, base int, lefts array<int>, rights array<int>, rule_lengths array<int>, "
         "symbols binary, docs array<{id}>, doc_symbols array<int>, doc_tokens array<int>")


class Letters(dict):
    """What the tokenizer's own normalizer and splitting make of a letter inside a word, asked once for each letter."""

    def __init__(self, tokenizer):
        super().__init__({ord(" "): " "})
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> str:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{self.tokenizer.normalizer.normalize_str(chr(code))}a")
        self[code] = found = pieces[0][0][1:-1] if len(pieces) == 1 else "a a"  # a word that is cut there comes out as too many
        return found


class PieceEncoder:
    """Ids of texts as 32-bit integers. White space ends a token, so words are encoded once and kept.

    A word in normal form without an apostrophe, a special token's mark or İ is encoded run by run (letters, other characters),
    as the tokenizer's own split does. Runs of letters go to the tokenizer's model many at a time, normalized letter by letter
    and joined by spaces; all else goes to the whole tokenizer.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.vocabulary = self.tokenizer.get_vocab_size()
        bare = json.loads(model) | {"normalizer": None, "added_tokens": [],
                                    "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}}
        self.bare, self.letters = Tokenizer.from_str(json.dumps(bare)), Letters(self.tokenizer)
        suffix = bare["model"].get("end_of_word_suffix")  # on the last token of each word, and on no other
        self.last = np.zeros(self.vocabulary, bool)
        if suffix and self.tokenizer.normalizer and self.tokenizer.pre_tokenizer:  # else the whole tokenizer encodes all words
            self.last[[i for token, i in self.bare.get_vocab().items() if token.endswith(suffix)]] = True
        self.words, self.runs = Known(), Known()

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's closed by `end`; how many each text has. Null counts as empty."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        packed = self.words.look_up(words.dictionary, self._spelled).take(words.indices)
        raw, at = unpacked(packed)
        offsets = split.offsets.to_numpy()
        bounds = at[offsets - offsets[0]]
        return np.insert(raw, bounds[1:], end), np.diff(bounds) + 1

    def _spelled(self, new: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The words, and their ids."""
        ascii_only = pc.string_is_ascii(new)
        simple = pc.and_(ascii_only, pc.ascii_is_alpha(new))
        split = pc.and_not(ascii_only, pc.or_(simple, pc.or_(pc.match_substring(new, "'"), pc.match_substring(new, "<|"))))
        letters, mixed, whole = [], [], []
        for w in new.filter(pc.invert(pc.or_(simple, split))).to_pylist():
            if not (w.isascii() or (is_normalized("NFC", w) and "İ" not in w)):
                whole.append(w)
            elif w.isalpha():
                letters.append(w)
            else:
                (whole if JOINED.search(w) else mixed).append(w)
        letters, mixed = (pa.concat_arrays([new.filter(easy), pa.array(w, pa.large_string())]) for easy, w in ((simple, letters), (split, mixed)))
        parts = pa.concat_arrays([letters, pa.array(RUN.findall(joined(mixed)), pa.large_string())]).dictionary_encode()
        ids = self.runs.look_up(parts.dictionary, self._encoded).take(parts.indices)
        raw, at = unpacked(ids.slice(len(letters)))
        gaps = np.flatnonzero(pc.equal(parts.dictionary, " ").take(parts.indices.slice(len(letters))).to_numpy(zero_copy_only=False))
        ends = at[[0, *gaps.tolist(), len(at) - 1]] if len(mixed) else at[:1]
        words = pa.concat_arrays([letters, mixed, pa.array(whole, pa.large_string())])
        return words, pa.concat_arrays([ids.slice(0, len(letters)), binaries(raw, ends), self._whole(whole)])

    def _encoded(self, new: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The runs, and their ids. A space has none."""
        simple = pc.and_(pc.string_is_ascii(new), pc.ascii_is_alpha(new))
        letters, whole = [], []
        for run in new.filter(pc.invert(simple)).to_pylist():
            if run != " ":
                (letters if run.isalpha() else whole).append(run)
        letters = pa.concat_arrays([new.filter(simple), pa.array(letters, pa.large_string())])
        keys, out = [pa.array([SPACE])], [binaries(np.zeros(0, "<u4"), np.zeros(2, np.int64))]
        if not self.last.any():
            letters, whole = letters[:0], whole + letters.to_pylist()
        for at in range(0, len(letters), 1000):
            part = letters.slice(at, 1000)
            ids = np.array(self.bare.encode_batch_fast([joined(part).translate(self.letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                keys.append(part)
                out.append(binaries(ids, np.append(0, ends)))
            else:
                whole += part.to_pylist()
        return pa.concat_arrays([*keys, pa.array(whole, pa.large_string())]), pa.concat_arrays([*out, self._whole(whole)])

    def _whole(self, words: list[str]) -> pa.Array:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else ()
        return pa.array([np.array(g.ids, "<u4").tobytes() for g in got], pa.large_binary())


def joined(words: pa.Array) -> str:
    """The words with a space between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), SPACE)[0].as_py()


def binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids between each two ends, packed."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(ids)])


def unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another; where those of each row begin, and the end."""
    if not len(packed):
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    at = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, 8 * packed.offset) // 4
    raw = np.frombuffer(packed.buffers()[2], "<u4")[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, "<u4")
    return raw, at - at[0]


def sorted_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs as one number each, ascending, and where each of them stood."""
    bits, spare = int(max(left.max(), right.max())).bit_length(), len(left).bit_length()
    if 2 * bits + spare <= 64:  # numbers of pair and place together sort faster than an order is found
        keys = (left.astype(np.uint64) << np.uint64(bits) | right) << np.uint64(spare) | np.arange(len(left), dtype=np.uint64)
        keys.sort()
        return keys >> np.uint64(spare), (keys & np.uint64((1 << spare) - 1)).astype(np.int64)
    keys = left.astype(np.uint64) << np.uint64(32) | right
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def bucket_sizes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of each pair, and how many pairs are in each bucket."""
    bucket = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA6B)) >> np.uint32(14)
    return bucket, np.bincount(bucket, minlength=1 << 18)


def frequent_pairs(left: np.ndarray, right: np.ndarray, least: int, buckets: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the pairs stand that occur `least` times or more, which of them is there (in the order of the pairs), and how many they are.

    Many pairs are counted by hash bucket first; only those in full buckets are counted exactly.
    """
    among = None
    if len(left) > 1 << 14:
        bucket, sizes = buckets or bucket_sizes(left, right)
        among = np.flatnonzero((sizes >= least)[bucket])
        left, right = left[among], right[among]
    if len(left) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    keys, order = sorted_pairs(left, right)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(start, append=len(keys))
    frequent = counts >= least
    slot = np.full(len(keys), -1, np.int64)
    slot[order] = np.repeat(np.where(frequent, np.cumsum(frequent) - 1, -1), counts)
    found = np.flatnonzero(slot >= 0)
    return found if among is None else among[found], slot[found], int(np.count_nonzero(frequent))


def every_other(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Indices of places that do not overlap: of places that follow each other every other one."""
    run = np.flatnonzero(np.append(True, following[:-1] != at[1:])[:len(at)])
    return np.flatnonzero((np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0)


def replaceable(at: np.ndarray, following: np.ndarray, slot: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of places that do not overlap and whose pair is used there `least` times; which of the `n` pairs these are.

    Where pairs are in each other's way, those go first that are more frequent; the others keep the places that are left.
    """
    taken = every_other(at, following)
    used = np.bincount(slot[taken], minlength=n) >= least
    if not used.any() and len(at):
        own = np.argsort(slot, kind="stable")
        taken = own[every_other(at[own], np.where(np.diff(slot[own], append=n) == 0, following[own], -2))]
        sizes = np.bincount(slot[taken], minlength=n)
        ends, fits = np.cumsum(sizes), sizes >= least
        best = np.argsort(-np.bincount(slot, minlength=n), kind="stable")
        chosen, blocked = [], set()
        for k in best[fits[best]].tolist():
            mine = taken[ends[k] - sizes[k]:ends[k]]
            free = [(i, a, b) for i, a, b in zip(mine.tolist(), at[mine].tolist(), following[mine].tolist()) if a not in blocked and b not in blocked]
            if len(free) >= least:
                used[k] = True
                chosen += [i for i, _, _ in free]
                blocked.update(x for _, a, b in free for x in (a, b))
        return np.sort(np.array(chosen, np.int64)), used
    return taken[used[slot[taken]]], used


def linked(n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place after and before each of n places (-1 beyond a row), that all are kept, and where a pair stands."""
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = ends[ends > 0] - 1
    following[last] = -1
    before[last[last + 1 < n] + 1] = -1
    return following, before, np.ones(n, bool), following >= 0


def compress(ids: np.ndarray, row_ends: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, row ends in symbols, left and right part of each rule, ids a rule expands to. No symbol crosses a row's end.

    Frequent pairs go first: the count that a pair needs falls to an eighth when no pair is left over it. At the last level,
    `least`, rounds go on until no pair can be replaced so often. A pair of older symbols never becomes more frequent, so a
    round after a replacement counts only the pairs that hold a new symbol and the frequent ones left over.
    """
    x, ends, level = ids.astype(np.uint32), row_ends.astype(np.int64), max(least, len(ids) // 64)
    lefts, rights, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], np.ones(base, np.int64)
    following, before, kept, paired = linked(len(x), ends)
    places, whole = np.flatnonzero(paired), True
    while True:
        left, right = x[places], x[following[places]]
        buckets = bucket_sizes(left, right) if len(places) > 1 << 14 else None
        while whole and buckets and level > least and buckets[1].max() < level:  # no pair of all is left over that level
            level = max(least, level // 8)
        found, slot, pairs = frequent_pairs(left, right, level, buckets)
        at = places[found]
        chosen, used = replaceable(at, following[at], slot, pairs, least)
        if not len(chosen):
            if level == least:
                break
            level = max(least, level // 8)
            x, ends = x[kept], np.append(0, np.cumsum(kept))[ends]
            following, before, kept, paired = linked(len(x), ends)
            places, whole = np.flatnonzero(paired), True
            continue
        here, number = at[chosen], (np.cumsum(used) - 1)[slot[chosen]]
        gone = following[here]
        new_left, new_right = np.zeros((2, int(used.sum())), np.uint32)
        new_left[number], new_right[number] = x[here], x[gone]
        x[here] = len(lengths) + number
        lefts.append(new_left)
        rights.append(new_right)
        lengths = np.append(lengths, lengths[new_left] + lengths[new_right])
        behind = following[gone]
        following[here], kept[gone], paired[gone] = behind, False, False
        inside = behind >= 0
        paired[here], before[behind[inside]] = inside, here[inside]
        again, whole = np.zeros(len(x), bool), False
        again[at] = again[here] = again[before[here]] = True  # without a place before, the last one, where no pair stands
        places = np.flatnonzero(again & paired)
    return x[kept], np.append(0, np.cumsum(kept))[ends], np.concatenate(lefts), np.concatenate(rights), lengths[base:]


def expand(symbols: np.ndarray, lefts: np.ndarray, rights: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for. Each rule that they use is expanded once."""
    x, composed = symbols.astype(np.uint32), symbols >= base
    used = np.zeros(len(lefts), bool)
    used[x[composed] - base] = True
    if not used.any():
        return x
    flat = np.flatnonzero(used).astype(np.uint32) + np.uint32(base)
    owner = np.arange(len(flat))
    while (inner := flat >= base).any():
        width = 1 + inner.astype(np.int64)
        start = np.cumsum(width) - width
        rule, flat, owner = flat[inner] - base, np.repeat(flat, width), np.repeat(owner, width)
        flat[start[inner]], flat[start[inner] + 1] = lefts[rule], rights[rule]
    width, first = np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
    sizes, number = np.bincount(owner), (np.cumsum(used) - 1)[x[composed] - base]
    width[composed], first[composed] = sizes[number], (np.cumsum(sizes) - sizes)[number]
    out, many = np.repeat(x, width), np.repeat(composed, width)
    at = np.arange(len(out)) + np.repeat(first - (np.cumsum(width) - width), width)
    out[many] = flat[at[many]]
    return out


def id_range(symbols: np.ndarray, lefts, rights, rule_lengths, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a document's symbols; symbols outside the range are skipped by their expansion lengths."""
    width = np.ones(len(symbols), np.int64)
    composed = symbols >= base
    width[composed] = np.asarray(rule_lengths)[symbols[composed] - base]
    ends = np.cumsum(width)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], lefts, rights, base)[start - skipped:stop - skipped]


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32)))


def slices(batch: pa.RecordBatch, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows, and of `most` bytes of text unless a single text is longer."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def write_token_files(docs: DataFrame, path: str, model: str, *, end: int = 1, doc_id: str = "doc_id", text: str = "text",
                      block_ids: int = BLOCK_IDS) -> None:
    """Encode the texts, append the end id to each, and write the blocks in ascending id order. `model`: a tokenizer's JSON."""
    shared, digest = docs.sparkSession.sparkContext.broadcast(model), hashlib.md5(model.encode()).hexdigest()  # one fixed vocabulary
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    order = ["id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions(*order)

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = for_worker("pieces", digest, lambda: PieceEncoder(shared.value))
        shard, n = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # keys, ids one after another, ids of each document

        def pack() -> pa.RecordBatch:
            keys, ids, tokens = (join([part[k] for part in held]) for k, join in enumerate((pa.concat_arrays, np.concatenate, np.concatenate)))
            symbols, ends, lefts, rights, lengths = compress(ids, np.cumsum(tokens), encoder.vocabulary)
            narrow = encoder.vocabulary + len(lefts) <= 1 << 16
            one = {"shard": pa.array([shard], pa.int32()), "block": pa.array([n], pa.int32()), "n_tokens": pa.array([len(ids)], pa.int64()),
                   "base": pa.array([encoder.vocabulary], pa.int32()), "lefts": _one_list(lefts), "rights": _one_list(rights), "rule_lengths": _one_list(lengths),
                   "symbols": pa.array([symbols.astype("<u2" if narrow else "<u4").tobytes()], pa.binary()),
                   "docs": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                   "doc_symbols": _one_list(np.diff(ends, prepend=0)), "doc_tokens": _one_list(tokens)}
            return pa.RecordBatch.from_arrays(list(one.values()), list(one))

        size = 0
        for batch in batches:
            for part in slices(batch):
                keys = pa.array(part.column("id").to_pylist(), part.column("id").type)  # a slice would hold the texts of its batch
                ids, tokens = encoder.encode(part.column("text"), end)
                ends, done, cut = np.cumsum(tokens), 0, 0
                while done < len(tokens):  # a block is full with the document that reaches its size
                    stop = min(len(tokens), int(np.searchsorted(ends, cut + block_ids - size)) + 1)
                    held.append((keys[done:stop], ids[cut:ends[stop - 1]], tokens[done:stop]))
                    size += int(ends[stop - 1]) - cut
                    done, cut = stop, int(ends[stop - 1])
                    if size >= block_ids:
                        yield pack()
                        held, size, n = [], 0, n + 1
        if held:
            yield pack()
        held = []
        give_back()

    dealt.mapInArrow(block_rows, BLOCK.format(id=rows.schema["id"].dataType.simpleString())).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids (packed 32-bit little-endian) of each document."""
    blocks = spark.read.parquet(path)
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # one row for each writing task
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    starts = sizes.withColumn("inside", inside).join(before, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))
    id_type = blocks.schema["docs"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                lefts, rights, tokens = (row[name].values.to_numpy(zero_copy_only=False) for name in ("lefts", "rights", "doc_tokens"))
                base, first, keys = row["base"].as_py(), row["start"].as_py(), row["docs"].values
                width = 2 if base + len(lefts) <= 1 << 16 else 4
                symbols = np.frombuffer(row["symbols"].as_buffer(), f"<u{width}")
                ids = expand(symbols, lefts.astype(np.uint32), rights.astype(np.uint32), base)
                tokens = tokens.astype(np.int64)
                ends = np.cumsum(tokens)
                raw = ids.astype("<u4").tobytes()
                for i in range(0, len(tokens), 512):
                    part = slice(i, i + 512)
                    yield pa.RecordBatch.from_arrays(
                        [keys[part], pa.array(first + (ends - tokens)[part], pa.int64()), pa.array(tokens[part], pa.int64()),
                         pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends[part].tolist(), tokens[part].tolist())], pa.binary())],
                        ["id", "start", "n_tokens", "ids"])
        give_back()

    used = blocks.select("shard", "block", "base", "lefts", "rights", "symbols", "docs", "doc_tokens")
    return used.join(starts, ["shard", "block"]).mapInArrow(documents, f"id {id_type}, start bigint, n_tokens bigint, ids binary")
