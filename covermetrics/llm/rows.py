"""Row keys and scratch tables that the operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from sys import getsizeof
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.llm.buffers import scramble, text_bytes
from covermetrics.session import scratch_path


def row_key(id_column: str, text_column: str) -> Column:
    """Key of a row: its id and a hash of id and text. Rows equal in both are one occurrence and share every decision."""
    return F.struct(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
                    F.xxhash64(id_column, text_column).alias("hash"))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back: later jobs start there, also after lost executors."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def for_worker(kind: str, key: str, make):
    """An object that a Python worker keeps for its later tasks, such as a vocabulary with its cache. It keeps one: the
    next stage's object takes its place."""
    holder = sys.modules.setdefault("_kept_for_tasks", ModuleType("_kept_for_tasks"))
    found = getattr(holder, "found", None)
    if found is None or found[0] != (kind, key):
        holder.found = None  # frees the old one before the new one is made
        found = holder.found = ((kind, key), make())
    return found[1]


def give_back() -> None:
    """For the end of a task: memory that Python and Arrow have freed goes back to the system, as the worker waits for its
    next task beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work, most: int = 2048):
    """`work` on slices of at most `most` rows, so that its arrays stay small whatever the session's batches are."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from work(column.slice(at, most) for column in batches for at in range(0, len(column), most))
        give_back()
    return run


class Remembered:
    """Results of the strings seen last: two generations, each bounded by bytes up to the strings of one call.

    After `unseen` and `learn`, `now` holds all strings of the call.
    """

    def __init__(self, most: int = 32 << 20):
        self.most, self.size = most, 0
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def unseen(self, strings: set[str], fresh: bool = True) -> set[str]:
        """The strings without a result; those of the older generation come back first. `fresh` False: more strings of the same call."""
        if fresh and self.size > self.most:
            self.older, self.now, self.size = self.now, {}, 0
        new = strings.difference(self.now)
        self.learn({s: self.older[s] for s in new.intersection(self.older)})
        return new.difference(self.now)

    def learn(self, results: dict[str, bytes]) -> None:
        self.now.update(results)
        self.size += sum(map(getsizeof, results)) + sum(map(len, results.values())) + 133 * len(results)

    def rest(self) -> None:
        """For the end of a task: a worker that waits keeps one generation."""
        self.older = {}


class Known:
    """Results of the strings seen last, in two Arrow arrays: a string takes its own bytes, not those of a Python object.

    A table of `SLOTS` places names the last string of each place, which is compared with the one looked up; one that has
    lost its place is made again. When the arrays exceed `most` bytes, only the strings of that call stay, and what it learns.
    """

    SLOTS = 20  # bits

    def __init__(self, most: int = 24 << 20):
        self.most = most
        self.keys, self.results = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.places = np.full(1 << self.SLOTS, -1, np.int32)

    def look_up(self, keys: pa.Array, make) -> pa.Array:
        """The results of distinct strings. `make` gives the unseen ones, in any order, with their results."""
        keys = keys.cast(pa.large_string())
        slot = slots(keys, self.SLOTS)
        at = self.places[slot].astype(np.int64)
        known = at >= 0
        if known.any():
            known &= pc.equal(keys, self.keys.take(pa.array(np.maximum(at, 0)))).to_numpy(zero_copy_only=False)
        if known.all():
            return self.results.take(pa.array(at))
        new = keys.filter(pa.array(~known))
        more, made = make(new)
        if self.keys.nbytes + self.results.nbytes > self.most:
            here = pa.array(at[known])
            self.keys, self.results = self.keys.take(here), self.results.take(here)
            at[known] = np.arange(len(here))
            self.places[:] = -1
            self.places[slot[known]] = at[known]
        at[~known] = len(self.keys) + pc.index_in(new, more).to_numpy()
        self.places[slot[~known]] = at[~known]
        self.keys, self.results = pa.concat_arrays([self.keys, more]), pa.concat_arrays([self.results, made])
        return self.results.take(pa.array(at))


LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slots(strings: pa.Array, bits: int) -> np.ndarray:
    """A number of `bits` bits for each string, from its length and its first and last eight bytes."""
    raw, at = text_bytes(strings)
    eight = np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(8, np.uint8)), 0, (1,))  # from each byte on
    size = np.diff(at)
    leading = LEADING[np.minimum(size, 8)]
    first, last = eight[at[:-1]] & leading, eight[np.maximum(at[1:] - 8, at[:-1])] & leading
    return (scramble(first * np.uint64(0x9E3779B97F4A7C15) ^ last + size.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
