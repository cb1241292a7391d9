"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

Line features come from the line and both its neighbours. Training starts from the document's label on every line; between
rounds, lines of bad documents that the model finds good become good, but each bad document keeps its worst line bad.
A document's quality is the length-weighted mean of the lines' forward-backward marginals, mapped to a probability by a
logistic curve over that mean and the worst line.

A null or empty text is one empty line. The result depends on the text alone. With no labelled rows of both classes every
score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.llm.buffers import SPACES, Rolling, block_arrays, byte_table, row_of, spans
from covermetrics.llm.rows import lean

CLASSES = (bytes(range(65, 91)), b"0123456789", b"#*$%&", b"!", b"|<>", SPACES, bytes(range(128, 256)), b".,;:?")
N_OWN = len(CLASSES) + 5
N_FEATURES = 1 + 3 * N_OWN
SAMPLE = 6000  # labelled documents that training reads at most
C = F.col


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, empty ones too, and the first line of each text (with the total at the end)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    lines = 1 + np.diff(np.searchsorted(breaks, offsets))
    return starts, ends, np.concatenate([[0], np.cumsum(lines)])


def line_features(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and bytes of each line, and the first line of each text."""
    starts, ends, first = line_bounds(data, offsets)
    size = ends - starts
    own = np.zeros((len(starts), N_OWN), np.float32)
    sums = np.zeros(len(data) + 1, np.int64)
    for k, members in enumerate(CLASSES):
        np.cumsum(byte_table(members)[data], out=sums[1:])
        own[:, k] = (sums[ends] - sums[starts]) / np.maximum(size, 1)
    word_starts, word_ends = spans(~byte_table(SPACES)[data], offsets)
    hashes = rolling.words(data, word_starts, word_ends)
    at = np.searchsorted(word_starts, starts)
    words = np.searchsorted(word_starts, ends) - at
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        inner = np.ones(len(hashes), bool)
        inner[at[at < len(hashes)]] = False
        same[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & inner[1:])
    own[:, -5] = (same[at + words] - same[at]) / np.maximum(words, 1)
    own[:, -4] = np.log1p(size) / 5
    own[:, -3] = size / np.maximum(words, 1) / 10
    own[:, -2] = words == 0
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys = rolling.ranges(data.astype(np.uint64) + np.uint64(1), starts, ends, 0x9E3779B97F4A7C15) ^ rows.astype(np.uint64)
    _, earliest = np.unique(keys, return_index=True)
    repeat = np.ones(len(starts), bool)
    repeat[earliest] = False
    own[:, -1] = repeat & (words > 0)
    np.minimum(own, 4, out=own)
    out = np.zeros((len(starts), N_FEATURES), np.float32)
    out[:, 0] = 1
    out[:, 1:1 + N_OWN] = own
    later = np.ones(len(starts), bool)
    later[first[:-1]] = False
    out[1:, 1 + N_OWN:1 + 2 * N_OWN] = own[:-1] * later[1:, None]
    out[:-1, 1 + 2 * N_OWN:] = own[1:] * later[1:, None]
    return out, size, first


def forward_backward(good: np.ndarray, first: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (bad, good) of each line, expected transitions of each text, and log of each text's normaliser.

    `good` is the score of the label good per line (bad scores 0), `link` the 2 x 2 transition scores. Texts are taken
    together, longest first, one line of each per step.
    """
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")
    begin, length = first[:-1][order], n_lines[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    ahead, behind = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    node = np.stack([np.zeros(len(good)), good], 1)
    ahead[begin] = node[begin]
    for t in range(1, len(active)):
        i = begin[:active[t]] + t
        ahead[i] = node[i] + np.logaddexp.reduce(ahead[i - 1][:, :, None] + link, axis=1)
    for t in range(len(active) - 2, -1, -1):
        i = begin[:active[t + 1]] + t
        behind[i] = np.logaddexp.reduce(link + (node[i + 1] + behind[i + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(ahead[first[1:] - 1], axis=1)
    each = np.repeat(total, n_lines)
    marginals = np.exp(ahead + behind - each[:, None])
    moves = np.zeros((2, 2))
    inner = np.ones(len(good), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    if len(j):
        moves = np.exp(ahead[j - 1][:, :, None] + link + (node[j] + behind[j])[:, None, :] - each[j][:, None, None]).sum(0)
    return marginals, moves, total


@dataclass
class LineModel:
    weights: np.ndarray
    link: np.ndarray
    curve: tuple[float, float, float]

    def scores(self, features: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(_document_inputs(*self.marginals(features, first), size) @ np.array(self.curve))))

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return forward_backward(features @ self.weights, first, self.link)[0][:, 1], first


def _document_inputs(good: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1, log odds of the length-weighted mean marginal, log odds of the worst line."""
    weight = size + 1.0
    mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    worst = np.minimum.reduceat(good, first[:-1])
    both = np.clip(np.stack([mean, worst], 1), 1e-3, 1 - 1e-3)
    return np.column_stack([np.ones(len(mean)), np.log(both / (1 - both))])


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def train(features: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray, *, rounds: int = 3, steps: int = 60,
          penalty: float = 1e-3) -> LineModel:
    """Fit the field to the labelled texts; classes weigh alike."""
    n_lines = np.diff(first)
    document = np.repeat(np.arange(len(labels)), n_lines)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    importance = (0.5 / share)[labels] / len(labels)
    line_weight = importance[document]
    x = features.astype(np.float64)
    line_labels = labels[document].copy()
    params = np.zeros(features.shape[1] + 4)
    order = np.argsort(labels, kind="stable")

    def parts(which: np.ndarray):
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in which]) if len(which) else np.zeros(0, np.int64)
        return rows, np.concatenate([[0], np.cumsum(n_lines[which])])
    groups = [(label, *parts(order[labels[order] == label])) for label in (0, 1)]

    for _ in range(rounds):
        def gradient(p: np.ndarray) -> np.ndarray:
            out = penalty * p
            for label, rows, starts in groups:  # transitions are summed per class, whose texts weigh alike
                marginals, moves, _ = forward_backward(x[rows] @ p[:-4], starts, p[-4:].reshape(2, 2))
                w = line_weight[rows]
                out[:-4] += x[rows].T @ ((marginals[:, 1] - line_labels[rows]) * w)
                seen = np.zeros((2, 2))
                inner = np.ones(len(rows), bool)
                inner[starts[:-1]] = False
                j = np.flatnonzero(inner)
                np.add.at(seen, (line_labels[rows[j - 1]], line_labels[rows[j]]), 1)
                out[-4:] += ((moves - seen) * (0.5 / share[label] / len(labels))).ravel()
            return out / max(1.0, line_weight.sum())
        params = _adam(gradient, params, steps, 0.15)
        good, _ = LineModel(params[:-4], params[-4:].reshape(2, 2), (0, 0, 0)).marginals(x, first)
        worst = np.minimum.reduceat(good, first[:-1])[document]
        line_labels = np.where(labels[document] == 1, 1, ((good > 0.5) & (good > worst)).astype(labels.dtype))
    inputs = _document_inputs(good, first, size)

    def curve_gradient(c: np.ndarray) -> np.ndarray:
        return inputs.T @ (1 / (1 + np.exp(-inputs @ c)) - labels) / len(labels) + 1e-3 * c
    return LineModel(params[:-4], params[-4:].reshape(2, 2), tuple(_adam(curve_gradient, np.zeros(3), 400, 0.1)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> LineModel | None:
    """A model from at most `sample` labelled documents outside the held-out fold, the first in hash order."""
    usable = labels.where(C(label).isin(0, 1) & ~held_out(C(doc_id))).groupBy(doc_id).agg(F.max(label).alias("__label"))
    chosen = usable.orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    texts = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)  # at most `sample` rows of two numbers

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling = Rolling()
        for column in batches:
            out = []
            for data, offsets in block_arrays(column):
                features, size, first = line_features(data, offsets, rolling)
                table = np.column_stack([features, size]).astype(np.float32)
                out += [table[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.array(out, pa.binary())
    rows = texts.select("__label", F.arrow_udf(lean(measure), "binary")(C(text)).alias("lines")).collect()
    known = np.array([r[0] for r in rows], np.int64)
    if len(set(known.tolist())) < 2:
        return None
    tables = [np.frombuffer(r[1], np.float32).reshape(-1, N_FEATURES + 1) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(t) for t in tables])])
    every = np.concatenate(tables)
    return train(every[:, :-1], every[:, -1].astype(np.float64), first, known)


def score(docs: DataFrame, model: LineModel | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """The documents with their quality, 0 to 1, in the double column `out`."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling = Rolling()
        for column in batches:
            parts = [model.scores(*line_features(data, offsets, rolling)) for data, offsets in block_arrays(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
    return docs.withColumn(out, F.arrow_udf(lean(measure), "double")(F.col(text)))


