"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged, into a softmax.

Vectors and output weights are learned together by stochastic gradient descent. As the output is linear in the average,
the trained model is folded into one number per hashed feature before scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textwords
from .common import table
from .labelled import THRESHOLD, held_out, score_rows, sigmoid, training_rows

#: Hashed features; labelled rows to learn from at most; size of a vector; lengths of character n-grams in bytes.
FEATURES, ROWS, SIZE, NGRAMS = 1 << 18, 3000, 8, (3, 4)
_BYTE = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row of each feature, hashed feature): words, a mark for a word that repeats the one before, and byte n-grams with case."""
    for a, b, data, at in textwords.groups(column, 1 << 20):
        starts, ends, first = textwords.boundaries(data, at)
        words = textwords.hashes(data, starts, ends)
        row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(first))
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        rows, hashed = [row, row[again]], [(words >> np.uint64(46)).astype(np.int32), np.full(again.sum(), 1, np.int32)]
        of_byte = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(at))
        value = _BYTE[data]
        for n in NGRAMS:
            m = max(0, len(data) - n + 1)
            h = np.zeros(m, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + value[j : j + m]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            inside = of_byte[:m] == of_byte[n - 1 :][:m]
            rows.append(of_byte[:m][inside])
            hashed.append((h >> np.uint32(14)).astype(np.int32)[inside])
        yield b - a, np.concatenate(rows), np.concatenate(hashed)


def _counted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n, row, feature in _features(column):
        pairs, counts = np.unique(row.astype(np.int64) * FEATURES + feature, return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(1, n) * FEATURES)
        yield from zip(np.split(pairs % FEATURES, cuts), np.split(counts, cuts), strict=True)


@dataclass
class SubwordModel:
    """weight: the difference of the two outputs that a feature adds; bias: that of an empty text."""

    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [np.zeros(0)]
        for n, row, feature in _features(column):
            total = np.bincount(row, self.weight[feature], n)
            parts.append(sigmoid(self.bias + total / np.maximum(1, np.bincount(row, minlength=n))))
        return np.concatenate(parts)


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 4.0, seed: int = 3) -> SubwordModel:
    """Stochastic gradient descent on the log loss of a softmax over two labels, one document at a time; the rate falls to 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (FEATURES, SIZE)).astype(np.float32)
    out, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(y))
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            ids, counts = x[k]
            now, step = rate * (1 - step / steps), step + 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[ids] if len(ids) else np.zeros(SIZE, np.float32)
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[int(y[k])] -= 1
            back = error @ out
            out -= now * np.outer(error, mean)
            bias -= 0.02 * now * error
            vectors[ids] -= now * share[:, None] * back
    return SubwordModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> SubwordModel:
    """Fit on at most ``rows`` labelled rows outside the held-out fold (crc32(doc_id) % 4 = 2)."""
    return fit(*training_rows(docs, labels, "quality", held_out(4, 2), rows, _counted))


def quality_scores(docs: DataFrame, labels: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of every row of docs, and as ``name`` its score from 0 to 1 (higher: likelier good).

    A null or empty text gets the score of the bias alone. Only ``text`` is scored; without labelled rows every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return score_rows(docs, lambda column: model.value.scores(column), columns, name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_scores(docs, labels, ["doc_id"])
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
