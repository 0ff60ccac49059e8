"""Toxicity by a factorization machine over hashed terms: it learns how pairs of terms act together, not only each alone."""

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

#: Hashed terms; labelled rows to learn from at most; latent factors of a term; least rows of a term that gets weights; z-score under which a term alone says little; bytes of a prefix.
TERMS, ROWS, FACTORS, LEAST_ROWS, LEAST_Z, PREFIX = 1 << 18, 8000, 4, 4, 4.0, 5
#: Passes of the training over its rows.
PASSES = 60


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row of each term, hashed term) of consecutive rows.

    A term is a run of letters, digits and non-ASCII characters, or the first PREFIX bytes of a longer one: words that
    are rare in the sample share it.
    """
    for a, b, data, at in textwords.groups(column):
        starts, ends, first = textwords.boundaries(data, at, textwords.MARKS)
        row = np.repeat(np.arange(b - a), np.diff(first))
        long = ends - starts > PREFIX
        hashed = np.concatenate([textwords.hashes(data, starts, ends), ~textwords.hashes(data, starts[long], starts[long] + PREFIX)])
        yield b - a, np.concatenate([row, row[long]]), (hashed >> np.uint64(46)).astype(np.int64)


def _distinct(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n, row, term in _terms(column):
        pairs = np.unique(row * TERMS + term)
        for x in np.split(pairs % TERMS, np.searchsorted(pairs, np.arange(1, n) * TERMS)):
            yield x, np.zeros(0)  # a distinct term counts once


@dataclass
class FactorizationMachine:
    """slot: the row of the weights that a hashed term has, 0 for none; w, v: linear weights and factors by row (row 0 is zero)."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, n: int, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """bias + sum w + sum over pairs <v_i, v_j> of the distinct slots of n rows, in time linear in the slots."""
        out = self.bias + np.bincount(row, self.w[slot], n)
        for f in range(self.v.shape[1]):
            x = self.v[slot, f]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [np.zeros(0)]
        for n, row, term in _terms(column):
            slot = self.slot[term].astype(np.int64)
            known = np.unique(row[slot > 0] * len(self.w) + slot[slot > 0])
            parts.append(sigmoid(self.logits(n, known // len(self.w), known % len(self.w))))
        return np.concatenate(parts)


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = PASSES, rate: float = 0.2, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> FactorizationMachine:
    """Minimise the log loss by adaptive gradients over all terms of at least LEAST_ROWS rows, in ``epochs`` passes.

    Terms that do not tell the labels apart alone (|z| < LEAST_Z) are held back by the standard error of their gradient
    and not left out: their linear weight moves once its gradient is beyond LEAST_Z of it, their factors grow once their
    pairs are beyond what the chance pairs of a row of that many terms add up to.
    """
    slot = np.zeros(TERMS, np.int32)
    if not len(y) or y.min() == y.max():
        base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return FactorizationMachine(slot, float(np.log(base / (1 - base))), np.zeros(1), np.zeros((1, FACTORS)))
    seen = np.bincount(np.concatenate([i for i, _ in x]), minlength=TERMS)
    toxic = np.bincount(np.concatenate([np.zeros(0, np.int64), *(i for (i, _), t in zip(x, y, strict=True) if t)]), minlength=TERMS)
    rate1 = y.mean()
    chosen = np.flatnonzero(seen >= LEAST_ROWS)
    slot[chosen] = np.arange(1, len(chosen) + 1)
    rows = [np.concatenate([slot[:1] * 0, slot[i][slot[i] > 0]]) for i, _ in x]  # slot 0, which stays zero, keeps every row from being empty
    seen, toxic = seen[chosen], toxic[chosen]
    z = (toxic - seen * rate1) / np.sqrt(seen * rate1 * (1 - rate1))
    error1 = np.concatenate([[0], np.where(np.abs(z) < LEAST_Z, 0.25 * np.sqrt(seen / (rate1 * (1 - rate1))) / len(y), 0)])
    hold_w, hold_v = LEAST_Z * error1, 2 * np.sqrt(np.mean([len(i) - 1 for i in rows])) * error1[:, None]
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(slot, 0.0, np.zeros(len(chosen) + 1), rng.normal(0, 0.05, (len(chosen) + 1, FACTORS)))
    m.v[0] = 0
    weight = np.where(y == 1, 0.5 / rate1, 0.5 / (1 - rate1))  # both labels count alike
    gw, gv, gb = np.full_like(m.w, 1e-6), np.full_like(m.v, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for some in np.split(order, range(batch, len(order), batch)):
            s, n = np.concatenate([rows[k] for k in some]), [len(rows[k]) for k in some]
            first, v = np.cumsum(n) - n, m.v[s]
            sums = np.add.reduceat(v, first)
            logits = m.bias + np.add.reduceat(m.w[s] - 0.5 * np.einsum("ij,ij->i", v, v), first) + 0.5 * (sums**2).sum(1)
            error = (sigmoid(logits) - y[some]) * weight[some] / len(some)
            dw = np.bincount(s, np.repeat(error, n), len(m.w))
            dv = np.stack([np.bincount(s, np.repeat(error * sums[:, f], n), len(m.w)) for f in range(FACTORS)], 1) - m.v * dw[:, None]
            dw += decay * m.w / len(order) * batch
            dv += decay * m.v / len(order) * batch
            gw += dw**2
            gv += dv**2
            gb += error.sum() ** 2
            step = rate / np.sqrt(gw)
            m.w -= step * dw
            m.w = np.sign(m.w) * np.maximum(np.abs(m.w) - step * hold_w, 0)
            step = 0.3 * rate / np.sqrt(gv)
            m.v = (m.v - step * dv) / (1 + step * hold_v)
            m.bias -= rate * error.sum() / np.sqrt(gb)
            m.w[0], m.v[0] = 0, 0
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled rows outside the held-out fold (crc32(doc_id) % 3 = 1)."""
    return fit(*training_rows(docs, labels, "toxic", held_out(3, 1), rows, _distinct))


def toxicity_scores(docs: DataFrame, labels: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of every row of docs, and as ``name`` its score from 0 to 1 (higher: likelier toxic).

    A null or empty text gets the score of a text without known terms. Only ``text`` is scored; without labelled rows
    every score is 0.5, with labels of one kind only it is their share, held within 0.01 and 0.99.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return score_rows(docs, lambda column: model.value.scores(column), columns, name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity_scores(docs, labels, ["doc_id"])
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
