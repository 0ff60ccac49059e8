"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH and exact verification.

A document leaks an item if some stretch of its words is within ``share`` edits per word of the item. Windows of the
item's size are embedded by CGK random walks, under which a small edit distance becomes a small Hamming distance; several
samples of coordinates of several walks are hashed, windows and items that share a hash are candidates, and each is
verified by the edit distance itself. Windows are laid only where the document shares a run of words with an item, on the
diagonal of that run: e edits cut an item of m words into e + 1 runs at most, so that one of (m - e) / (e + 1) words or
more is untouched, and a seed of no more words than that (three at most) loses nothing. The LSH alone, over windows at
every place, reaches the target recall too (tests/llm measures it); the seeds save the embedding of most windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textwords
from .common import table

#: Words of a seed run at most, items and bytes of items of one pass over the documents, CGK walks, coordinates of a sample.
SEED, BLOCK_ITEMS, BLOCK_BYTES, WALKS, COORDINATES = 3, 20_000, 16 << 20, 6, 2
#: Leading bytes of the three-byte characters from U+3000 to U+9FFF, which are written without spaces: each is a word.
_CJK = np.zeros(256, bool)
_CJK[0xE3:0xEA] = True


def samples_for(recall: float, agreement: float = 0.35) -> int:
    """Samples so that a pair whose embeddings agree in that share of coordinates meets with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**COORDINATES) / WALKS) * WALKS


def words_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, first word of each row and the number of words) of consecutive rows.

    A word is a run of letters, digits and other characters beyond ASCII, or one character of a script without spaces.
    """
    for _, _, data, at in textwords.groups(column):
        starts, ends, first = textwords.boundaries(data, at, textwords.MARKS)
        alone = np.flatnonzero(_CJK[data])
        if len(alone):
            bounds = np.unique(np.concatenate([starts, ends, alone, alone + 3]))
            inside = np.searchsorted(starts, bounds[:-1], "right") > np.searchsorted(ends, bounds[:-1], "right")
            starts, ends = bounds[:-1][inside], bounds[1:][inside]
            first = np.searchsorted(starts, at)
        yield textwords.hashes(data, starts, ends), first


def seed_words(m: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Words of the seeds of items of m words: no more than the longest untouched run has, whatever the edits."""
    return np.minimum(SEED, -(-(m - edits) // (edits + 1)))


def cgk(x: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The first steps of one CGK walk over each row of words: each step writes the word at the pointer, and a random bit of (step, word) moves it on."""
    rows, m = x.shape
    padded = np.concatenate([x, np.zeros((rows, 1), np.uint64)], 1)
    at, out, every = np.zeros(rows, np.int64), np.empty((rows, steps), np.uint64), np.arange(rows)
    salts = textwords.mix(np.arange(walk * 1_000_003 + 1, walk * 1_000_003 + 1 + steps, dtype=np.uint64))
    for j in range(steps):
        out[:, j] = padded[every, np.minimum(at, m)]
        at += (textwords.mix(out[:, j] ^ salts[j]) & np.uint64(1)).astype(np.int64)
    return out


def lsh_keys(x: np.ndarray, samples: int) -> np.ndarray:
    """A hash per row of words and sample: of the sample's coordinates in its walk. Coordinates that would lie past the words are not sampled."""
    m = x.shape[1]
    steps = max(1, math.floor(1.5 * m))
    keys = np.empty((len(x), samples), np.uint64)
    with np.errstate(over="ignore"):
        for walk in range(WALKS):
            out = cgk(x, walk, steps)
            for k in range(walk, samples, WALKS):
                c = np.random.default_rng([m, k]).choice(steps, min(COORDINATES, steps), replace=False)
                h = np.full(len(x), k + 1, np.uint64)
                for j in c:
                    h = textwords.mix(h * np.uint64(0x9E3779B97F4A7C15) + out[:, j])
                keys[:, k] = h
    return keys


def edit_distances(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the least edit distance of the item to any stretch of the region, and where the first such stretch ends."""
    rows, m = items.shape
    n = regions.shape[1]
    place = np.arange(n + 1)
    d = np.zeros((rows, n + 1), np.int64)
    for i in range(m):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + (regions != items[:, i : i + 1]), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - place, 1) + place
    return d.min(1), d.argmin(1)


@dataclass
class ItemIndex:
    """Items by their number of words: their words, allowed edits, LSH keys; seeds: by words of a seed, (hashes, items, places, table of the hashes' first bits)."""

    ids: np.ndarray
    lengths: np.ndarray
    words: list
    edits: np.ndarray
    size: np.ndarray
    seeds: dict
    keys: dict
    samples: int

    @classmethod
    def build(cls, ids: list[int], texts: list[str], share: float, recall: float) -> ItemIndex:
        words, kept = [], []
        for item, text in zip(ids, texts, strict=True):
            w = next(words_of(pa.array([text])))[0]
            if len(w):
                words.append(w)
                kept.append(item)
        lengths = np.array([len(w) for w in words], np.int64)
        edits = np.floor(share * lengths + 1e-9).astype(np.int64)
        size, seeds = seed_words(lengths, edits), {}
        for k in np.unique(size).tolist():
            these = np.flatnonzero(size == k)
            grams = [textwords.ngram_hashes(words[i], k) for i in these]
            hashes = np.concatenate(grams)
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(1 << 22, bool)
            maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True
            seeds[k] = (hashes[order], np.repeat(these, [len(g) for g in grams])[order], np.concatenate([np.arange(len(g)) for g in grams])[order], maybe)
        samples, keys = samples_for(recall), {}
        for m in np.unique(lengths).tolist():
            these = np.flatnonzero(lengths == m)
            k = lsh_keys(np.stack([words[i] for i in these]), samples)
            owner = np.repeat(these, samples)
            by = np.argsort(k.ravel(), kind="stable")
            keys[m] = (k.ravel()[by], owner[by])
        return cls(np.array(kept, np.int64), lengths, words, edits, size, seeds, keys, samples)

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, word after the last) of the best stretch for each row and item that match."""
        best: dict[tuple[int, int], tuple] = {}
        for k in self.seeds:
            self._search(words, first, k, best)
        return [(r, i, *found) for (r, i), found in sorted(best.items())]

    def _search(self, words: np.ndarray, first: np.ndarray, size: int, best: dict) -> None:
        seeds, seed_item, seed_at, maybe = self.seeds[size]
        runs = textwords.ngram_hashes(words, size)
        hit = np.flatnonzero(maybe[(runs >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(seeds, runs[hit], "left"), np.searchsorted(seeds, runs[hit], "right")
        at, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + size <= first[row + 1]
        at, lo, n, row = at[inside], lo[inside], n[inside], row[inside]
        if not len(at):
            return
        # Edits destroy ``size`` runs each at most, so a leak keeps this many of the item's runs; most chance hits go here.
        row, start, item, place = (np.concatenate(x) for x in zip(*self._hits(at, lo, n, row, seed_item, seed_at), strict=True))
        pair = row * len(self.ids) + item
        kept = np.unique(np.stack([pair, place], 1), axis=0)[:, 0]
        pairs, times = np.unique(kept, return_counts=True)
        i = pairs % len(self.ids)
        enough = pairs[times >= np.maximum(1, self.lengths[i] - size + 1 - size * self.edits[i])]
        good = np.isin(pair, enough)
        windows = np.unique(np.stack([row[good], start[good], self.lengths[item[good]]], 1), axis=0)
        for m in np.unique(windows[:, 2]).tolist():
            self._verify(words, first, windows[windows[:, 2] == m], m, best)

    @staticmethod
    def _hits(at: np.ndarray, lo: np.ndarray, n: np.ndarray, row: np.ndarray, seed_item: np.ndarray, seed_at: np.ndarray) -> Iterator[tuple]:
        """(row, start of the diagonal, item, place in the item) of each shared run."""
        for part in np.array_split(np.arange(len(at)), max(1, int(n.sum()) // 100_000)):
            times = n[part]
            entry = np.repeat(lo[part] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            yield np.repeat(row[part], times), np.repeat(at[part], times) - seed_at[entry], seed_item[entry], seed_at[entry]

    def _verify(self, words: np.ndarray, first: np.ndarray, windows: np.ndarray, m: int, best: dict) -> None:
        for some in np.array_split(windows, max(1, len(windows) // 4000)):
            row, start = some[:, 0], some[:, 1]
            begin, end = first[row], first[row + 1]
            at = start[:, None] + np.arange(m)
            x = np.where((at >= begin[:, None]) & (at < end[:, None]), words[np.clip(at, 0, len(words) - 1)], np.uint64(1))
            keys, (known, owner) = lsh_keys(x, self.samples), self.keys[m]
            lo, hi = np.searchsorted(known, keys.ravel(), "left"), np.searchsorted(known, keys.ravel(), "right")
            met = np.flatnonzero(hi > lo)
            times = (hi - lo)[met]
            entry = np.repeat(lo[met] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pairs = np.unique(np.stack([np.repeat(met // self.samples, times), owner[entry]], 1), axis=0)
            if not len(pairs):
                continue
            w, item = pairs[:, 0], pairs[:, 1]
            e = int(self.edits[item[0]])
            at = start[w][:, None] + np.arange(-e, m + e)
            regions = np.where((at >= begin[w][:, None]) & (at < end[w][:, None]), words[np.clip(at, 0, len(words) - 1)], np.uint64(1))
            distance, stop = edit_distances(np.stack([self.words[i] for i in item]), regions)
            for k in np.flatnonzero(distance <= e).tolist():
                r = int(row[w[k]])
                last = int(start[w[k]] - e + stop[k] - first[r])
                found = (int(distance[k]), max(0, last - m), last)
                key = (r, int(item[k]))
                if key not in best or found < best[key]:
                    best[key] = found


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, distance, start, stop) of each document and item whose words come within share * words edits.

    start and stop are word positions in the document (stop is exact). Items without a word, and null ones, are not
    searched; null, empty and blank documents leak nothing; rows that repeat a doc_id or item_id are searched each and
    give one row together. Items come in blocks of about BLOCK_ITEMS items and BLOCK_BYTES bytes, so that an index of any
    benchmark fits a task; every block is searched in all documents. Other columns than doc_id, text and item_id are not
    read.
    """
    spark = docs.sparkSession
    known = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        got = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(ItemIndex.build([r.item_id for r in got], [r.text for r in got], share, recall))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "distance", "start", "stop"]
            for batch in batches:
                ids, done, rows = batch.column("doc_id").to_pylist(), 0, []
                for words, first in words_of(batch.column("text")):
                    if len(words) and len(index.value.ids):
                        rows += [(ids[done + r], int(index.value.ids[i]), d, a, b) for r, i, d, a, b in index.value.search(words, first)]
                    done += len(first) - 1
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(5)], names)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, item_id long, distance long, start long, stop long")
        out = part if out is None else out.union(part)
    best = F.min(F.struct("distance", "start", "stop")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
