"""Bounded samples of labelled documents, and the columns that the scoring queries return."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this score on a document is predicted to have label 1.
THRESHOLD = 0.7


def held_out(folds: int, fold: int) -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text, modulo folds, is fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, unseen: Column, rows: int, features: Callable[[pa.Array], Iterator[tuple]]) -> tuple[list, np.ndarray]:
    """(ids and counts of the features of each row, labels) of at most ``rows`` labelled rows, picked by a hash of doc_id.

    Features are made where the texts lie; the sample of labels is bounded by ``rows``, and so is what reaches the driver.
    Rows without a label, and labels other than 0 and 1, are passed over. A doc_id that repeats is one row, with the
    largest of its labels and the least of its texts, before anything leaves the executors.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~unseen).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for i, c in features(batch.column("text")):
                ids.append(i.astype(np.int32))
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "y", "ids", "counts"])

    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    some = some.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    got = some.mapInArrow(extract, "doc_id long, y int, ids array<int>, counts array<int>").toArrow()
    order = pc.sort_indices(got.column("doc_id")).to_numpy()[:rows]  # the table itself is not copied
    ids, counts = got.column("ids"), got.column("counts")
    return [(ids[k].values.to_numpy(), counts[k].values.to_numpy()) for k in order.tolist()], got.column("y").to_numpy()[order].astype(np.float64)


def score_rows(docs: DataFrame, scores: Callable[[pa.Array], np.ndarray], columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of docs and, as ``name``, the function's value for each text; a column of docs with that name is left out."""
    columns = [c for c in columns if c != name]
    places = [f"c{k}" for k in range(len(columns))]  # mapInArrow takes no names with dots

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(batch.column(len(places))), pa.float64())], [*places, "score"])

    own = [docs[f"`{c}`"].alias(k) for c, k in zip(columns, places, strict=True)]
    return docs.select(*own, docs["text"].alias("of")).mapInArrow(add, docs.select(*own).schema.add("score", "double")).toDF(*columns, name)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
