"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, sqrt(M^2 - |x|^2) where M is the largest norm, all rows lie on a sphere, and the inner product
with an anchor q falls with the distance: d^2 = |q|^2 + M^2 - 2 q.x. A window of scores is an annulus around the anchor.
A tree fitted on a bounded sample deals all rows to regions; each region's distances from its vantage points, taken over
all its rows, tell which annuli can reach it. Regions are cut into blocks of a bounded number of rows, each with a tree
of its own. Leaves are visited nearest first within the annulus, until no further leaf can hold a better row. The trees
only leave out what distances rule out, so results are exact; scores themselves are integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stage, table

#: Rows that the tree of regions is fitted on at most; its rows to a region; rows of a block at most (by expectation); of a leaf.
SAMPLE, SHARE, BLOCK, LEAF = 4096, 64, 1 << 14, 128
#: Queries that a block answers at once.
TOGETHER = 256
#: Score windows without a lower or upper end.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones are padded with zeros."""
    ends = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < ends[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a and b, exact: in floats where their sums fit 53 bits, else in 64-bit integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest >= 2**63:
        raise ValueError("scores do not fit 64 bits")
    return a @ b.T


class VpTree:
    """A complete tree of 2^depth leaves; node i has the children 2i + 1 and 2i + 2.

    points: the vantage point of each inner node; beyond: the distance from which rows go right. least, most: by leaf and
    level, the distances of the leaf's rows from the vantage points on its way.
    """

    def __init__(self, rows: np.ndarray, square: float, leaf: int, seed: int = 5) -> None:
        self.square, self.depth = square, max(0, int(np.ceil(np.log2(max(1, len(rows)) / leaf))))
        rng, inner = np.random.default_rng(seed), (1 << self.depth) - 1
        self.points, self.beyond = np.zeros((inner, rows.shape[1])), np.full(inner, np.inf)
        parts = [np.arange(len(rows))]
        for i in range(inner):
            some = parts[i]
            tried = rows[rng.choice(some, min(4, len(some)), replace=False)].astype(np.float64)
            far = self._apart(rows[some].astype(np.float64), tried)
            best = int(np.argmax(far.var(0)))  # the vantage point that spreads the rows most
            self.points[i] = tried[best]
            order = np.argsort(far[:, best], kind="stable")
            half = len(some) // 2  # equal distances are split too: one vector may repeat without end
            self.beyond[i] = far[order[half], best]
            parts += [some[order[:half]], some[order[half:]]]
        self.leaves = parts[inner:]
        self.measure(rows, np.concatenate([np.zeros(0, np.int64), *[np.full(len(p), k) for k, p in enumerate(self.leaves)]])[np.argsort(np.concatenate(self.leaves))])

    def _apart(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances between augmented rows."""
        a, b = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", points, points)
        own = np.sqrt(np.maximum(self.square - a, 0))[:, None] * np.sqrt(np.maximum(self.square - b, 0))
        return np.sqrt(np.maximum(2 * self.square - 2 * (rows @ points.T + own), 0))

    def way(self) -> np.ndarray:
        """The inner nodes on the way to each leaf."""
        node, out = np.arange(1 << self.depth) + (1 << self.depth) - 1, []
        for _ in range(self.depth):
            node = (node - 1) // 2
            out.append(node)
        return np.array(out[::-1], np.int64).reshape(self.depth, 1 << self.depth).T

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances from the vantage points on its way) of rows."""
        far = self._apart(rows.astype(np.float64), self.points) if self.depth else np.zeros((len(rows), 0))
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (far[np.arange(len(rows)), node] >= self.beyond[node])
        leaf = node - (1 << self.depth) + 1
        return leaf, np.take_along_axis(far, self.way()[leaf], 1)

    def measure(self, rows: np.ndarray, leaf: np.ndarray) -> None:
        """Take least and most from rows that lie in the given leaves."""
        far = np.take_along_axis(self._apart(rows.astype(np.float64), self.points), self.way()[leaf], 1) if self.depth else np.zeros((len(rows), 0))
        self.least, self.most = np.full((1 << self.depth, self.depth), np.inf), np.full((1 << self.depth, self.depth), -np.inf)
        np.minimum.at(self.least, leaf, far)
        np.maximum.at(self.most, leaf, far)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) distance of each query to the rows of each leaf, with room for rounding."""
        q = queries.astype(np.float64)
        around = np.einsum("ij,ij->i", q, q) + self.square
        far = np.sqrt(np.maximum(around[:, None] - 2 * q @ self.points.T, 0))[:, self.way()]
        room = 1e-6 * np.sqrt(around)[:, None] + 1e-6
        low = np.maximum(far - self.most, self.least - far).max(2, initial=0)
        return low - room, (far + self.most).min(2, initial=np.inf) + room


def annulus(queries: np.ndarray, square: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances (near, far) between which scores from low to high lie."""
    q = queries.astype(np.float64)
    around = np.einsum("ij,ij->i", q, q) + square
    return np.sqrt(np.maximum(around - 2 * high.astype(np.float64), 0)), np.sqrt(np.maximum(around - 2 * low.astype(np.float64), 0))


def nearest(tree: VpTree, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the first k rows of each query within its window of scores, of its label or else of other labels.

    Leaves come nearest first within the annulus; a query ends when its next leaf lies beyond its k-th row so far. All
    queries go in step, those that visit the same leaf in one product.
    """
    near, far = annulus(queries, tree.square, low, high)
    least, most = tree.bounds(queries)
    least = np.where((least <= far[:, None]) & (most >= near[:, None]), np.maximum(least, near[:, None]), np.inf)
    order = np.argsort(least, axis=1, kind="stable")
    around = np.einsum("ij,ij->i", queries.astype(np.float64), queries.astype(np.float64)) + tree.square
    kth = np.full(len(queries), np.inf)
    best_q, best_id, best_s = (np.zeros(0, np.int64) for _ in range(3))
    for turn in range(order.shape[1]):
        leaf = order[:, turn]
        going = np.flatnonzero(least[np.arange(len(queries)), leaf] <= kth + 1e-6 * np.sqrt(around) + 1e-6)
        going = going[np.isfinite(least[going, leaf[going]])]
        if not len(going):
            break
        got = [(best_q, best_id, best_s)]
        for at in np.unique(leaf[going]):
            some, inside = going[leaf[going] == at], tree.leaves[at]
            score = products(queries[some], rows[inside])
            fits = (score >= low[some, None]) & (score <= high[some, None]) & (ids[inside] != own[some, None]) & ((labels[inside] == label[some, None]) == same)
            x, y = np.nonzero(fits)
            got.append((some[x], ids[inside][y], score[x, y]))
        q, i, s = (np.concatenate(x) for x in zip(*got, strict=True))
        first = np.lexsort((i, -s, q))
        q, i, s = q[first], i[first], s[first]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best_q, best_id, best_s = q[rank < k], i[rank < k], s[rank < k]
        last = rank == k - 1
        kth[q[last]] = np.sqrt(np.maximum(around[q[last]] - 2.0 * s[last], 0))
    return best_q, best_id, best_s


class Index:
    """All rows in blocks of regions. rows: block, region, id, label, vector; width: components; tree: of the regions, measured over all rows; blocks: by region."""

    def __init__(self, vectors: DataFrame) -> None:
        """vectors: id long, label int, vector array<long>, of all rows that take part."""
        self.width, square = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(F.expr("aggregate(vector, 0D, (s, x) -> s + cast(x AS double) * x)")), F.lit(0.0))).first()
        self.square = float(square)
        sample = vectors.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        self.tree = VpTree(matrix(sample.column("vector").combine_chunks(), self.width), self.square, SHARE)
        tree, width = self.tree, self.width

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, far = tree.place(matrix(batch.column("vector"), width))
                far = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, tree.depth) if tree.depth else np.zeros(len(far) + 1), pa.int32()), pa.array(far.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), far, *batch.columns], ["region", "far", *batch.schema.names])

        dealt = stage(vectors.mapInArrow(deal, "region int, far array<double>, id long, label int, vector array<long>"), "dealt")
        ends = [f(F.get("far", j)).alias(f"{name}{j}") for j in range(tree.depth) for name, f in (("a", F.min), ("b", F.max))]
        regions = dealt.groupBy("region").agg(F.count("*").alias("n"), *ends).collect()  # a row for each leaf of the sampled tree
        self.blocks = np.zeros(1 << tree.depth, np.int64)
        tree.least, tree.most = np.full((1 << tree.depth, tree.depth), np.inf), np.full((1 << tree.depth, tree.depth), -np.inf)
        for r in regions:
            self.blocks[r.region] = -(-r.n // BLOCK)
            for j in range(tree.depth):
                tree.least[r.region, j], tree.most[r.region, j] = r[f"a{j}"], r[f"b{j}"]
        tree.leaves = []  # the sample's places are not needed any more
        count = F.create_map(*[x for k, n in enumerate(self.blocks.tolist()) for x in (F.lit(k), F.lit(n))])
        block = F.concat_ws(":", F.col("region").cast("string"), F.pmod(F.xxhash64("id"), count[F.col("region")]).cast("string"))
        self.rows, self.made = dealt.select(block.alias("block"), "id", "label", "vector"), dealt

    def routed(self, queries: DataFrame, home: bool) -> DataFrame:
        """queries (qid, id, label, vector, low, high) for each block that their annulus can reach; home: of their own region only."""
        tree, width, blocks = self.tree, self.width, self.blocks

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(k, TOGETHER) for k in range(0, len(whole), TOGETHER)):
                    q = matrix(batch.column("vector"), width)
                    if home:
                        reached = np.zeros((len(q), len(blocks)), bool)
                        reached[np.arange(len(q)), tree.place(q)[0]] = True
                    else:
                        near, far = annulus(q, tree.square, batch.column("low").to_numpy(), batch.column("high").to_numpy())
                        least, most = tree.bounds(q)
                        reached = (least <= far[:, None]) & (most >= near[:, None])
                    row, region = np.nonzero(reached & (blocks > 0))
                    names = [[f"{r}:{j}" for j in range(blocks[r])] for r in region]
                    row = np.repeat(row, [len(x) for x in names])
                    yield pa.RecordBatch.from_arrays([pa.array([x for y in names for x in y], pa.string()), *batch.take(pa.array(row)).columns], ["block", *batch.schema.names])

        kind = "block string, qid long, id long, label int, vector array<long>, low long, high long"
        return queries.select("qid", "id", "label", "vector", "low", "high").mapInArrow(route, kind)

    def first(self, queries: DataFrame, same: bool, k: int, home: bool = False) -> DataFrame:
        """(qid, id, score, rank) of the first k rows, by score and id, of each query in its window.

        Rows and queries of a block meet in one partition, rows first: a task holds a block and streams the queries by it.
        """
        square, width = self.square, self.width
        rows = self.rows.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("qid"), "id", "label", "vector", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
        asked = self.routed(queries, home).select("block", F.lit(1).alias("kind"), "qid", "id", "label", "vector", "low", "high")
        both = rows.union(asked).repartition("block").sortWithinPartitions("block", "kind", "id")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            now, tree, data = None, None, ()
            for batch in batches:
                block, kind = batch.column("block").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy()
                cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
                for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                    some = batch.slice(a, b - a)
                    if not len(some):
                        continue
                    if block[a] != now:
                        now, held, tree = block[a], [], None
                    ids, labels = some.column("id").to_numpy(), some.column("label").to_numpy()
                    vectors = matrix(some.column("vector"), width)
                    if kind[a] == 0:
                        held.append((vectors, ids, labels))
                        continue
                    if tree is None:
                        data = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                        held, tree = [], VpTree(data[0], square, LEAF)
                    for j in range(0, len(some), TOGETHER):
                        s = slice(j, j + TOGETHER)
                        low, high = some.column("low").to_numpy()[s], some.column("high").to_numpy()[s]
                        q, i, score = nearest(tree, *data, vectors[s], ids[s], labels[s], low, high, same, k)
                        yield pa.RecordBatch.from_arrays([pa.array(some.column("qid").to_numpy()[s][q]), pa.array(i), pa.array(score)], ["qid", "id", "score"])

        found = both.mapInArrow(answer, "qid long, id long, score long")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def vectors_of(rows: DataFrame, id: str, vector: str, label: str, scale: float) -> DataFrame:
    """(id, label, vector of floor(scale * x)) of the rows that take part: those without a null or non-finite value."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), x.alias("x"))
    some = some.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    return some.select("id", "label", F.transform("x", lambda v: F.floor(v * F.lit(scale)).cast("long")).alias("vector"))


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (id, label, vector of integers).

    anchors: which rows ask. A score is the inner product with the anchor; higher scores come first, equal ones by id. An
    anchor's positives are its first rows of the same label; a positive's negatives are the first rows of other labels that
    score no more than it and no less than ``percent`` hundredths of it. Rows that are equal in all count once; rows that
    share an id but differ are anchors each, and no partners of one another. Vectors shorter than the longest count as
    padded with zeros. Anchors without positives, positives without negatives and an empty table give no rows. Scores must
    fit 64 bits, else an error is raised.
    """
    vectors = vectors.distinct()
    index = Index(vectors)
    asking = stage(vectors.filter(anchors).select(F.monotonically_increasing_id().alias("qid"), "id", "label", "vector", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")), "anchors")
    # The anchor's own region gives a first bound; what lies beyond it cannot be among the positives.
    home = index.first(asking, True, positives, home=True).filter(F.col("rank") == positives).select("qid", F.col("score").alias("bound"))
    bound = asking.join(home, "qid", "left").withColumn("low", F.coalesce("bound", "low"))
    found = stage(index.first(bound, True, positives).join(asking.select("qid", F.col("id").alias("anchor_id"), "label", "vector"), "qid"), "positives")
    least = F.ceil(F.col("score").cast("decimal(38,0)") * percent / 100).cast("long")
    windows = found.select((F.col("qid") * positives + F.col("rank") - 1).alias("qid"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "label", "vector")
    asked = windows.select("qid", F.col("anchor_id").alias("id"), "label", "vector", F.col("positive_score").alias("score")).withColumn("low", least).withColumn("high", F.col("score"))
    mined = index.first(asked.filter("low <= high"), False, negatives)
    out = mined.select("qid", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(windows.drop("label", "vector"), "qid")
    out = stage(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for made in (index.made, asking, found):
        discard(made)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 256.0)
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP12_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
