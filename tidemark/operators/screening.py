"""Screening, regimes and lookups: factor scores, market regime, nearest neighbours, caps, alerts in batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import compare
from ..functions.windows import full, pct_change, rank_share, series, sma

#: Rows of a block of query vectors, and of one of the points that they are held against.
QUERY_BLOCK, POINT_BLOCK = 1024, 4096


def four_factors(metrics: DataFrame, weights: dict[str, float], corrected: bool = False) -> DataFrame:
    """score 0..100 of momentum, volatility, liquidity and valuation ranks; a factor without any difference gives 0.5 to all.

    As in the rule that this follows the largest value ranks 0; ``corrected`` turns that round for factors where more is better.
    """
    w = Window.partitionBy(F.lit(0))
    n = F.count("*").over(w)
    out = metrics
    for name in weights:
        better = name in ("momentum", "liquidity")
        down = better != corrected
        order = F.col(name).desc() if down else F.col(name).asc()
        share = rank_share(name, w.orderBy(order, "symbol"), n)
        out = out.withColumn(f"_{name}", F.when(F.min(name).over(w) == F.max(name).over(w), 0.5).otherwise(share))
    score = sum((F.col(f"_{k}") * v for k, v in weights.items()), F.lit(0.0)) * 100
    return out.withColumn("score", score).drop(*[f"_{k}" for k in weights]).withColumn("rank", F.row_number().over(w.orderBy(F.round("score", 10).desc(), "symbol")))


def market_regime(bars: DataFrame, periods: int = 252) -> DataFrame:
    """Per symbol with 70 bars or more: high_vol_risk, bull, bear or range, with its confidence, at the last bar."""
    w = series("symbol")
    out = bars.select("symbol", "date", "close", pct_change("close", 1, w).alias("ret"), pct_change("close", 20, w).alias("m20"), pct_change("close", 60, w).alias("m60"), F.row_number().over(w).alias("i"))
    out = out.withColumn("vol", full(F.stddev_samp("ret"), 20, w, F.col("ret")) * math.sqrt(periods))
    out = out.withColumn("peak", F.max("close").over(w.rowsBetween(-59, 0))).withColumn("mdd", F.col("close") / F.col("peak") - 1)
    last = out.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).filter("_n = 1 AND i >= 70")
    high, up, down = (F.col("vol") >= 0.30) & (F.col("mdd") <= -0.08), (F.col("m20") >= 0.02) & (F.col("m60") >= 0.04), (F.col("m20") <= -0.02) & (F.col("m60") <= -0.04)
    regime = F.when(high, "high_vol_risk").when(up, "bull").when(down, "bear").otherwise("range")
    return last.select("symbol", "date", "vol", "mdd", "m20", "m60", regime.alias("regime"), F.when(high, 0.75).when(up | down, 0.70).otherwise(0.55).alias("confidence"))


def down_streak(bars: DataFrame) -> DataFrame:
    """Per symbol: falling closes in a row up to its last bar."""
    w = series("symbol")
    out = bars.select("symbol", "date", (F.col("close") < F.lag("close").over(w)).alias("down"), F.row_number().over(w).alias("i"))
    return out.groupBy("symbol").agg((F.max("i") - F.coalesce(F.max(F.when(~F.coalesce("down", F.lit(False)), F.col("i"))), F.lit(0))).alias("streak"))


def tail_features(bars: DataFrame) -> DataFrame:
    """Per symbol at its last bar: distance from the 5-bar mean, volume over the mean of the 5 bars before, 5-bar return."""
    w = series("symbol")
    before = full(F.avg("volume"), 5, w, F.col("volume"), skip=1)
    out = bars.select("symbol", "date", (F.col("close") / sma("close", 5, w) - 1).alias("ma5_distance"), F.when(before > 0, F.col("volume") / before).alias("volume_ratio"), pct_change("close", 5, w).alias("ret_5"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc())).alias("_n"))
    return out.filter("_n = 1").drop("_n")


def capped_top(rows: DataFrame, score: str, kind: str, key: str, k: int, cap: int) -> DataFrame:
    """The best k rows of which at most ``cap`` share a kind.

    The walk by score takes a row while its kind has room, so a row's fate hangs only on its place within its kind: two rankings.
    """
    w = Window.partitionBy(kind).orderBy(F.col(score).desc(), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r").orderBy(F.col(score).desc(), key).limit(k)


def nearest_neighbours(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, distance, place): for each query vector the k nearest other points by cosine distance, then by id.

    Both sides are dealt by their ids into blocks of about QUERY_BLOCK and POINT_BLOCK rows; every block of queries meets
    every block of points and keeps k rows per query. Distances are summed in the order of the dimensions, so equal
    vectors tie exactly. Null vectors and those of length 0 have no direction and are left out.
    """
    n_p, n_q = -(-points.count() // POINT_BLOCK) or 1, -(-queries.count() // QUERY_BLOCK) or 1
    p = points.filter("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n_p)).alias("_p"))
    q = queries.filter("query IS NOT NULL AND q IS NOT NULL").select(F.col("query").cast("long").alias("id"), F.col("q").cast("array<double>").alias("v"), F.pmod(F.xxhash64("query"), F.lit(n_q)).alias("_q"))
    p = p.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<long>")))
    q = q.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1)).cast("array<long>")))

    def vectors(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
        norm = np.zeros(len(v))
        for d in range(v.shape[1]):
            norm += v[:, d] * v[:, d]
        norm = np.sqrt(norm)
        return block.column("id").to_numpy()[norm > 0], v[norm > 0], norm[norm > 0]

    def nearest(points: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if points.num_rows and queries.num_rows:
            (ids, v, norm), (asks, q, q_norm) = vectors(points), vectors(queries)
            for at in range(0, len(asks) if len(ids) else 0, 64):
                ask, x, x_norm = asks[at : at + 64], q[at : at + 64], q_norm[at : at + 64]
                rough = 1 - (x / x_norm[:, None]) @ (v / norm[:, None]).T
                rough[ask[:, None] == ids] = np.inf
                least = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                # The matrix product rounds by block; what may be among the k is measured again in a fixed order.
                i, j = np.nonzero(np.isfinite(rough) & (rough <= least[:, None] + 1e-9))
                dot = np.zeros(len(i))
                for d in range(v.shape[1]):
                    dot += v[j, d] * x[i, d]
                exact = 1 - dot / (norm[j] * x_norm[i])
                order = np.lexsort((ids[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                parts.append((ask[i[place < k]], ids[j[place < k]], exact[place < k]))
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], ["query", "id", "distance"])

    near = p.groupBy("_p", "_q").cogroup(q.groupBy("_p", "_q")).applyInArrow(nearest, "query long, id long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def rule_matches(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with the enabled rules of their symbol whose comparison, given as data, holds. Rules are broadcast; their number is the caller's to bound."""
    return events.join(F.broadcast(rules.filter("enabled")), "symbol").filter(compare(F.col("value"), F.col("operator"), F.col("target")))


def cooled(matches: DataFrame, keys: list[str], at: str, seconds: int, dedup: bool = False) -> DataFrame:
    """matches with status: triggered, or cooldown_skipped less than ``seconds`` after the last triggered one of the keys.

    With ``dedup`` a match in the same minute as the one before it is dedup_skipped, and counts for nothing else. Whether
    a match counts hangs on the ones before, but the first one after a gap of ``seconds`` (and, with ``dedup``, a minute)
    always does: each stretch between such gaps is sorted and streamed, with the last match and firing as all its state.
    The gaps are found between slots of that width, as none fits within one. A match without a time is skipped.
    """
    width = max(int(seconds), 60 if dedup else 1) * 1_000_000
    rows = matches.select(*keys, "event_id", F.unix_micros(F.col(at).cast("timestamp")).alias("_at")).withColumn("_slot", F.floor(F.col("_at") / F.lit(width)))
    w = Window.partitionBy(*keys).orderBy("_slot")
    slots = rows.filter("_at IS NOT NULL").groupBy(*keys, "_slot").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    slots = slots.withColumn("_gap", F.coalesce(F.col("_first") - F.lag("_last").over(w) >= width, F.lit(True)).cast("long"))
    slots = slots.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slot").alias("_k_slot"), F.sum("_gap").over(w).alias("_stretch"))
    same = F.col("_slot") == F.col("_k_slot")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = rows.join(slots, same, "left").select(*keys, "event_id", "_at", "_stretch")
    known = rows.filter("_at IS NOT NULL").repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_at", "event_id")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, last, minute = None, 0, None
        for batch in batches:
            said = []
            for *key, now in zip(*(batch.column(c).to_pylist() for c in [*keys, "_stretch", "_at"]), strict=True):
                if key != was:
                    was, last, minute = key, None, None
                if dedup and now // 60_000_000 == minute:
                    said.append("dedup_skipped")
                    continue
                fires = last is None or now - last >= seconds * 1_000_000
                last, minute = now if fires else last, now // 60_000_000
                said.append("triggered" if fires else "cooldown_skipped")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, "event_id"]), pa.array(said, pa.string())], [*keys, "event_id", "status"])

    out = known.mapInArrow(stream, known.select(*keys, "event_id").schema.add("status", "string"))
    return out.union(rows.filter("_at IS NULL").select(*keys, "event_id", F.lit("cooldown_skipped")))


def clamp_range(price: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """(lower, upper) such that lower <= price <= upper."""
    return F.least(lower, price), F.greatest(upper, price)


def hard_gate(name: Column, listed_days: Column, amount: Column, pct: Column, days: int = 60, least: float = 5e7, limit: float = 9.5) -> Column:
    """Neither special treatment, nor newly listed, nor thinly traded, nor near its price limit."""
    return ~name.rlike(r"^\*?ST") & (listed_days >= days) & (amount >= least) & (F.abs(pct) < limit)


def unit_of(value: Column, low: Column, high: Column) -> Column:
    """price, index_point or ratio by where a predicted value lies; null where it fits nowhere."""
    return F.when((value >= low) & (value <= high), "price").when((value > 1000) & (value / 1000 >= low) & (value / 1000 <= high), "index_point").when(F.abs(value) < 0.1, "ratio")


