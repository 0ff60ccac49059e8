"""Rotation scoring: base metrics, correlation, stability, pool-normalised ranks, greedy correlation filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..functions.windows import drawdown, full, pct_change, rank_share, series, sma

#: Weights of the pool-normalised score.
WEIGHTS = {"m20": 0.25, "m60": 0.2, "m5": 0.05, "vol20": 0.1, "mdd60": 0.1, "r2": 0.1, "win20": 0.05, "mean_corr": 0.1, "crowding": 0.05}
#: Metrics whose rank runs from the smallest; the others run from the largest, which so gets 0 (as in the rule that this follows).
ASCENDING = {"vol20", "mean_corr", "crowding"}


def base_metrics(bars: DataFrame, periods: int = 252) -> DataFrame:
    """Per symbol at its last bar: m5, m20, m60, vol20 (population), crowding (share of its last 60 vol20 not above it), mdd60, win20, r2 of log price on time (60 bars), and above_ma (close over its 20-bar mean)."""
    w = series("symbol")
    out = bars.select("symbol", "date", "close", F.row_number().over(w).alias("i"), *[pct_change("close", k, w).alias(f"m{k}") for k in (5, 20, 60)], pct_change("close", 1, w).alias("ret"), sma("close", 20, w).alias("ma20"))
    out = out.withColumn("vol20", full(F.stddev_pop("ret"), 20, w, F.col("ret")) * math.sqrt(periods))
    recent = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    out = out.withColumn("age", F.row_number().over(recent)).filter("age <= 60")
    out = out.withColumn("dd", drawdown("close", w))
    last = F.col("age") == 1
    now = out.filter(last).select("symbol", "date", "close", "m5", "m20", "m60", "vol20", (F.col("close") > F.col("ma20")).alias("above_ma"), F.col("vol20").alias("_v"))
    log = F.log(F.greatest(F.col("close"), F.lit(1e-12)))
    past = out.join(now.select("symbol", "_v"), "symbol").groupBy("symbol").agg(
        F.avg(F.when(F.col("vol20").isNotNull(), (F.col("vol20") <= F.col("_v")).cast("int"))).alias("crowding"), F.min("dd").alias("mdd60"),
        F.avg(F.when((F.col("age") <= 20) & F.col("ret").isNotNull(), (F.col("ret") > 0).cast("int"))).alias("win20"),
        clamp(F.coalesce(F.regr_r2(log, F.col("i").cast("double")), F.lit(0.0)), 0, 1).alias("r2"),
    )
    return now.drop("_v").join(past, "symbol")


def log_returns(bars: DataFrame, n: int = 60) -> DataFrame:
    """(symbol, date, r): log returns on the last n dates that every symbol has."""
    symbols = bars.agg(F.count_distinct("symbol").alias("_all"))
    common = bars.groupBy("date").agg(F.count_distinct("symbol").alias("_n")).join(F.broadcast(symbols), F.col("_n") == F.col("_all")).select("date").orderBy(F.col("date").desc()).limit(n + 1)
    w = series("symbol")
    out = bars.join(F.broadcast(common), "date").select("symbol", "date", F.log(F.col("close") / F.lag("close").over(w)).alias("r"))
    return out.filter("r IS NOT NULL")


def correlations(returns: DataFrame) -> DataFrame:
    """(a, b, corr) of each ordered pair of different symbols: pairs meet on the date, so the work is dates times symbols squared, the size of the matrix."""
    x, y = returns.select("date", F.col("symbol").alias("a"), F.col("r").alias("x")), returns.select("date", F.col("symbol").alias("b"), F.col("r").alias("y"))
    return x.join(y, "date").filter("a <> b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


def mean_abs_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("a").alias("symbol")).agg(F.avg(F.abs("corr")).alias("mean_corr"))


def stability(runs: DataFrame, last: int = 6) -> DataFrame:
    """(symbol, stability) from ranked lists (run, ranked: array of symbols): 1 / (deviation of its ranks + .01), scaled to 0..1 over symbols.

    A run that lacks a symbol counts as rank N + 5; where all are equal, or there are no runs, each has 0.5.
    """
    recent = runs.orderBy(F.col("run").desc()).limit(last)
    ranks = recent.select("run", F.posexplode("ranked").alias("rank", "symbol"))
    names = ranks.select("symbol").distinct()
    n = names.agg(F.count("*").alias("_n"))
    grid = names.join(F.broadcast(recent.select("run")), how="cross").join(F.broadcast(n), how="cross")
    out = grid.join(ranks, ["run", "symbol"], "left").select("symbol", F.coalesce(F.col("rank") + 1, F.col("_n") + 5).alias("rank"))
    out = out.groupBy("symbol").agg((1 / (F.stddev_pop("rank") + 0.01)).alias("raw"))
    ends = out.agg(F.min("raw").alias("_low"), F.max("raw").alias("_high"))
    out = out.join(F.broadcast(ends), how="cross")
    return out.select("symbol", F.when(F.col("_high") > F.col("_low"), (F.col("raw") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.5).alias("stability"))


def pool_ranks(metrics: DataFrame, pool: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """metrics with score (weighted ranks within the pool) and rank; ties keep the order of symbol."""
    n = F.count("*").over(Window.partitionBy(pool))
    out = metrics
    for name in weights:
        order = F.col(name).asc_nulls_last() if name in ASCENDING else F.col(name).desc_nulls_last()
        out = out.withColumn(f"_{name}", rank_share(name, Window.partitionBy(pool).orderBy(order, "symbol"), n))
    score = sum((F.col(f"_{k}") * v for k, v in weights.items()), F.lit(0.0))
    out = out.withColumn("score", score).drop(*[f"_{k}" for k in weights])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(pool).orderBy(F.col("score").desc(), "symbol")))


def penalties(metrics: DataFrame, vol_cap: Column, least_r2: float = 0.1) -> DataFrame:
    """excluded and reason (a later rule overrides), and the product of soft penalties."""
    reason = F.when(F.col("r2") < least_r2, "no_trend")
    reason = F.when(F.col("vol20") > vol_cap, "high_volatility").otherwise(reason)
    reason = F.when(F.col("m60").isNull(), "short_history").otherwise(reason)
    soft = F.when(~F.col("above_ma"), 0.8).otherwise(1.0) * F.when(F.col("mdd60") < -0.3, 0.9).otherwise(1.0) * F.when(F.col("crowding") > 0.9, 0.95).otherwise(1.0)
    return metrics.withColumns({"excluded": reason.isNotNull(), "reason": F.coalesce(reason, F.lit("")), "penalty": soft})


def greedy_filter(ranked: DataFrame, pairs: DataFrame, most: float = 0.7) -> DataFrame:
    """The symbols kept when each, by falling score, is kept if its correlation with all kept before stays under ``most`` in size.

    A fold over the pool's ranked symbols: one row per pool, of a pool's size.
    """
    near = pairs.filter(F.abs("corr") >= most).groupBy(F.col("a").alias("symbol")).agg(F.collect_set("b").alias("_near"))
    rows = ranked.join(near, "symbol", "left").select("pool", F.struct(F.col("rank"), F.col("symbol"), F.coalesce("_near", F.array().cast("array<string>")).alias("near")).alias("x"))
    lists = rows.groupBy("pool").agg(F.sort_array(F.collect_list("x")).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<string>"), lambda s, x: F.when(F.arrays_overlap(s, x["near"]), s).otherwise(F.concat(s, F.array(x["symbol"]))))
    return lists.select("pool", F.posexplode(kept).alias("pos", "symbol")).select("pool", "symbol", (F.col("pos") + 1).alias("kept_rank"))
