"""Evaluation of signals and predictions: hit rates, costs, calibration, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, safe_ratio


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key, by ``at`` and then ``tie``."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_x"))
    return out.select(*keys, *[F.col("_x")[c].alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's non-null values over it, and new's further rows."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c) for c in rest]).select(*old.columns)


def performance(signals: DataFrame, by: list[str], commission: float = 0.0003, slippage: float = 0.001) -> DataFrame:
    """Closed and open counts, win rate, gross and net mean (each closed signal costs 2 commissions and a slippage), best and worst."""
    closed = F.col("status") == "closed"
    net = F.col("pnl_pct") - (2 * commission + slippage) * 100
    return signals.groupBy(*by).agg(
        F.count("*").alias("total"), F.sum(closed.cast("long")).alias("closed"), F.avg(F.when(closed, (F.col("pnl_pct") > 0).cast("int"))).alias("win_rate"),
        F.avg(F.when(closed, F.col("pnl_pct"))).alias("gross_avg"), F.avg(F.when(closed, net)).alias("net_avg"), F.max(F.when(closed, F.col("pnl_pct"))).alias("best"), F.min(F.when(closed, F.col("pnl_pct"))).alias("worst"),
    )


def strategy_score(perf: DataFrame) -> DataFrame:
    """score 0..100: 40 * win rate + 40 * clamped net mean + 20 * (1 - drawdown_proxy); 50 under ten closed signals."""
    proxy = F.abs(F.least(F.lit(0.0), F.col("net_avg") * 0.5))
    score = 40 * F.col("win_rate") + 40 * clamp((F.col("net_avg") + 5) / 10, 0, 1) + 20 * (1 - clamp(proxy / 10, 0, 1))
    return perf.withColumn("drawdown_proxy", proxy).withColumn("score", F.when(F.col("closed") < 10, 50.0).otherwise(score))


def adjusted_weights(scores: DataFrame, step: float = 0.1) -> DataFrame:
    """weight moved towards its share of all scores by ``step`` at most, held within .1 and .6, and made to sum to 1."""
    w = Window.partitionBy(F.lit(0))
    target = F.col("score") / F.sum("score").over(w)
    out = scores.withColumn("_w", clamp(F.col("weight") + clamp(target - F.col("weight"), -step, step), 0.1, 0.6))
    return out.withColumn("new_weight", F.col("_w") / F.sum("_w").over(w)).drop("_w")


def range_verification(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """predictions (symbol, date, lower, upper) with hit (the bar lies within) and coverage (the share of the bar's range that the prediction covers)."""
    out = predictions.join(actual.select("symbol", "date", "high", "low"), ["symbol", "date"], "left")
    hit = (F.col("high") <= F.col("upper")) & (F.col("low") >= F.col("lower"))
    overlap = F.greatest(F.lit(0.0), F.least("high", "upper") - F.greatest("low", "lower"))
    width = F.col("high") - F.col("low")
    return out.withColumn("hit", hit).withColumn("coverage", F.when(width > 0, overlap / width).when(hit.isNotNull(), hit.cast("double")))


def direction_verification(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """predictions (symbol, base, target, direction) with the move of close between both dates and whether its sign is the direction's."""
    a = bars.select("symbol", F.col("date").alias("base"), F.col("close").alias("c0"))
    b = bars.select("symbol", F.col("date").alias("target"), F.col("close").alias("c1"))
    out = predictions.join(a, ["symbol", "base"], "left").join(b, ["symbol", "target"], "left")
    move = safe_ratio(F.col("c1") - F.col("c0"), F.col("c0"))
    return out.withColumn("move", move).withColumn("correct", F.sign(move) == F.when(F.col("direction") == "up", 1.0).when(F.col("direction") == "down", -1.0).otherwise(0.0))


def brier(p: Column, outcome: Column, neutral: float = 0.5) -> Column:
    """(p - target)^2; the target is 1 for up, 0 for down and ``neutral`` otherwise."""
    return F.pow(p - F.when(outcome == "up", 1.0).when(outcome == "down", 0.0).otherwise(neutral), 2)


def calibration_error(rows: DataFrame, by: list[str], bins: int = 5, corrected: bool = True) -> DataFrame:
    """(by, ece) of rows (p, y): |mean p - mean y| weighted by the share of rows, over ``bins`` bins of p.

    Not ``corrected``, the last bin has no lower bound and so holds every row, as in the rule that this follows.
    """
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    if corrected:
        binned = rows.select(*by, "p", "y", at.alias("bin"))
    else:
        binned = rows.select(*by, "p", "y", F.explode(F.array_distinct(F.array(at, F.lit(bins - 1)))).alias("bin"))
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    out = binned.groupBy(*by, "bin").agg(F.count("*").alias("k"), F.avg("p").alias("mp"), F.avg("y").alias("my")).join(n, by)
    return out.groupBy(*by).agg(F.sum(F.abs(F.col("mp") - F.col("my")) * F.col("k") / F.col("_n")).alias("ece"))


def weighted_quantile(rows: DataFrame, by: list[str], x: str, weight: str, q: float) -> DataFrame:
    """(by, value): the first x, in order, at which the running weight reaches q of all."""
    w = Window.partitionBy(*by)
    rows = rows.groupBy(*by, x).agg(F.sum(weight).alias(weight))
    out = rows.withColumn("_run", F.sum(weight).over(w.orderBy(x).rangeBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(w))
    return out.filter(F.col("_run") >= q * F.col("_all") - 1e-12).groupBy(*by).agg(F.min(x).alias("value"))


def outlier_fusion(rows: DataFrame, by: list[str], weight: str | None = None, most: float = 2.0) -> DataFrame:
    """(by, lower, upper, kept): of the ranges whose midpoint is within ``most`` sample deviations, the weighted 20 % quantile of the lower bounds and the 80 % one of the upper, swapped if they cross.

    Under three rows, without spread, or where none would be left, all stay. Negative weights count 0, missing ones 1; if all are 0 the means are taken.
    """
    w = Window.partitionBy(*by)
    weighed = F.coalesce(F.greatest(F.col(weight), F.lit(0.0)), F.lit(1.0)) if weight else F.lit(1.0)
    out = rows.select(*by, "lower", "upper", ((F.col("lower") + F.col("upper")) / 2).alias("_m"), weighed.alias("_w"))
    out = out.withColumns({"_mean": F.avg("_m").over(w), "_dev": F.stddev_samp("_m").over(w), "_n": F.count("*").over(w)})
    out = out.withColumn("_near", (F.col("_n") < 3) | F.coalesce(F.col("_dev") <= 1e-12, F.lit(True)) | (F.abs(F.col("_m") - F.col("_mean")) <= most * F.col("_dev")))
    out = out.withColumn("_some", F.max("_near").over(w)).filter(F.col("_near") | ~F.col("_some"))
    so_far = lambda c: F.sum("_w").over(w.orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"_low": so_far("lower"), "_high": so_far("upper"), "_all": F.sum("_w").over(w)})
    reached = lambda c, run, q: F.when(F.max("_all") > 0, F.min(F.when(F.col(run) >= q * F.col("_all"), F.col(c)))).otherwise(F.avg(c))
    out = out.groupBy(*by).agg(reached("lower", "_low", 0.2).alias("_a"), reached("upper", "_high", 0.8).alias("_b"), F.count("*").alias("kept"))
    return out.select(*by, F.least("_a", "_b").alias("lower"), F.greatest("_a", "_b").alias("upper"), "kept")


def tercile_spread(rows: DataFrame, by: list[str], score: str, outcome: str, tie: str) -> DataFrame:
    """(by, top, bottom, spread): mean outcome of the best and worst max(1, n // 3) rows by score.

    Scores that lie within a third as a whole are summed; only the rows of a score that a third cuts through are ranked.
    """
    w = Window.partitionBy(*by)
    sums = [F.count("*").alias("_k"), F.count(outcome).alias("_c"), F.sum(outcome).alias("_s")]
    each = rows.groupBy(*by, score).agg(*sums)
    each = each.withColumns({"_upto": F.sum("_k").over(w.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_k").over(w)})
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    # Of each score the first _t rows are in the top third, and the last _b in the bottom one.
    each = each.withColumns({"_t": F.least("_k", F.greatest(F.lit(0), size - (F.col("_upto") - F.col("_k")))), "_b": F.least("_k", F.greatest(F.lit(0), size - (F.col("_n") - F.col("_upto"))))})
    cut = F.col("_t").between(F.lit(1), F.col("_k") - 1) | F.col("_b").between(F.lit(1), F.col("_k") - 1)
    whole = each.filter(~cut).select(*by, "_c", "_s", (F.col("_t") > 0).alias("_top"), (F.col("_b") > 0).alias("_bottom"))
    some = each.filter(cut).select(*[F.col(c).alias(f"_k_{c}") for c in [*by, score]], "_k", "_t", "_b")
    same = F.lit(True)
    for c in [*by, score]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    some = rows.join(F.broadcast(some), same).withColumn("_r", F.row_number().over(Window.partitionBy(*by, score).orderBy(tie)))
    some = some.select(*by, F.when(F.col(outcome).isNull(), 0).otherwise(1).cast("long"), outcome, F.col("_r") <= F.col("_t"), F.col("_r") > F.col("_k") - F.col("_b"))
    mean = lambda part: F.try_divide(F.sum(F.when(F.col(part), F.col("_s"))), F.sum(F.when(F.col(part), F.col("_c"))))
    out = whole.union(some).groupBy(*by).agg(mean("_top").alias("top"), mean("_bottom").alias("bottom"))
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def concentration(rows: DataFrame, by: list[str], weight: str) -> DataFrame:
    """(by, hhi): the sum of squared shares of positive weights."""
    w = Window.partitionBy(*by)
    positive = rows.filter(F.col(weight) > 0)
    return positive.withColumn("_s", F.col(weight) / F.sum(weight).over(w)).groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"))


def fold_status(rows: DataFrame, by: list[str], status: str) -> DataFrame:
    """(by, status): the worst of ok, degraded, error; what is neither counts as degraded."""
    level = F.when(F.col(status) == "ok", 0).when(F.col(status) == "error", 2).otherwise(1)
    return rows.groupBy(*by).agg(F.get(F.array(F.lit("ok"), F.lit("degraded"), F.lit("error")), F.max(level)).alias("status"))


def prediction_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, hit_rate, brier, degraded_share, concentration) of predictions (by, symbol, hit, p, degraded): concentration is the sum of the squared shares of symbols; a missing hit is in neither rate."""
    hit = F.col("hit").cast("int")
    each = rows.groupBy(*by, "symbol").agg(F.count("*").alias("n"), F.count(hit).alias("k"), F.sum(hit).alias("h"), F.sum(F.when(hit.isNotNull(), (F.col("p") - hit) ** 2)).alias("b"), F.sum(F.col("degraded").cast("int")).alias("d"))
    n = F.sum("n")
    known = F.when(F.sum("k") > 0, F.sum("k"))
    return each.groupBy(*by).agg(n.alias("n"), (F.sum("h") / known).alias("hit_rate"), (F.sum("b") / known).alias("brier"), (F.sum("d") / n).alias("degraded_share"), (F.sum(F.col("n") * F.col("n")) / (n * n)).alias("concentration"))
