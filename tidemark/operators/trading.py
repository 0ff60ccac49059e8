"""Back-tests, signal fusion, position and portfolio risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..functions.windows import pct_change, running_product, series, sma


def _held(out: DataFrame, keys: list[str], cost_bps: float) -> DataFrame:
    """Rows (keys, date, close, signal, ret) with the position of the signal before, turnover, net return and equity."""
    w = series(*keys)
    out = out.withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0)))
    out = out.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))
    out = out.withColumn("net", F.col("position") * F.col("ret") - F.col("turnover") * cost_bps / 10_000)
    return out.select(*keys, "date", "close", "position", "turnover", "net", running_product(1 + F.col("net"), w).alias("equity"))


def _with_averages(bars: DataFrame, periods: list[int]) -> DataFrame:
    w = series("symbol")
    return bars.select("symbol", "date", "close", F.coalesce(pct_change("close", 1, w), F.lit(0.0)).alias("ret"), *[sma("close", n, w).alias(f"ma{n}") for n in periods])


def _above(fast: int, slow: int) -> Column:
    return F.coalesce((F.col(f"ma{fast}") > F.col(f"ma{slow}")).cast("int"), F.lit(0))


def ma_crossover(bars: DataFrame, fast: int = 5, slow: int = 20, cost_bps: float = 10.0) -> DataFrame:
    """Each bar of the long-or-flat crossover: position (yesterday's signal), turnover, net return and equity.

    A pure window plan. Equity is the running product of 1 + net: a net return of -1 ends it at 0, one below turns its sign.
    """
    return _held(_with_averages(bars, [fast, slow]).withColumn("signal", _above(fast, slow)), ["symbol"], cost_bps)


def backtest_metrics(daily: DataFrame, periods: int = 252, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per symbol: total return, Sharpe (sample deviation, a year), largest drawdown, win rate over all bars, number of trades."""
    w = series(*keys)
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = daily.withColumn("dd", F.col("equity") / peak - 1)
    sd = F.stddev_samp("net")
    return out.groupBy(*keys).agg((F.max_by("equity", "date") - 1).alias("total_return"), F.when(sd > 0, F.avg("net") / sd * math.sqrt(periods)).alias("sharpe"), F.min("dd").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"), F.sum("turnover").alias("trades"))


def parameter_grid(bars: DataFrame, fasts: list[int], slows: list[int], cost_bps: float = 10.0) -> DataFrame:
    """Mean metrics of the crossover for each pair fast < slow: one window plan gives all averages, then each bar meets the pairs, and symbol and pair are run side by side."""
    periods = sorted({*fasts, *slows})
    pairs = F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), _above(f, s).alias("signal")) for f in fasts for s in slows if f < s])
    each = _with_averages(bars, periods).select("symbol", "date", "close", "ret", F.explode(pairs).alias("x")).select("symbol", "date", "close", "ret", "x.*")
    keys = ("symbol", "fast", "slow")
    out = backtest_metrics(_held(each, list(keys), cost_bps), keys=keys)
    return out.groupBy("fast", "slow").agg(F.avg("sharpe").alias("sharpe"), F.avg("total_return").alias("total_return"))


def trade_runs(daily: DataFrame) -> DataFrame:
    """(symbol, entry, exit, bars, gain) of each run of held bars: gaps and islands over position."""
    w = series("symbol")
    out = daily.withColumn("_new", (F.col("position") != F.coalesce(F.lag("position").over(w), F.lit(0))).cast("int"))
    out = out.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("position = 1")
    return out.groupBy("symbol", "_run").agg(F.min("date").alias("entry"), F.max("date").alias("exit"), F.count("*").alias("bars"), F.sum("net").alias("gain")).drop("_run")


def longest_streaks(runs: DataFrame) -> DataFrame:
    """(symbol, wins, losses): the longest rows of winning and of other trades; no gain is a loss."""
    w = Window.partitionBy("symbol").orderBy("entry")
    out = runs.withColumn("win", (F.col("gain") > 0).cast("int"))
    out = out.withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy("symbol", "win").orderBy("entry")))
    rows = out.groupBy("symbol", "win", "_g").agg(F.count("*").alias("n"))
    return rows.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("win") == 1, F.col("n"))), F.lit(0)).alias("wins"), F.coalesce(F.max(F.when(F.col("win") == 0, F.col("n"))), F.lit(0)).alias("losses"))


def donchian_signals(bars: DataFrame, n: int = 20) -> DataFrame:
    """buy over the highest high of the n bars before, sell under their lowest low."""
    w = series("symbol").rowsBetween(-n, -1)
    enough = F.count("high").over(w) == n
    side = F.when(enough & (F.col("close") > F.max("high").over(w)), "buy").when(enough & (F.col("close") < F.min("low").over(w)), "sell").otherwise("hold")
    return bars.select("symbol", "date", side.alias("signal"))


def fuse(candidates: DataFrame, weights: dict[str, float], default: float = 0.1, agreement: float = 0.6, least: float = 0.2, strong: float = 0.65) -> DataFrame:
    """One signal per symbol of candidates (symbol, strategy, direction, score -1..1, confidence): the sum of score * confidence * weight over the sum of weights, 0 where that is not positive.

    In order: strong longs and shorts at once, or votes (long, short or neutral) that agree less than ``agreement``, give a
    neutral signal of score 0; a fused score under ``least`` is neutral; else its sign decides.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    rows = candidates.withColumn("_w", F.coalesce(F.try_element_at(table, F.col("strategy")), F.lit(default)))
    score, side = F.col("score"), F.col("direction")
    votes = [F.count(F.when(side == x, 1)) for x in ("long", "short", "neutral")]
    out = rows.groupBy("symbol").agg(
        F.sum("_w").alias("_sum"), F.sum(score * F.col("confidence") * F.col("_w")).alias("_acc"), F.count("*").alias("n"), F.greatest(*votes).alias("_same"),
        F.max(F.when(side == "long", score)).alias("_most"), F.min(F.when(side == "short", score)).alias("_least"),
    )
    out = out.withColumn("fused", F.when(F.col("_sum") > 0, F.try_divide("_acc", "_sum")).otherwise(0.0)).withColumn("agreement", F.col("_same") / F.col("n"))
    conflict = F.coalesce((F.col("_most") >= strong) & (F.col("_least") <= -strong), F.lit(False))
    rule = F.when(conflict, "conflict").when(F.col("agreement") < agreement, "low_agreement").when(F.abs("fused") < least, "weak").otherwise("fused")
    direction = F.when(rule != "fused", "neutral").when(F.col("fused") > 0, "long").otherwise("short")
    value = F.when(rule.isin("conflict", "low_agreement"), 0.0).otherwise(F.col("fused"))
    return out.select("symbol", "n", value.alias("score"), F.least(F.lit(1.0), F.abs("fused")).alias("confidence"), "agreement", rule.alias("rule"), direction.alias("direction"))


def contributions(candidates: DataFrame, weights: dict[str, float], default: float = 0.1) -> DataFrame:
    """(symbol, strategy, share): each strategy's part of the sum of abs(score) * confidence * weight; 0 where that sum is 0."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    part = F.abs("score") * F.col("confidence") * F.coalesce(F.try_element_at(table, F.col("strategy")), F.lit(default))
    rows = candidates.groupBy("symbol", "strategy").agg(F.sum(part).alias("_p"))
    total = F.sum("_p").over(Window.partitionBy("symbol"))
    return rows.select("symbol", "strategy", F.when(total > 0, F.try_divide(F.col("_p"), total)).otherwise(0.0).alias("share"))


def portfolio_risk(returns: DataFrame, weights: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: historical value at risk in percent, largest and current drawdown, number of days, of the weighted daily returns on dates that all weighted symbols have."""
    positive = weights.filter("weight > 0")
    total = positive.agg(F.sum("weight").alias("_t"), F.count("*").alias("_n"))
    held = returns.join(F.broadcast(positive), "symbol").join(F.broadcast(total), how="cross")
    daily = held.groupBy("date", "_n").agg(F.sum(F.col("r") * F.col("weight") / F.col("_t")).alias("p"), F.count("*").alias("k")).filter("k = _n")
    # The portfolio is one series; its running product needs one ordered partition of a row per day.
    w = Window.partitionBy("_n").orderBy("date")
    daily = daily.withColumn("nav", running_product(1 + F.col("p"), w))
    daily = daily.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    return daily.agg((-F.percentile("p", 1 - confidence) * 100).alias("var_pct"), F.min("dd").alias("max_drawdown"), F.max_by("dd", "date").alias("drawdown"), F.count("*").alias("days"))


def kelly(win_rate: Column, gain: Column, loss: Column) -> Column:
    """The Kelly share of capital, held within 0 and a quarter."""
    ratio = F.when(loss > 0, gain / loss)
    return clamp(F.when(ratio > 0, win_rate - (1 - win_rate) / ratio), 0.0, 0.25)


def position_size(strength: Column, confidence: Column, available: Column, price: Column) -> Column:
    """Whole lots of 100: a band of the available cash by strength, linear in confidence."""
    band = F.when(strength >= 0.8, 0.3).when(strength >= 0.6, 0.2).when(strength >= 0.4, 0.1).otherwise(0.0)
    return F.when(price > 0, F.floor(available * band * clamp(confidence, 0.0, 1.0) / price / 100) * 100).otherwise(0).cast("long")


def exit_reason(entry: Column, current: Column, peak: Column, long: Column, stop: float = 0.05, take: float = 0.05, trail: float = 0.03) -> Column:
    """stop_loss, take_profit, trailing or none, for the given side."""
    move = F.when(long, current / entry - 1).otherwise(1 - current / entry)
    fallen = F.when(long, current <= peak * (1 - trail)).otherwise(current >= peak * (1 + trail))
    return F.when(move <= -stop, "stop_loss").when(move >= take, "take_profit").when(fallen & (move > 0), "trailing").otherwise("none")


