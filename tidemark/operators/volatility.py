"""Realised volatility, cones, ranges and option prices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, normal_cdf, normal_pdf
from ..functions.windows import full, pct_change, series, sma
from .indicators import true_range

YEAR = 252


def historical_volatility(bars: DataFrame, windows: list[int], periods: int = YEAR) -> DataFrame:
    """hv<w>: sample deviation of the last w returns, a year, in percent, at most 500; null until there are w returns."""
    w = series("symbol")
    out = bars.select("symbol", "date", "close", pct_change("close", 1, w).alias("ret"))
    return out.select("symbol", "date", *[clamp(full(F.stddev_samp("ret"), n, w, F.col("ret")) * math.sqrt(periods) * 100, 0, 500).alias(f"hv{n}") for n in windows])


def volatility_cone(bars: DataFrame, windows: list[int], least: int = 60, periods: int = YEAR) -> DataFrame:
    """(symbol, window, current, low, high, mean, percentile): the last value against its own history; the percentile counts past values only.

    Windows with fewer than ``least`` values have null statistics.
    """
    hv = historical_volatility(bars, windows, periods)
    long = hv.select("symbol", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"hv{n}").alias("hv")) for n in windows])).alias("x")).select("symbol", "date", "x.*").filter("hv IS NOT NULL")
    last = long.groupBy("symbol", "window").agg(F.max_by("hv", "date").alias("current"), F.max("date").alias("_last"), F.count("*").alias("points"))
    rows = long.join(last, ["symbol", "window"])
    past = F.col("date") < F.col("_last")
    out = rows.groupBy("symbol", "window", "current", "points").agg(F.min("hv").alias("low"), F.max("hv").alias("high"), F.avg("hv").alias("mean"), F.avg(F.when(past, (F.col("hv") <= F.col("current")).cast("int"))).alias("percentile"))
    enough = F.col("points") >= least
    return out.select("symbol", "window", "points", "current", *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high", "mean")], F.when(enough, F.col("percentile") * 100).alias("percentile"))


def mean_range(bars: DataFrame, n: int = 22, least: int = 5) -> DataFrame:
    """Per symbol: mean of (high - low) / close in percent over its last n bars, null under ``least`` bars."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last = bars.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return last.groupBy("symbol").agg(F.when(F.count("*") >= least, F.avg((F.col("high") - F.col("low")) / F.col("close") * 100)).alias("mean_range"))


def full_day_range(bars: DataFrame, windows: tuple[int, ...] = (5, 10, 22), weights: tuple[float, ...] = (0.3, 0.3, 0.2), atr_weight: float = 0.2, spread: float = 2.2) -> DataFrame:
    """The next bar's range around each symbol's last close: weighted daily volatilities and the mean of true range and bar range, widened, held within 1 and 12 percent.

    The weights are taken as shares of their sum; without a true range the mean bar range alone counts, and without either its weight goes to the others.
    """
    w = series("symbol")
    hv = historical_volatility(bars, list(windows))
    tr = true_range(bars).withColumn("atr", sma("tr", 14, w)).select("symbol", "date", "close", (F.col("atr") / F.col("close") * 100).alias("natr"))
    last = tr.join(hv, ["symbol", "date"]).withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).filter("_n = 1")
    last = last.join(mean_range(bars), "symbol", "left")
    size = F.when(F.col("natr") > 0, F.coalesce((F.col("natr") + F.col("mean_range")) / 2, "natr")).otherwise(F.coalesce("mean_range", F.lit(0.0)))
    used = F.when(size > 0, F.lit(atr_weight)).otherwise(0.0)
    daily = sum((F.col(f"hv{n}") * k / math.sqrt(YEAR) for n, k in zip(windows, weights, strict=True)), F.lit(0.0)) + size * used
    out = last.withColumn("range_pct", clamp(daily / (sum(weights) + used) * spread, 1.0, 12.0))
    half = F.col("close") * F.col("range_pct") / 200
    return out.select("symbol", "date", "close", "range_pct", (F.col("close") - half).alias("lower"), (F.col("close") + half).alias("upper"))


def intraday_bump(closes: DataFrame, by: list[str], order: list[str], n: int = 30, most: float = 0.8, least: int = 2) -> DataFrame:
    """(by, bump): what the last n closes of a running session add to a range in percent: half their deviation scaled to 240 minutes and a part of the move since the first."""
    w = Window.partitionBy(*by)
    last = closes.withColumn("_n", F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("_n") <= n)
    back = Window.partitionBy(*by).orderBy(F.col("_n").desc())
    was = F.lag("close").over(back)
    last = last.withColumn("_r", F.when(was != 0, F.col("close") / was - 1))
    sigma = F.least(F.lit(most), F.stddev_samp("_r") * F.sqrt(240 / F.greatest(F.count("_r"), F.lit(1))) * 50)
    first, now = F.max_by("close", "_n"), F.min_by("close", "_n")
    move = F.when(first > 0, F.least(F.lit(most / 2), F.abs(now / first - 1) * 15)).otherwise(0.0)
    return last.groupBy(*by).agg(F.when(F.count("_r") >= least, F.least(F.lit(most), sigma + move)).otherwise(0.0).alias("bump"))


def ewma_volatility(bars: DataFrame, decay: float = 0.94, horizon: int = 250) -> DataFrame:
    """The exponentially weighted volatility of each symbol's last returns, a year, in percent: the fixed-parameter GARCH(1,1) of integrated variance."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    returns = bars.select("symbol", "date", F.log(F.col("close") / F.lag("close").over(series("symbol"))).alias("r")).filter("r IS NOT NULL")
    recent = returns.withColumn("age", F.row_number().over(w) - 1).filter(F.col("age") < horizon)
    weight = F.pow(F.lit(decay), F.col("age"))
    return recent.groupBy("symbol").agg((F.sqrt(F.sum(weight * F.col("r") * F.col("r")) / F.sum(weight)) * math.sqrt(YEAR) * 100).alias("volatility"))


def black_scholes(options: DataFrame) -> DataFrame:
    """options (spot, strike, years, rate, sigma, is_call) with price, delta, gamma, vega and rho (per 1 percent), theta (per day).

    Expired options, and those without volatility, have their intrinsic value, and of the Greeks only delta. The distribution function
    is evaluated once per option and argument, in a projection of its own.
    """
    spot, strike, years, rate, sigma, call = (F.col(c) for c in ("spot", "strike", "years", "rate", "sigma", "is_call"))
    was = options.columns
    live = (years > 0) & (sigma > 0)
    out = options.withColumn("_root", F.when(live, sigma * F.sqrt(years)))
    out = out.withColumn("_d1", (F.log(spot / strike) + (rate + sigma * sigma / 2) * years) / F.col("_root"))
    out = out.withColumn("_d2", F.col("_d1") - F.col("_root"))
    out = out.withColumns({"_n1": normal_cdf(F.col("_d1")), "_n2": normal_cdf(F.col("_d2")), "_p1": normal_pdf(F.col("_d1")), "_paid": strike * F.exp(-rate * years)})
    n1, n2, p1, paid = (F.col(c) for c in ("_n1", "_n2", "_p1", "_paid"))
    decay = -spot * p1 * sigma / (2 * F.sqrt(years))
    found = {
        "price": (F.when(call, spot * n1 - paid * n2).otherwise(paid * (1 - n2) - spot * (1 - n1)), F.greatest(F.when(call, spot - strike).otherwise(strike - spot), F.lit(0.0))),
        "delta": (F.when(call, n1).otherwise(n1 - 1), F.when(call, (spot > strike).cast("double")).otherwise(-(spot < strike).cast("double"))),
        "gamma": (p1 / (spot * F.col("_root")), F.lit(0.0)),
        "vega": (spot * p1 * F.sqrt(years) / 100, F.lit(0.0)),
        "theta": (F.when(call, decay - rate * paid * n2).otherwise(decay + rate * paid * (1 - n2)) / 365, F.lit(0.0)),
        "rho": (F.when(call, years * paid * n2).otherwise(-years * paid * (1 - n2)) / 100, F.lit(0.0)),
    }
    return out.withColumns({k: F.when(live, x).otherwise(rest) for k, (x, rest) in found.items()}).select(*was, *found)


def breakthrough(price: Column, lower: Column, upper: Column, confidence: Column, minutes: Column) -> dict[str, Column]:
    """up, down: the chances to leave a range in the minutes left of 240, scaled by the confidence; time, position: their factors.

    Upward the chance falls as the price nears the upper bound, as in the rule that it follows. An empty range gives 0 and the middle.
    """
    wide = upper > lower
    position = F.when(wide, clamp(F.try_divide(price - lower, upper - lower), 0.0, 1.0)).otherwise(0.5)
    time = F.when(wide, F.sqrt(clamp(minutes / 240, 0.0, 1.0))).otherwise(0.0)
    sure = clamp(confidence, 0.0, 1.0)
    return {"up": (1 - position) * time * sure, "down": position * time * sure, "time": time, "position": position}


def state_weights(hits: DataFrame) -> DataFrame:
    """Method weights by state: score .6 hit rate + .4 width quality, as shares held within .1 and .5 and made to sum to 1."""
    w = Window.partitionBy("state")
    out = hits.withColumn("score", 0.6 * F.col("hit_rate") + 0.4 * F.col("width_quality"))
    out = out.withColumn("_share", clamp(F.col("score") / F.sum("score").over(w), 0.1, 0.5))
    return out.withColumn("weight", F.col("_share") / F.sum("_share").over(w)).drop("_share")


def iv_percentile_factor(history: DataFrame) -> DataFrame:
    """Per symbol the percentile of its last value among the last 252, and the factor that narrows high and widens low volatility."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    recent = history.withColumn("_n", F.row_number().over(w)).filter("_n <= 252")
    last = recent.filter("_n = 1").select("symbol", F.col("iv").alias("current"))
    out = recent.join(last, "symbol").groupBy("symbol", "current").agg((F.avg((F.col("iv") <= F.col("current")).cast("int")) * 100).alias("percentile"))
    p = F.col("percentile")
    factor = F.when(p >= 80, F.greatest(1 - 0.15 * (p - 80) / 20, F.lit(0.75))).when(p <= 20, F.least(1 + 0.15 * (20 - p) / 20, F.lit(1.25))).otherwise(clamp(1 + (F.abs(p - 50) / 50 - 0.5) * 0.1, 0.95, 1.05))
    return out.withColumn("factor", factor)


