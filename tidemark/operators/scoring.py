"""Scores: composite and three-factor rotation scores, readiness, screening paradigms, trends, gaps, rule predictors, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, safe_ratio
from ..functions.windows import series, sma

#: Fixed weights of the composite scores.
LEGACY = {"m20": 0.45, "m60": 0.35, "vol20": -0.15, "mdd60": 0.05}
FACTORS = {"m20": 0.30, "m60": 0.25, "vol20": -0.15, "mdd60": 0.05, "r2": 0.10, "mean_corr": -0.20}
#: Fixed shares of price lost to slippage and fees, by instrument.
SLIPPAGE = {"ETF": 0.0005, "INDEX": 0.0, "OPTION": 0.0015, "MIXED": 0.0008}
FEES = {"ETF": 0.0002, "INDEX": 0.0, "OPTION": 0.0006, "MIXED": 0.0003}


def weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * w
    return out


def state_scores(x: DataFrame) -> DataFrame:
    """x (dif, dea, hist, rsi, adx, natr, close, upper, middle, lower) with the five states macd_state, rsi_state, strength, natr_score, band_state.

    hist and dif are doubled against dea before they are compared, as in the rule that this follows.
    """
    dif, hist = F.col("dif") * 2, F.col("hist") * 2
    return x.withColumns(
        {
            "macd_state": F.when((dif > F.col("dea")) & (hist > 0), 1.0).when((dif < F.col("dea")) & (hist < 0), -1.0).otherwise(0.0),
            "rsi_state": F.when((F.col("rsi") >= 50) & (F.col("rsi") < 70), 1.0).when(F.col("rsi") < 45, -1.0).otherwise(0.0),
            "strength": F.when(F.col("adx") >= 25, 1.0).when(F.col("adx") >= 20, 0.6).otherwise(0.2),
            "natr_score": clamp(F.col("natr") / 100, 0.0, 1.0),
            "band_state": F.when(F.col("close") >= F.col("upper"), 0.0).when(F.col("close") >= F.col("middle"), 1.0).when(F.col("close") <= F.col("lower"), -1.0).otherwise(0.0),
        }
    )


def state_composite() -> Column:
    """The composite score with momenta signed by the states, natr for the volatility and the trend's strength for its fit."""
    mood = 0.5 * F.col("macd_state") + 0.5 * F.col("rsi_state")
    return mood * F.abs("m20") * 0.30 + mood * F.abs("m60") * 0.25 - F.col("natr_score") * 0.15 + F.col("mdd60") * 0.05 + F.col("strength") * 0.10 - F.col("mean_corr") * 0.20


def three_factor(rows: DataFrame, by: list[str], mood: str, moods: dict[str, float], dispersion: float, sentiment: float, fund_flow: float | None, northbound: float | None) -> DataFrame:
    """rows (m20, m60, crowding) with momentum, resonance, gate, sentiment and score: min-max momenta, market flows that agree or not, and the mood's gate.

    moods: the multiplier of each name that the caller's moods go by; a name that is not among them counts 1.
    """
    w = Window.partitionBy(*by)

    def norm(x: Column) -> Column:
        low, high = F.min(x).over(w), F.max(x).over(w)
        return F.when(high > low, clamp((x - low) / (high - low), 0.0, 1.0)).otherwise(0.5)

    known = fund_flow is not None and northbound is not None
    resonance = 0.5 if not known else (1.0 if min(fund_flow, northbound) > 0 else 0.5 if max(fund_flow, northbound) > 0 else 0.0)
    gate = moods.get(mood, 1.0) * (0.7 if dispersion > 0.5 else 0.85 if dispersion > 0.4 else 1.0)
    momentum = 0.4 * norm(F.col("m20")) + 0.3 * norm(F.col("m60")) + 0.3 * F.least(norm(F.greatest(F.lit(0.0), F.col("crowding"))) / 0.5, F.lit(1.0))
    out = rows.withColumns({"momentum": momentum, "resonance": F.lit(resonance), "gate": F.lit(gate), "sentiment": F.lit(sentiment)})
    return out.withColumn("score", (F.col("momentum") * 0.40 + F.col("resonance") * 0.35) * F.col("gate") + F.col("sentiment") * 0.25)


def three_factor_v3(rows: DataFrame, share_weight: float = 0.15) -> DataFrame:
    """rows (momentum, gate, sentiment, resonance, leadership, breadth, share) with score_v3 and the risk events of each.

    A share that is missing or 0 counts as the resonance; sentiment, leadership and breadth that are missing or 0 as .5.
    """

    def known(c: str, default: Column) -> Column:
        return F.when(F.col(c) != 0, F.col(c)).otherwise(default)

    half = F.lit(0.5)
    share, breadth = known("share", F.col("resonance")), known("breadth", half)
    score = (F.col("momentum") * known("leadership", half) * breadth * 0.55 + F.col("resonance") * 0.2 + share * share_weight + known("sentiment", half) * 0.1) * F.col("gate")
    events = F.array_compact(F.array(F.when(breadth < 0.35, "breadth_collapse"), F.when((share < 0) & (F.col("momentum") > 0), "price_share_divergence")))
    return rows.withColumns({"score_v3": score, "events": F.array_join(events, ",")})


def readiness(rows: DataFrame, least: int = 5) -> DataFrame:
    """(pool, total, ok, degraded) of rows (pool, excluded): a pool with fewer usable symbols than ``least`` is degraded."""
    out = rows.groupBy("pool").agg(F.count("*").alias("total"), F.count(F.when(~F.col("excluded"), 1)).alias("ok"))
    return out.withColumn("degraded", F.col("ok") < least)


def premium_penalty(action: Column, band: Column) -> Column:
    """What a fund's score is multiplied with for its premium."""
    return F.when(action == "WAIT", 0.70).when(action == "GO_LIGHT", 0.85).when(band == "hot", 0.75).when(band == "warm", 0.90).otherwise(1.0)


def steps(x: Column, *levels: tuple[float, float], strict: bool = False) -> Column:
    """The points of the first level that x reaches (or exceeds, if strict), levels from the highest; 0 under all."""
    out = F.lit(0.0)
    for level, points in reversed(levels):
        out = F.when((x > level) if strict else (x >= level), points).otherwise(out)
    return out


def fund_flow_score(inflow: Column, pct: Column, ratio: Column) -> Column:
    flow = F.when(inflow >= 2e8, 40.0).when(inflow >= 1e8, 32.0).when(inflow >= 5e7, 24.0).when(inflow > 0, 12.0).otherwise(0.0)
    dip = F.when((pct >= -3) & (pct <= 0), 30.0).when((pct > -4) & (pct < -3), 20.0).when((pct >= -5) & (pct <= -4), 10.0).otherwise(0.0)
    return flow + dip + steps(ratio, (1.8, 30.0), (1.5, 24.0), (1.2, 15.0))


def tail_grab_score(last: Column, ratio: Column, distance: Column) -> Column:
    near = F.when((distance > 0) & (distance <= 3), 30.0).when(distance > 3, 22.0).when(F.abs(distance) <= 0.5, 15.0).otherwise(0.0)
    return steps(last, (2.0, 40.0), (1.0, 32.0), (0.5, 20.0)) + steps(ratio, (2.0, 30.0), (1.5, 24.0), (1.2, 15.0)) + near


def oversold_score(pct: Column, ratio: Column, amount: Column) -> Column:
    dip = F.when((pct >= -4) & (pct <= -2), 50.0).when((pct >= -5) & (pct < -4), 38.0).when((pct > -5.5) & (pct <= -5), 22.0).otherwise(0.0)
    return dip + steps(ratio, (1.5, 30.0), (1.2, 22.0), (1.0, 12.0)) + steps(amount, (2e8, 20.0), (1e8, 16.0), (5e7, 10.0))


def sector_score(industry: Column, extra: Column, listed: Column, top_third: Column, ret: Column, least: float = 0.0) -> Column:
    strong = F.when(extra >= least, F.when(extra >= 0.5, 15.0).when(extra >= 0, 10.0).otherwise(0.0)).when(extra >= -0.5, 5.0).otherwise(0.0)
    pool = F.when(listed & top_third, 35.0).when(listed, 22.0).when(top_third, 12.0).otherwise(0.0)
    return F.least(F.lit(45.0), steps(industry, (2.0, 18.0), (1.0, 14.0), (0.5, 10.0), (0.0, 6.0)) + strong) + pool + steps(ret, (2.0, 20.0), (1.0, 15.0), (0.0, 10.0), (-1.0, 5.0))


def confluence(pools: DataFrame, bonus: float = 4.0, most: float = 12.0) -> DataFrame:
    """(symbol, score, k) of pools (symbol, paradigm, score, amount): the best score, a bonus for each further paradigm, and up to two points for liquidity among all, by the amount beside the best score (ties: the first paradigm by name)."""
    out = pools.groupBy("symbol").agg(F.max("score").alias("_m"), F.count_distinct("paradigm").alias("k"), F.min_by("amount", F.struct(-F.col("score"), "paradigm")).alias("_a"))
    ends = out.agg(F.min("_a").alias("_low"), F.max("_a").alias("_high"))
    out = out.join(F.broadcast(ends), how="cross")  # one row
    liquid = F.when(F.col("_high") > F.col("_low"), F.round(2 * clamp((F.col("_a") - F.col("_low")) / (F.col("_high") - F.col("_low")), 0.0, 1.0), 2)).otherwise(0.0)
    return out.select("symbol", (F.col("_m") + F.least(F.lit(most), bonus * (F.col("k") - 1)) + liquid).alias("score"), "k")


def top_third(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, threshold): the value at place ceil(2n/3) of each group's sorted values."""
    w = Window.partitionBy(*by)
    out = rows.filter(F.col(x).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(x)), "_n": F.count("*").over(w)})
    at = F.greatest(F.lit(1), F.ceil(F.col("_n") * 2 / 3))
    return out.filter(F.col("_r") == at).select(*by, F.col(x).alias("threshold"))


def reweighted(rows: DataFrame, by: list[str], weights: dict[str, float]) -> DataFrame:
    """rows with score: the weighted sum of the factors that tell anything in their group (not all 50, not all null), with their weights made to sum to 1; missing values count 50."""
    w = Window.partitionBy(*by)
    active = {f: ~((F.max(F.abs(F.coalesce(F.col(f), F.lit(50.0)) - 50)).over(w) < 1e-9) | (F.count(f).over(w) == 0)) for f in weights}
    out = rows.withColumns({f"_on_{f}": F.when(x, weights[f]).otherwise(0.0) for f, x in active.items()})
    total, acc = F.lit(0.0), F.lit(0.0)
    for f in weights:
        total, acc = total + F.col(f"_on_{f}"), acc + F.col(f"_on_{f}") * F.coalesce(F.col(f), F.lit(50.0))
    return out.withColumn("score", F.try_divide(acc, total)).drop(*[f"_on_{f}" for f in weights])


def trend_label(score: Column) -> dict[str, Column]:
    """trend: strong from .7, weak to .3, else choppy; and its strength."""
    return {"trend": F.when(score >= 0.7, "strong").when(score <= 0.3, "weak").otherwise("choppy"), "strength": F.when(score >= 0.7, score).when(score <= 0.3, 1 - score).otherwise(F.abs(score - 0.5) * 2)}


def index_trend_score(close: Column, ma20: Column, ma60: Column, dif: Column, dea: Column) -> Column:
    """.4 for the order of price and averages, .4 for the sign of the average convergence, .2 for the price over the short average; null until all are known."""
    order = F.when((close > ma20) & (ma20 > ma60), 0.4).when((close < ma20) & (ma20 < ma60), 0.0).otherwise(0.2)
    turn = F.when(dif > dea, 0.4).when(dif < dea, 0.0).otherwise(0.2)
    return F.when(ma60.isNotNull(), order + turn + F.when(close > ma20, 0.2).otherwise(0.0))


def overall_trend_score(first: Column, second: Column, rising: Column) -> Column:
    value = lambda t: F.when(t == "strong", 1.0).when(t == "weak", 0.0).otherwise(0.5)
    return value(first) * 0.4 + value(second) * 0.4 + rising * 0.2


def overnight_impact(future: Column, index: Column) -> Column:
    """A third of the gap between two changes in percent, held within -1 and 1."""
    return clamp((future - index) / 3, -1.0, 1.0)


def daily_trend(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, date, direction, score): the price's side of its n-bar mean, and up to .1 for its distance and the mean's slope over five bars."""
    w = series("symbol")
    out = bars.select("symbol", "date", "close", sma("close", n, w).alias("ma"))
    was = F.lag("ma", 4).over(w)
    out = out.withColumn("slope", F.coalesce(F.when(was > 0, (F.col("ma") - was) / was * 100), F.lit(0.0))).filter("ma IS NOT NULL")
    gap = F.abs(safe_ratio(F.col("close") - F.col("ma"), F.col("ma"))) * 100
    side = F.sign(F.col("close") - F.col("ma"))
    score = F.when(side == 0, 0.0).otherwise(F.least(F.lit(0.1), F.least(gap / 5, F.lit(1.0)) * 0.05 + F.greatest(F.lit(0.0), side * F.col("slope")) / 2 * 0.05))
    return out.select("symbol", "date", F.when(side > 0, "bullish").when(side < 0, "bearish").otherwise("neutral").alias("direction"), score.alias("score"))


def gap_trades(bars: DataFrame, least: float = 0.8, fill: float = 0.5) -> DataFrame:
    """(symbol, date, gap, direction, filled, strength) of bars that open at least ``least`` percent off the close before; filled if the price retraces that percentage from the open."""
    w = series("symbol")
    was = F.lag("close").over(w)
    out = bars.withColumn("gap", safe_ratio(F.col("open") - was, was) * 100).filter(F.abs("gap") >= least)
    up = F.col("gap") > 0
    back = F.when(up, (F.col("open") - F.col("low")) / F.col("open")).otherwise((F.col("high") - F.col("open")) / F.col("open")) * 100
    share = clamp(safe_ratio(back, F.abs("gap")), 0.0, 1.0)
    return out.select("symbol", "date", "gap", F.when(up, "up").otherwise("down").alias("direction"), (back >= fill).alias("filled"), F.least(F.lit(0.8), 0.5 + 0.3 * share).alias("strength"))


def stock_rule(close: Column, ma20: Column, rsi: Column, volume: Column, ma5: Column, change: Column) -> dict[str, Column]:
    """signal and strength: a pullback over the mean, or a bounce under it, with enough volume; none on days near the price limit."""
    loud = (ma5 > 0) & (volume >= ma5 * 1.35) & ~(F.abs(F.coalesce(change, F.lit(0.0))) >= 9.5)
    signal = F.when(loud & (close > ma20) & (rsi < 35), "bullish_pullback").when(loud & (close < ma20) & (rsi > 65), "bearish_bounce").otherwise("none")
    extra = F.when(signal == "bullish_pullback", (35 - rsi) / 100).when(signal == "bearish_bounce", (rsi - 65) / 100)
    return {"signal": signal, "strength": F.least(F.lit(0.85), 0.45 + extra)}


def reversion_score(percentile: Column, ret10: Column, flow: Column) -> Column:
    """A rule predictor: back from extremes of style, a tenth-day momentum and the flow; missing inputs are neutral."""
    p, r, f = F.coalesce(percentile, F.lit(50.0)), F.coalesce(ret10, F.lit(0.0)), F.coalesce(flow, F.lit(0.0))
    back = F.when(p > 90, -0.30).when(p < 10, 0.30).otherwise(0.0)
    return back * 0.6 + clamp(f * 0.25, -0.2, 0.2) * 0.25 + F.sign(r) * 0.15 * 0.15


def valuation_score(north: Column, macro: Column, valuation: Column, multiplier: float = 1.0) -> Column:
    """A rule predictor: flows, macro news and a valuation under 30 or over 70."""
    return clamp(north, -1.0, 1.0) * 0.35 + clamp(macro * multiplier, -1.0, 1.0) * 0.35 + F.when(valuation < 30, 0.15).when(valuation > 70, -0.15).otherwise(0.0) * 0.30


def call(score: Column) -> dict[str, Column]:
    """probability within 35 and 80, and the direction: up from 55, down to 45."""
    p = clamp(50 + score * 100, 35.0, 80.0)
    return {"probability": p, "direction": F.when(p >= 55, "up").when(p <= 45, "down").otherwise("neutral")}


def single_risk(entry: Column, sigma: Column, win: Column, gain: Column, loss: Column) -> dict[str, Column]:
    """stop: 1.5 deviations (of a share) under the entry, or 3 percent where unknown; kelly within 0 and a quarter."""
    stop = F.when(sigma > 0, entry * (1 - sigma * 1.5)).otherwise(entry * 0.97)
    return {"stop": stop, "kelly": clamp(win - (1 - win) / safe_ratio(gain, loss), 0.0, 0.25)}


def order_cost(instrument: Column) -> Column:
    """Slippage and fees as a share of the price; null for unknown instruments."""
    out = F.lit(None).cast("double")
    for name in SLIPPAGE:
        out = F.when(instrument == name, SLIPPAGE[name] + FEES[name]).otherwise(out)
    return out


def order_errors(strategy: Column, instrument: Column, symbol: Column, side: Column, target: Column) -> Column:
    """What is wrong with an order, joined by commas; empty if nothing is."""
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    wrong = {"strategy": empty(strategy), "instrument": ~F.coalesce(instrument.isin(list(SLIPPAGE)), F.lit(False)), "symbol": empty(symbol), "side": ~F.coalesce(side.isin("BUY", "SELL"), F.lit(False)), "target": ~F.coalesce(target > 0, F.lit(False))}
    return F.array_join(F.array_compact(F.array(*[F.when(x, k) for k, x in wrong.items()])), ",")


def pullback_trades(signals: DataFrame, bars: DataFrame, params: DataFrame) -> DataFrame:
    """Trades of signals (symbol, date, limit_close) bought at the next bar's open, for each row of params (p, hold, stop_pct, target_pct, dip_min, dip_max).

    Of the hold + 1 bars from the entry on the first whose low reaches the stop, or else whose high reaches the target, ends
    the trade, the stop first within a bar; otherwise the last bar's close. The stop is the lower of the low a calendar
    day before the entry (0.95 of the limit close if there is no bar) and ``stop_pct`` under the limit close. params is a
    small grid and is broadcast; a signal meets no more than hold + 1 bars.
    """
    w = series("symbol")
    numbered = bars.withColumn("_i", F.row_number().over(w))
    entry = numbered.withColumns({"_was": F.lag("date").over(w)})
    lows = bars.select("symbol", F.date_add("date", 1).alias("entry_date"), F.col("low").alias("_low"))
    x = signals.join(entry.select("symbol", F.col("_was").alias("date"), F.col("date").alias("entry_date"), F.col("open").alias("entry"), F.col("_i").alias("_e")), ["symbol", "date"])
    x = x.join(lows, ["symbol", "entry_date"], "left")
    x = x.join(F.broadcast(params), how="cross")
    dip = (F.col("entry") - F.col("limit_close")) / F.col("limit_close") * 100
    x = x.filter((dip <= F.col("dip_max")) & (dip >= F.col("dip_min")))
    x = x.withColumns({"stop": F.least(F.coalesce("_low", F.col("limit_close") * 0.95), F.col("limit_close") * (1 - F.col("stop_pct") / 100)), "target": F.col("limit_close") * (1 + F.col("target_pct") / 100)})
    x = x.withColumn("_at", F.explode(F.sequence(F.col("_e"), F.col("_e") + F.col("hold"))))
    x = x.join(numbered.select("symbol", F.col("_i").alias("_at"), "high", "low", "close"), ["symbol", "_at"])
    x = x.withColumn("_out", F.when(F.col("low") <= F.col("stop"), F.struct(F.lit("stop").alias("how"), F.col("stop").alias("price"))).when(F.col("high") >= F.col("target"), F.struct(F.lit("target").alias("how"), F.col("target").alias("price"))))
    first = F.min_by(F.struct("_out", F.col("_at")), F.when(F.col("_out").isNotNull(), F.col("_at")))
    last = F.max_by(F.struct(F.struct(F.lit("time").alias("how"), F.col("close").alias("price")).alias("_out"), F.col("_at")), "_at")
    out = x.groupBy("p", "symbol", "entry_date", "entry", "_e").agg(F.coalesce(first, last).alias("x"))
    pnl = (F.col("x._out.price") - F.col("entry")) / F.col("entry") * 100
    return out.select("p", "symbol", "entry_date", "entry", F.col("x._out.how").alias("how"), (F.col("x._at") - F.col("_e")).alias("held"), pnl.alias("pnl_pct"))


def pullback_grid(trades: DataFrame) -> DataFrame:
    """(p, trades, win_rate, avg_pnl, worst, score) per row of the grid: .5 win rate + .3 gain - .2 worst trade."""
    out = trades.groupBy("p").agg(F.count("*").alias("trades"), (F.avg((F.col("pnl_pct") > 0).cast("int")) * 100).alias("win_rate"), F.avg("pnl_pct").alias("avg_pnl"), F.min("pnl_pct").alias("worst"))
    return out.withColumn("score", F.col("win_rate") * 0.5 + F.greatest(F.lit(0.0), F.col("avg_pnl")) * 0.3 - F.abs("worst") * 0.2)


def efficiency(rows: DataFrame, by: list[str], split: str, least: int = 3) -> DataFrame:
    """(by, ratio, overfit) of closed trades (pnl, date): the mean gain from the split date on over that before; null with fewer than ``least`` trades on a side."""
    before = F.col("date") < F.lit(split).cast("date")
    out = rows.groupBy(*by).agg(F.count(F.when(before, 1)).alias("n_is"), F.count(F.when(~before, 1)).alias("n_oos"), F.avg(F.when(before, F.col("pnl"))).alias("_a"), F.avg(F.when(~before, F.col("pnl"))).alias("_b"))
    ratio = F.when((F.col("n_is") >= least) & (F.col("n_oos") >= least), F.col("_b") / F.greatest(F.abs("_a"), F.lit(1e-8)))
    out = out.withColumn("ratio", ratio)
    return out.withColumn("overfit", F.when(F.col("ratio").isNotNull(), (F.col("ratio") < 0.5) & (F.col("_a") > 1e-8))).drop("_a", "_b")
