"""Event back-tests: eight rule strategies in one pass over the bars, and a simulator of cash, costs and equity without a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import crossed, full, running_product, series, sma
from .indicators import recursive_averages

#: The strategies, and the bars that pass before each may act.
STRATEGIES = {"sma_crossover": 200, "ema_crossover": 200, "rsi_reversal": 14, "macd": 35, "bollinger_bands": 20, "breakout": 20, "mean_reversion": 20, "momentum": 14}


def _either(entry: Column, exit_: Column) -> Column:
    return F.when(entry, "entry").when(exit_, "exit")


def strategy_events(bars: DataFrame, warm_up: dict[str, int] | None = None, fast: int = 20, slow: int = 50, low: float = 30.0, high: float = 70.0, width: float = 2.0, percent: float = 5.0) -> DataFrame:
    """(symbol, date, close, i, strategy, event) of every bar and strategy; event is entry, exit or null, i counts the symbol's bars.

    A strategy says nothing in its first ``warm_up`` bars. Crossovers: of plain means, of exponential means (12, 26), of
    MACD and its signal. rsi_reversal: the plain RSI comes back over ``low``, or falls under ``high``. bollinger_bands: the
    close falls through the lower band, or rises through the upper one (sample deviation times ``width``). breakout: over the
    highest high, or under the lowest low, of 20 bars before. mean_reversion: the z-score of 20 bars falls under -``width``, or
    comes back to 0. momentum: the change over 13 bars rises over ``percent``, or falls under 0.
    """
    w = series("symbol")
    out = bars.select("symbol", "date", "high", "low", F.col("close").cast("double").alias("close"))
    specs = {"e_fast": ("close", 2 / 13), "e_slow": ("close", 2 / 27), "dif": lambda x: x["e_fast"] - x["e_slow"], "dea": ("dif", 0.2)}
    out = recursive_averages(out, specs).withColumn("i", F.row_number().over(w))
    move = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))  # a first bar counts as no move
    out = out.withColumns({"s_fast": sma("close", fast, w), "s_slow": sma("close", slow, w), "up": F.greatest(move, F.lit(0.0)), "down": F.greatest(-move, F.lit(0.0)), "mean": sma("close", 20, w), "dev": full(F.stddev_samp("close"), 20, w, F.col("close"))})
    out = out.withColumns({"g": full(F.avg("up"), 14, w, F.col("up")), "l": full(F.avg("down"), 14, w, F.col("down"))})
    before = w.rowsBetween(-20, -1)
    seen = F.count("high").over(before) == 20
    out = out.withColumns(
        {
            "rsi": F.when(F.col("l") > 0, 100 - 100 / (1 + F.try_divide("g", "l"))).when(F.col("g") > 0, 100.0),
            "lower": F.col("mean") - width * F.col("dev"), "upper": F.col("mean") + width * F.col("dev"), "z": F.when(F.col("dev") > 0, (F.col("close") - F.col("mean")) / F.col("dev")),
            "roc": F.when(F.lag("close", 13).over(w) != 0, (F.col("close") / F.lag("close", 13).over(w) - 1) * 100), "top": F.when(seen, F.max("high").over(before)), "bottom": F.when(seen, F.min("low").over(before)),
        }
    )
    was = {c: F.lag(c).over(w) for c in ("close", "rsi", "lower", "upper", "z", "roc")}
    c = F.col
    cross = {k: crossed(a, b, w) for k, (a, b) in {"sma_crossover": ("s_fast", "s_slow"), "ema_crossover": ("e_fast", "e_slow"), "macd": ("dif", "dea")}.items()}
    said = {k: _either(x == "golden", x == "death") for k, x in cross.items()} | {
        "rsi_reversal": _either((was["rsi"] <= low) & (c("rsi") > low), (was["rsi"] >= high) & (c("rsi") < high)),
        "bollinger_bands": _either((was["close"] >= was["lower"]) & (c("close") < c("lower")), (was["close"] <= was["upper"]) & (c("close") > c("upper"))),
        "breakout": _either(c("close") > c("top"), c("close") < c("bottom")),
        "mean_reversion": _either((was["z"] >= -width) & (c("z") < -width), (was["z"] < 0) & (c("z") >= 0)),
        "momentum": _either((was["roc"] <= percent) & (c("roc") > percent), (was["roc"] >= 0) & (c("roc") < 0)),
    }
    warm = STRATEGIES | (warm_up or {})
    each = F.array(*[F.struct(F.lit(k).alias("strategy"), F.when(c("i") > warm[k], said[k]).alias("event")) for k in STRATEGIES])
    return out.select("symbol", "date", "close", "i", each.alias("x")).select("symbol", "date", "close", "i", F.explode("x").alias("x")).select("symbol", "date", "close", "i", "x.*")


def _gain(price: Column, share: float, commission: float) -> Column:
    """What cash is multiplied by when a position bought for ``share`` of it is sold: price is the sale's over the purchase's."""
    return 1 - share * (1 + commission) + share * (1 - commission) * price


def equity_curves(events: DataFrame, capital: float = 10_000.0, share: float = 0.95, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """events (symbol, strategy, date, close, i, event) with held, entered, exited, entry_price, exit_price, cash and equity.

    Flat, an entry buys for ``share`` of the cash at the close raised by ``slippage``; held, an exit sells all at the close
    lowered by it; each side pays ``commission`` of its value. What is held at the last bar is sold there. A position is
    what the last event says, and cash a running product over the sales, so that windows do without a loop.
    """
    w = Window.partitionBy("strategy", "symbol").orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("held", F.coalesce(F.last("event", ignorenulls=True).over(so_far) == "entry", F.lit(False)))
    was = F.coalesce(F.lag("held").over(w), F.lit(False))
    out = out.withColumns({"entered": F.col("held") & ~was, "exited": ~F.col("held") & was, "_last": F.lead("i").over(w).isNull()})
    out = out.withColumn("entry_price", F.last(F.when(F.col("entered"), F.col("close") * (1 + slippage)), ignorenulls=True).over(so_far))
    closing = F.col("held") & F.col("_last")
    out = out.withColumn("exit_price", F.when(F.col("exited") | closing, F.col("close") * (1 - slippage)))
    out = out.withColumn("_gain", F.when(F.col("exit_price").isNotNull(), _gain(F.col("exit_price") / F.col("entry_price"), share, commission)))
    out = out.withColumn("cash", capital * running_product(F.when(~closing, F.col("_gain")), w))
    equity = F.when(closing, F.col("cash") * F.col("_gain")).when(F.col("held"), F.col("cash") * (1 - share * (1 + commission) + share * F.col("close") / F.col("entry_price"))).otherwise(F.col("cash"))
    return out.withColumn("equity", equity).withColumn("exited", F.col("exited") | closing).drop("_last", "_gain")


def equity_metrics(curves: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """(strategy, symbol, final, return_pct, trades, win_rate, profit_factor, max_drawdown_pct, longest_drawdown): longest_drawdown in bars, from the first one under the peak to the last before the next."""
    w = Window.partitionBy("strategy", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = curves.withColumn("_peak", F.greatest(F.max("equity").over(w), F.lit(capital))).withColumn("_under", F.col("equity") < F.col("_peak"))
    out = out.withColumn("_run", F.sum((~F.col("_under")).cast("int")).over(w))
    runs = out.groupBy("strategy", "symbol", "_run").agg(
        F.count(F.when(F.col("_under"), 1)).alias("_n"), F.min((F.col("equity") / F.col("_peak") - 1) * 100).alias("_dd"), F.max(F.struct("date", "equity")).alias("_end"), F.count(F.when(F.col("exited"), 1)).alias("_trades"),
        F.count(F.when(F.col("exited") & (F.col("exit_price") > F.col("entry_price")), 1)).alias("_wins"), F.sum(F.when(F.col("exited"), F.greatest(F.col("exit_price") / F.col("entry_price") - 1, F.lit(0.0)))).alias("_plus"), F.sum(F.when(F.col("exited"), F.greatest(1 - F.col("exit_price") / F.col("entry_price"), F.lit(0.0)))).alias("_minus"),
    )
    out = runs.groupBy("strategy", "symbol").agg(F.max("_end").alias("e"), F.sum("_trades").alias("trades"), F.sum("_wins").alias("w"), F.sum("_plus").alias("p"), F.sum("_minus").alias("m"), F.min("_dd").alias("max_drawdown_pct"), F.max("_n").alias("longest_drawdown"))
    final = F.col("e.equity")
    return out.select("strategy", "symbol", final.alias("final"), ((final / capital - 1) * 100).alias("return_pct"), "trades", F.when(F.col("trades") > 0, F.col("w") / F.col("trades") * 100).alias("win_rate"), F.when(F.col("m") > 0, F.col("p") / F.col("m")).alias("profit_factor"), "max_drawdown_pct", "longest_drawdown")


def event_trades(curves: DataFrame, share: float = 0.95) -> DataFrame:
    """(strategy, symbol, entry_date, exit_date, entry_price, exit_price, size, return_pct) of each position."""
    w = Window.partitionBy("strategy", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = curves.withColumns({"entry_date": F.last(F.when(F.col("entered"), F.col("date")), ignorenulls=True).over(w), "_cash": F.last(F.when(F.col("entered"), F.col("cash")), ignorenulls=True).over(w)}).filter("exited")
    return out.select("strategy", "symbol", "entry_date", F.col("date").alias("exit_date"), "entry_price", "exit_price", (share * F.col("_cash") / F.col("entry_price")).alias("size"), ((F.col("exit_price") / F.col("entry_price") - 1) * 100).alias("return_pct"))


# --- dips after a limit-up


def dip_candidates(payloads: DataFrame, phase: str, least: float = 0.0, keywords: tuple[str, ...] = ()) -> DataFrame:
    """(date, symbol, name, sector, sector_score, leader_score, limit_close) of the leaders of each day's sectors in a phase, from ``least`` on.

    payloads: date, sectors (name, phase, score, leaders (code, name, latest_price, leader_score)), limit_ups (code,
    latest_price). A leader without a code goes; one without a price (or 0) takes that of the day's list. With
    ``keywords`` the sector's name has one of them.
    """
    sectors = payloads.select("date", "limit_ups", F.explode("sectors").alias("s")).filter((F.col("s.phase") == phase) & (F.coalesce("s.score", F.lit(0)) >= least))
    for_ = None
    for word in keywords:
        has = F.col("s.name").contains(word)
        for_ = has if for_ is None else for_ | has
    sectors = sectors.filter(for_) if for_ is not None else sectors
    out = sectors.select("date", "limit_ups", "s", F.explode("s.leaders").alias("l")).filter("l.code IS NOT NULL AND l.code != ''")
    listed = F.get(F.filter("limit_ups", lambda x: x["code"] == F.col("l.code")), 0)["latest_price"]
    price = F.when(F.col("l.latest_price") != 0, F.col("l.latest_price")).otherwise(listed)
    return out.select("date", F.col("l.code").alias("symbol"), "l.name", F.col("s.name").alias("sector"), F.coalesce("s.score", F.lit(0)).cast("double").alias("sector_score"), F.coalesce("l.leader_score", F.lit(0)).cast("double").alias("leader_score"), price.alias("limit_close")).filter("limit_close > 0")


def dip_trades(signals: DataFrame, bars: DataFrame, params: DataFrame, longest: int) -> DataFrame:
    """(p, symbol, entry_date, entry, how, held, pnl_pct) of signals (symbol, date, limit_close, sector_score) bought at the next bar's open, for each row of params (p, least_score, hold, stop_pct, target_pct, dip_min, dip_max, shrink).

    A signal is taken where its sector scores ``least_score`` or more, the opening lies ``dip_min`` to ``dip_max`` percent from
    the limit close, and, for a ``shrink`` under 1, the bar's volume is no more than that share of the one before. The
    stop is the lower of the low before and ``stop_pct`` under the limit close; of the hold + 1 bars from the entry the
    first that reaches the stop, or else the target, ends the trade, else the last bar's close. Each signal meets its bars
    once, the ``longest`` + 1 that any hold needs, as an array; the grid, which is broadcast, is then a test on arrays.
    """
    w = series("symbol")
    ahead = F.collect_list(F.struct("low", "high", "close")).over(w.rowsBetween(0, longest))
    numbered = bars.select("symbol", F.lag("date").over(w).alias("date"), F.col("date").alias("entry_date"), F.col("open").alias("entry"), F.col("volume").alias("_v"), F.lag("low").over(w).alias("_low"), F.lag("volume").over(w).alias("_was"), ahead.alias("_bars"))
    x = signals.join(numbered, ["symbol", "date"]).join(F.broadcast(params), how="cross")
    c = F.col
    dip = (c("entry") - c("limit_close")) / c("limit_close") * 100
    thin = (c("shrink") >= 1) | ~F.coalesce((c("_v") > 0) & (c("_was") > 0), F.lit(False)) | (c("_v") / c("_was") <= c("shrink"))
    x = x.filter((c("sector_score") >= c("least_score")) & (dip <= c("dip_max")) & (dip >= c("dip_min")) & thin)
    x = x.withColumns({"_stop": F.least(F.coalesce("_low", c("limit_close") * 0.95), c("limit_close") * (1 - c("stop_pct") / 100)), "_target": c("limit_close") * (1 + c("target_pct") / 100), "_bars": F.slice("_bars", F.lit(1), c("hold") + 1)})
    ends = F.transform("_bars", lambda b, i: F.struct(F.when(b["low"] <= c("_stop"), "stop").when(b["high"] >= c("_target"), "target").alias("how"), F.when(b["low"] <= c("_stop"), c("_stop")).otherwise(c("_target")).alias("price"), i.alias("held")))
    last = F.struct(F.lit("time").alias("how"), F.element_at("_bars", -1)["close"].alias("price"), (F.size("_bars") - 1).alias("held"))
    x = x.withColumn("_x", F.coalesce(F.get(F.filter(ends, lambda e: e["how"].isNotNull()), 0), last))
    return x.select("p", "symbol", "entry_date", "entry", c("_x.how").alias("how"), c("_x.held").cast("int").alias("held"), ((c("_x.price") - c("entry")) / c("entry") * 100).alias("pnl_pct"))
