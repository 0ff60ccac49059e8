"""Ranges held against the market, and signals of several models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, safe_ratio
from ..functions.windows import crossed, full, series, sma


def quoted_range(lower: Column, upper: Column, bid: Column, ask: Column, tradable: Column, estimated: Column, most: float = 20.0) -> dict[str, Column]:
    """A theoretical range cut to [0.98 bid, 1.02 ask] (5 percent around the middle if hardly tradable, or where nothing is left): low, high, status, confidence, deviation in percent."""
    mid = (bid + ask) / 2
    odd, dead = lower >= upper, (bid <= 0) | (ask <= 0)
    low_edge, high_edge = F.when(tradable, bid * 0.98).otherwise(mid * 0.95), F.when(tradable, ask * 1.02).otherwise(mid * 1.05)
    a, b = F.greatest(lower, low_edge), F.least(upper, high_edge)
    empty = a >= b
    center = (low_edge + high_edge) / 2
    deviation = F.when(odd | dead, 0.0).when(center > 0, F.abs(((lower + upper) / 2 - center) / center * 100)).otherwise(0.0)
    sure = F.when(deviation <= most, 1 - deviation / most * 0.3).otherwise(0.7) * F.when(estimated, 0.8).otherwise(1.0)
    return {
        "low": F.when(odd, mid * 0.95).when(dead, lower).when(empty, mid * 0.95).otherwise(a),
        "high": F.when(odd, mid * 1.05).when(dead, upper).when(empty, mid * 1.05).otherwise(b),
        "status": F.when(odd | dead | empty, "fallback").otherwise("success"),
        "confidence": F.when(odd | dead, 0.5).otherwise(clamp(sure, 0.5, 1.0)),
        "deviation": deviation,
    }


def liquidity(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> dict[str, Column]:
    """spread in percent of the middle, and how far the sizes lean to the bid, from -1 to 1."""
    mid = (bid + ask) / 2
    return {"spread": safe_ratio(ask - bid, mid) * 100, "imbalance": safe_ratio(bid_size - ask_size, bid_size + ask_size)}


def realised_range(lower: Column, upper: Column, price: Column, range_pct: Column, realised: Column, trend: Column) -> dict[str, Column]:
    """A range widened where the realised volatility exceeds it (by half at most), then by a tenth at an edge that the price still runs to."""
    ratio = F.when(range_pct > 0, realised / range_pct).otherwise(1.0)
    factor = F.when(ratio > 1.2, F.least(F.lit(1.5), 1 + (ratio - 1.2) * 0.5)).otherwise(1.0)
    center, half = (upper + lower) / 2, (upper - lower) / 2
    low, high = center - half * factor, center + half * factor
    position = safe_ratio(price - low, high - low)
    return {"low": F.when((position < 0.15) & (trend < -0.001), low - (high - low) * 0.1).otherwise(low), "high": F.when((position > 0.85) & (trend > 0.001), high + (high - low) * 0.1).otherwise(high)}


def iv_scaled(lower: Column, upper: Column, iv: Column, hv: Column, weight: float | None = None, least: float = 0.7, most: float = 1.5) -> dict[str, Column]:
    """A range scaled by implied over historical volatility: by their blend with ``weight`` for the implied one, or, without it, up to 30 percent wider over 1.15 and up to 15 percent narrower under 0.85."""
    ratio = safe_ratio(iv, hv)
    if weight is None:
        scale = F.when(ratio > 1.15, 1 + F.least(F.lit(0.3), (ratio - 1.15) * 0.5)).when(ratio < 0.85, 1 - F.least(F.lit(0.15), (0.85 - ratio) * 0.3)).otherwise(1.0)
    else:
        scale = clamp(weight * ratio + (1 - weight), least, most)
    scale = F.coalesce(scale, F.lit(1.0))
    center, half = (upper + lower) / 2, (upper - lower) / 2
    return {"low": F.greatest(F.lit(0.0), center - half * scale), "high": center + half * scale, "scale": scale}


def session_range(price: Column, atr: Column, hv: Column, minutes: Column) -> dict[str, Column]:
    """What is left of a session's range: .6 of 1.5 true ranges and .4 of the volatility, by the root of the time left, held within .5 and 4 percent around the price."""
    root = F.sqrt(F.greatest(minutes, F.lit(0)) / 240)
    half = atr * 1.5 * root * 0.6 + price * hv / 100 * root * 0.4
    pct = clamp(half * 2 / price * 100, 0.5, 4.0)
    return {"low": price - price * pct / 200, "high": price + price * pct / 200, "range_pct": pct}


def blended(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, lower, upper, confidence) of the ranges of several periods, by their weights; weights of 0 leave them null."""
    total = F.sum("weight")
    share = lambda c: F.when(total > 0, F.try_divide(F.sum(F.col(c) * F.col("weight")), total))
    return rows.groupBy(*by).agg(share("lower").alias("lower"), share("upper").alias("upper"), share("confidence").alias("confidence"))


#: Fixed weights of the models, and the confidence from which one may speak alone (down needs more for the first).
MODELS = {"prophet": 0.35, "arima": 0.30, "technical": 0.35}


def vote(rows: DataFrame, agreements: int = 2) -> DataFrame:
    """rows (<model>_dir, <model>_conf for each of MODELS) with score, direction, confidence and kind: agreement of the models, else a single sure one, else neutral."""
    value = lambda m: F.when(F.col(f"{m}_dir") == "up", 1.0).when(F.col(f"{m}_dir") == "down", -1.0).otherwise(0.0)
    score, agreed = F.lit(0.0), F.lit(0)
    for m, w in MODELS.items():
        score = score + value(m) * w * F.col(f"{m}_conf")
    out = rows.withColumn("score", score)
    for m in MODELS:
        agreed = agreed + (value(m) * F.col("score") > 0).cast("int")
    limit = {"prophet": F.when(F.col("prophet_dir") == "down", 0.72).otherwise(0.70), "arima": F.lit(0.65), "technical": F.lit(0.80)}
    alone = F.lit(None).cast("string")
    for m in reversed(list(MODELS)):
        others = [x for x in MODELS if x != m]
        silent = (F.col(f"{others[0]}_dir") == "neutral") & (F.col(f"{others[1]}_dir") == "neutral")
        surest = (F.col(f"{m}_conf") >= F.col(f"{others[0]}_conf")) & (F.col(f"{m}_conf") >= F.col(f"{others[1]}_conf"))
        alone = F.when((F.col(f"{m}_conf") > limit[m]) & (F.col(f"{m}_dir") != "neutral") & (silent | surest), m).otherwise(alone)
    out = out.withColumns({"_agreed": agreed, "_alone": alone})
    up, down = (F.col("score") > 0.45) & (F.col("_agreed") >= agreements), (F.col("score") < -0.55) & (F.col("_agreed") >= agreements)
    of_alone = lambda part: F.when(F.col("_alone") == "prophet", F.col(f"prophet_{part}")).when(F.col("_alone") == "arima", F.col(f"arima_{part}")).when(F.col("_alone") == "technical", F.col(f"technical_{part}"))
    direction = F.when(up, "up").when(down, "down").otherwise(F.coalesce(of_alone("dir"), F.lit("neutral")))
    confidence = F.when(up | down, F.least(F.abs("score"), F.lit(1.0))).otherwise(F.coalesce(of_alone("conf"), F.lit(0.5)))
    kind = F.when(up | down, "agreement").otherwise(F.coalesce("_alone", F.lit("neutral")))
    return out.select(*rows.columns, "score", direction.alias("direction"), confidence.alias("confidence"), kind.alias("kind"))


def gap_fills(ticks: DataFrame, gap: float = 0.008, fill: float = 0.003, within: int = 1800) -> DataFrame:
    """(symbol, opened_us, previous, opening, gap, filled_us, fill, signal, strength): the batch form of streaming.monitors.watched_gaps, of whose columns it has the meaning.

    First and last prices by symbol and day are partial aggregates; only the ticks of days that open with a gap are held
    against their opening.
    """
    us, day = F.unix_micros("ts"), F.floor(F.unix_micros("ts") / F.lit(86_400_000_000))
    rows = ticks.filter("price IS NOT NULL").select("symbol", day.alias("day"), us.alias("us"), "id", "price")
    ends = rows.groupBy("symbol", "day").agg(F.min(F.struct("us", "id", "price")).alias("a"), F.max(F.struct("us", "id", "price")).alias("z"))
    was = F.lag("z.price").over(series("symbol", order="day"))
    opened = ends.select("symbol", "day", F.col("a.us").alias("opened_us"), was.alias("previous"), F.col("a.price").alias("opening")).filter("previous != 0 AND opening != 0")
    opened = opened.withColumn("gap", F.col("opening") / F.col("previous") - 1).filter(F.abs("gap") >= gap)
    change = F.col("price") / F.col("opening") - 1
    filled = F.when(F.col("gap") > 0, change <= -fill).otherwise(change >= fill) & (F.col("us") - F.col("opened_us") <= within * 1_000_000)
    first = F.min(F.when(filled, F.struct("us", "id", F.abs(change).alias("change"))))
    out = rows.join(opened, ["symbol", "day"]).groupBy("symbol", "opened_us", "previous", "opening", "gap").agg(first.alias("f"))
    share = F.col("f.change") / F.abs("gap")
    signal = F.when(F.col("f").isNotNull(), F.when(F.col("gap") > 0, "buy").otherwise("sell"))
    return out.select("symbol", "opened_us", "previous", "opening", "gap", F.col("f.us").alias("filled_us"), F.coalesce(share, F.lit(0.0)).alias("fill"), signal.alias("signal"), F.when(signal.isNotNull(), F.least(F.lit(0.8), 0.5 + 0.3 * share)).otherwise(0.0).alias("strength"))


def crossover_events(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """(symbol, date, event) entry at the golden cross of two plain means, exit at the death cross; no others."""
    w = series("symbol")
    out = bars.select("symbol", "date", sma("close", fast, w).alias("f"), sma("close", slow, w).alias("s"))
    out = out.withColumn("x", F.when(F.lag("s").over(w).isNotNull(), crossed("f", "s", w)).otherwise("none"))
    return out.filter("x != 'none'").select("symbol", "date", F.when(F.col("x") == "golden", "entry").otherwise("exit").alias("event"))


def reversal_events(bars: DataFrame, n: int = 14, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """(symbol, date, event, strength) entry where the plain RSI comes back over ``low``, exit where it falls under ``high``."""
    w = series("symbol")
    move = F.col("close") - F.lag("close").over(w)
    out = bars.select("symbol", "date", F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))).alias("g"), F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))).alias("l"))
    out = out.withColumns({"g": full(F.avg("g"), n, w, F.col("g")), "l": full(F.avg("l"), n, w, F.col("l"))})
    out = out.withColumn("rsi", F.when(F.col("l") > 0, 100 - 100 / (1 + F.try_divide("g", "l"))).when(F.col("g") > 0, 100.0))
    was = F.lag("rsi").over(w)
    out = out.withColumn("was", was)
    event = F.when((F.col("was") <= low) & (F.col("rsi") > low), "entry").when((F.col("was") >= high) & (F.col("rsi") < high), "exit")
    strength = F.when(event == "entry", F.least(F.lit(1.0), (low - F.col("was")) / 10)).otherwise(1.0)
    return out.select("symbol", "date", event.alias("event"), strength.alias("strength")).filter("event IS NOT NULL")


def breakout_events(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, date, event) entry over the highest high of the n bars before, exit under their lowest low."""
    w = series("symbol").rowsBetween(-n, -1)
    enough = F.count("high").over(w) == n
    event = F.when(enough & (F.col("close") > F.max("high").over(w)), "entry").when(enough & (F.col("close") < F.min("low").over(w)), "exit")
    return bars.select("symbol", "date", event.alias("event")).filter("event IS NOT NULL")


def held_trades(events: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, entry_date, exit_date, pnl_pct) of a position that opens at an entry while flat and closes at the next exit, at closes; what is open at the end closes at the last bar.

    Of events of one kind in a row only the first counts, so entries and exits alternate by windows alone.
    """
    w = series("symbol")
    first = events.withColumn("_was", F.lag("event").over(w)).filter("_was IS NULL OR _was != event")
    first = first.join(bars.select("symbol", "date", "close"), ["symbol", "date"])
    last = bars.groupBy("symbol").agg(F.max("date").alias("_end"), F.max_by("close", "date").alias("_last"))
    out = first.withColumns({"_to": F.lead("date").over(w), "_price": F.lead("close").over(w)}).filter("event = 'entry'").join(last, "symbol")
    price = F.coalesce("_price", "_last")
    return out.select("symbol", F.col("date").alias("entry_date"), F.coalesce("_to", "_end").alias("exit_date"), ((price - F.col("close")) / F.col("close") * 100).alias("pnl_pct"))
