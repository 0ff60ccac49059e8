"""Options: Greeks from tall field and value rows, what changed in them, signals from turns of the underlying, ranges of an option's price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from ..functions.windows import series
from .bars import tail
from .indicators import macd, rsi_simple

#: Fixed weights of the parts of an option signal.
WEIGHTS = {"boundary": 0.40, "divergence": 0.15, "macd": 0.15, "greeks": 0.20, "trend": 0.10}
#: Fixed levels of its strength.
WEAK, MEDIUM, STRONG = 0.45, 0.55, 0.75
#: Trading minutes of a year.
YEAR_MINUTES = 240 * 250


def greeks_wide(tall: DataFrame, by: list[str], fields: dict[str, str]) -> DataFrame:
    """(by, *fields) of tall rows (by, field, value): a column for each field, by its name in the source.

    Values are texts; what is no number counts as missing, and of several values the largest is taken. A row whose fields
    are all missing stays. One aggregate with partial maxima, so no key's rows are gathered.
    """
    number = F.col("value").try_cast("double")
    return tall.groupBy(*by).agg(*[F.max(F.when(F.col("field") == name, F.when(~F.isnan(number), number))).alias(c) for c, name in fields.items()])


def closest_greeks(asks: DataFrame, wide: DataFrame, within: int = 30) -> DataFrame:
    """asks (contract, day) with the rows of the newest day that the contract has up to it, less than ``within`` days back: (contract, day, trade_date, ts, ...).

    wide: contract, trade_date, ts, .... Each stored day of a contract reaches ``within`` days on; no day is searched for.
    """
    days = wide.select("contract", "trade_date").distinct()
    reach = days.select("contract", "trade_date", F.explode(F.sequence(F.col("trade_date"), F.date_add("trade_date", within - 1))).alias("day"))
    found = asks.join(reach, ["contract", "day"]).groupBy("contract", "day").agg(F.max("trade_date").alias("trade_date"))
    return found.join(wide, ["contract", "trade_date"])


def greeks_change(rows: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """(by, n, delta_change, gamma_peak, iv_change, quality) of rows (by, order, delta, gamma, iv).

    delta_change: the last delta less the one before; gamma_peak: the last gamma over their mean; iv_change: the last iv
    against the one before, in percent. Missing values are passed over. Fewer than two rows are insufficient and change
    nothing, fewer than five low.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_{c}": F.last(c, ignorenulls=True).over(before) for c in ("delta", "iv")})

    def at_last(x: Column, c: str) -> Column:
        return F.max_by(x, F.when(F.col(c).isNotNull(), F.col(order)))

    mean = F.avg("gamma")
    out = out.groupBy(*by).agg(
        F.count("*").alias("n"), at_last(F.col("delta") - F.col("_delta"), "delta").alias("_d"), F.when(mean > 0, at_last(F.col("gamma"), "gamma") / mean).alias("_g"),
        at_last(safe_ratio(F.col("iv") - F.col("_iv"), F.col("_iv")) * 100, "iv").alias("_i"),
    )
    some = F.col("n") >= 2
    quality = F.when(~some, "insufficient").when(F.col("n") < 5, "low").otherwise("good")
    known = {"delta_change": ("_d", 0.0), "gamma_peak": ("_g", 1.0), "iv_change": ("_i", 0.0)}
    return out.select(*by, "n", *[F.when(some, F.coalesce(c, F.lit(default))).otherwise(default).alias(name) for name, (c, default) in known.items()], quality.alias("quality"))


def greeks_score(delta_change: Column, gamma_peak: Column, iv_change: Column, quality: Column) -> Column:
    """Up to .2 for moves of delta (.1 or more), a peak of gamma (1.5 or more) and moves of iv (5 percent or more); less where there are few rows, 0 without any."""
    one = F.lit(1.0)
    delta = F.when(F.abs(delta_change) >= 0.1, F.least(F.abs(delta_change) / 0.5, one) * 0.1).otherwise(0.0)
    gamma = F.when(gamma_peak >= 1.5, F.least(gamma_peak - 1, one) * 0.1).otherwise(0.0)
    iv = F.when(F.abs(iv_change) >= 5, F.least(F.abs(iv_change) / 20, one) * 0.05).otherwise(0.0)
    share = F.when(quality == "low", 0.8).when(quality == "insufficient", 0.6).otherwise(1.0)
    return F.coalesce(F.least(F.lit(WEIGHTS["greeks"]), (delta + gamma + iv) * share), F.lit(0.0))


def boundary_rebound(price: Column, lower: Column, upper: Column, low: float = 0.25, high: float = 0.75) -> dict[str, Column]:
    """kind (call near the lower end of the range, put near the upper one) and strength, null where there is none."""
    at = F.when(upper > lower, (price - lower) / (upper - lower))
    kind = F.when(at < low, "call").when(at > high, "put")
    return {"kind": kind, "strength": F.when(kind == "call", F.least((low - at) / low, F.lit(1.0))).when(kind == "put", F.least((at - high) / (1 - high), F.lit(1.0)))}


def macd_turn(hist: Column, before: Column, percent: float = 20.0) -> dict[str, Column]:
    """kind (bullish, bearish) and strength of a histogram that crosses 0, or comes ``percent`` nearer to it."""
    nearer = F.abs(hist) < F.abs(before) * (1 - percent / 100)
    crossed = ((hist > 0) & (before < 0)) | ((hist < 0) & (before > 0))
    same = ((hist > 0) & (before > 0)) | ((hist < 0) & (before < 0))
    kind = F.when(crossed, F.when(hist > 0, "bullish").otherwise("bearish")).when(same & nearer, F.when(hist < 0, "bullish").otherwise("bearish"))
    return {"kind": kind, "strength": F.when(crossed, F.least(F.abs(hist - before) / 10, F.lit(1.0))).when(kind.isNotNull(), F.least((F.abs(before) - F.abs(hist)) / F.abs(before), F.lit(1.0)))}


def window_divergence(rows: DataFrame, n: int = 15, least: float = 5.0) -> DataFrame:
    """(symbol, kind, strength) of rows (symbol, date, close, rsi) over each symbol's last n: bullish where the RSI at the least close is ``least`` over that at the least close
    before it, else bearish where the RSI at the greatest close is ``least`` under that at the greatest one before it; null where neither."""
    last = tail(rows, ["symbol"], "date", n).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close", "rsi"))).alias("x")).filter(F.size("x") == n)

    def side(sign: int) -> Column:
        placed = F.transform("x", lambda v, i: F.struct((v["close"] * sign).alias("c"), i.alias("i"), v["rsi"].alias("rsi")))
        least_ = F.array_min(placed)
        was = F.array_min(F.filter(placed, lambda v: v["i"] < least_["i"]))
        return (least_["rsi"] - was["rsi"]) * sign

    up, down = side(1), side(-1)
    out = last.withColumn("_up", up).withColumn("_down", down)
    kind = F.when(F.col("_up") > least, "bullish").when(F.col("_down") > least, "bearish")
    size = F.when(kind == "bullish", F.col("_up")).otherwise(F.col("_down"))
    return out.select("symbol", kind.alias("kind"), F.when(kind.isNotNull(), F.least(size / 20, F.lit(1.0))).alias("strength"))


def underlying_turns(bars: DataFrame, trend: DataFrame, n: int = 20) -> DataFrame:
    """Per symbol at its last bar what option signals are made of: boundary, divergence and macd (structs of kind and strength), direction, trend.

    The range whose ends count is that of the last n bars; trend: (symbol, date, direction, score).
    """
    w = series("symbol")
    lows = bars.select("symbol", "date", "close", F.min("low").over(w.rowsBetween(-(n - 1), 0)).alias("lower"), F.max("high").over(w.rowsBetween(-(n - 1), 0)).alias("upper"))
    hist = macd(bars, factor=2.0).select("symbol", "date", "hist", F.lag("hist").over(w).alias("_was"))
    price = bars.select("symbol", "date", "close").join(rsi_simple(bars), ["symbol", "date"])
    last = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    rebound, turn = boundary_rebound(F.col("close"), F.col("lower"), F.col("upper")), macd_turn(F.col("hist"), F.col("_was"))
    out = last.join(lows, ["symbol", "date"]).join(hist, ["symbol", "date"], "left").join(trend.select("symbol", "date", "direction", F.col("score").alias("trend")), ["symbol", "date"], "left")
    out = out.join(window_divergence(price).select("symbol", F.struct("kind", "strength").alias("divergence")), "symbol", "left")
    return out.select("symbol", "date", "close", F.struct(rebound["kind"].alias("kind"), rebound["strength"].alias("strength")).alias("boundary"), "divergence", F.struct(turn["kind"].alias("kind"), turn["strength"].alias("strength")).alias("macd"), "direction", "trend")


def option_signals(turns: DataFrame, greeks: DataFrame, sides: DataFrame, shift: float = 0.1, floor: float = 0.35) -> DataFrame:
    """(symbol, date, kind, turn, greeks, trend, strength, level): call and put signals of the underlyings' turns.

    turn is the weighted sum of the parts that are there, whatever their direction; a call needs one that is bullish, a
    put one that is bearish. greeks: (symbol, kind, score). sides: (symbol, side); a bullish underlying lowers the bar of
    calls by ``shift``, to ``floor`` at least, and raises that of puts; a bearish one the other way.
    """
    def part(name: str) -> Column:
        return F.coalesce(F.col(f"{name}.strength"), F.lit(0.0)) * WEIGHTS[name]

    most = WEIGHTS["boundary"] + WEIGHTS["divergence"] + WEIGHTS["macd"]
    turn = F.least(F.lit(most), part("boundary") + part("divergence") + part("macd"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(d).alias("toward")) for k, d in (("call", "bullish"), ("put", "bearish"))]))
    out = turns.join(sides, "symbol", "left").select("*", turn.alias("turn"), kinds.alias("k")).select("*", "k.kind", "k.toward").drop("k")
    toward = F.coalesce(F.col("boundary.kind") == F.col("kind"), F.lit(False)) | F.coalesce(F.col("divergence.kind") == F.col("toward"), F.lit(False)) | F.coalesce(F.col("macd.kind") == F.col("toward"), F.lit(False))
    out = out.filter((F.col("turn") > 0) & toward).join(greeks, ["symbol", "kind"], "left")
    trend = F.when(F.col("direction") == F.col("toward"), F.col("trend")).otherwise(0.0)
    out = out.withColumns({"greeks": F.coalesce("score", F.lit(0.0)), "trend": F.coalesce(trend, F.lit(0.0))})
    side = F.coalesce("side", F.lit("neutral"))
    bar = F.when(~side.isin("bullish", "bearish"), WEAK).when(side == F.col("toward"), max(floor, WEAK - shift)).otherwise(WEAK + shift)
    out = out.withColumn("strength", F.col("turn") + F.col("greeks") + F.col("trend")).filter(F.col("strength") >= bar)
    level = F.when(F.col("strength") >= STRONG, "strong").when(F.col("strength") >= MEDIUM, "medium").otherwise("weak")
    return out.select("symbol", "date", "kind", "turn", "greeks", "trend", "strength", level.alias("level"))


def option_range(rows: DataFrame) -> DataFrame:
    """rows (kind, price, spot, lower, upper, strike, delta, gamma, vega, iv, hv, minutes, trend) with option_lower, option_upper, change_up and change_down.

    The underlying's range, times the option's leverage (held within 4 and 10 times the range), is the base; the
    volatility's own move is a floor under it; delta with gamma and the vega of a move in volatility add to it. The
    option's own volatility, its trend (up, down) and being far out of the money correct it; moves end at .6 or .5.
    A missing delta follows from the moneyness, a missing gamma is .02, a missing vega .001; iv counts in percent between 5
    and 50 (below 5: a share), hv in percent.
    """
    call = F.col("kind") == "call"
    money = F.when(F.col("strike") > 0, F.col("spot") / F.col("strike")).otherwise(1.0)
    guess = F.when(F.col("strike").isNull(), 0.2).when(call, F.when(money < 0.95, 0.1).when(money < 0.98, 0.2).otherwise(0.3)).otherwise(F.when(money > 1.05, 0.1).when(money > 1.02, 0.2).otherwise(0.3))
    out = rows.withColumns({"_d": F.coalesce("delta", F.when(call, guess).otherwise(-guess)), "_gamma": F.coalesce("gamma", F.lit(0.02)), "_vega": F.coalesce("vega", F.lit(0.001))})
    iv = F.when(F.col("iv") < 5, F.col("iv") * 100).otherwise(F.col("iv"))
    spot = F.col("spot") > 0
    out = out.withColumns(
        {
            "_up": F.when(spot, (F.col("upper") - F.col("spot")) / F.col("spot")).otherwise(0.0),
            "_down": F.when(spot, (F.col("spot") - F.col("lower")) / F.col("spot")).otherwise(0.0),
            "_range": F.when(spot, (F.col("upper") - F.col("lower")) / F.col("spot")).otherwise(0.0),
            "_share": F.sqrt(F.col("minutes") / YEAR_MINUTES),
            "_iv": F.when((F.col("iv") > 0) & iv.between(5, 50), iv),
        }
    )
    size = F.abs("_d")
    curve = lambda x: 0.5 * F.col("_gamma") * F.col(x) * F.col(x)
    up = F.when(call, F.col("_d") * F.col("_up") + curve("_up")).otherwise(size * F.col("_down") + curve("_down"))
    down = F.when(call, -F.col("_d") * F.col("_down") + curve("_down")).otherwise(size * F.col("_up") + curve("_up"))
    vega = F.when(F.col("_vega") > 0, F.least(F.lit(0.2), F.col("_vega") * F.least(F.col("_range") * 100 / 2, F.lit(5.0)) / 100)).otherwise(0.0)
    lever = F.when((F.col("price") > 0) & spot, F.greatest(F.col("_range") * 4, F.least(size * F.col("_range") * F.col("spot") / F.col("price"), F.col("_range") * 10)))
    out = out.withColumns({"_a": F.abs(up), "_b": F.abs(down), "_v": vega, "_lever": F.when(lever > 0, lever), "_ivmove": size * F.col("_iv") / 100 * F.col("_share")})
    base = F.greatest("_lever", F.coalesce("_ivmove", F.lit(0.0)))

    def moved(x: str) -> Column:
        held = F.least(F.col(x), F.lit(0.30))
        return F.when(F.col("_lever").isNotNull(), base + F.least(F.col(x), F.lit(0.15)) + F.col("_v") * 1.5).when(F.col("_ivmove").isNotNull(), F.greatest(held, F.least(F.col("_ivmove"), F.lit(0.30))) + F.col("_v")).otherwise(held + F.col("_v"))

    out = out.withColumns({"_a": moved("_a"), "_b": moved("_b")})
    ratio = F.when((F.col("hv") > 0) & (F.col("_a") + F.col("_b") > 0), F.col("hv") / 100 * F.col("_share") / ((F.col("_a") + F.col("_b")) / 2))
    factor = F.when(ratio.isNull() | (ratio <= 0), 1.0).when(ratio > 1.3, F.least(F.lit(1.5), ratio)).when(ratio < 0.7, F.greatest(F.lit(0.7), ratio)).otherwise(1 + (ratio - 1) / 2)
    out = out.withColumn("_f", factor * F.when(size < 0.3, 1 + (0.3 - size) * 1.5).otherwise(1.0)).withColumn("_most", F.when(size < 0.3, 0.60).otherwise(0.50))
    lean = lambda rise, fall: F.when(F.col("trend") == "up", rise).when(F.col("trend") == "down", fall).otherwise(1.0)
    out = out.withColumns({"change_up": F.least("_most", F.col("_a") * F.col("_f") * lean(1.1, 0.9)), "change_down": F.least("_most", F.col("_b") * F.col("_f") * lean(0.9, 1.1))})
    least = F.lit(0.001)
    out = out.withColumn("option_upper", F.col("price") * (1 + F.col("change_up"))).withColumn("option_lower", F.greatest(least, F.col("price") * (1 - F.col("change_down"))))
    out = out.withColumn("option_lower", F.when(F.col("option_upper") <= F.col("option_lower"), F.greatest(least, F.col("option_upper") * 0.95)).otherwise(F.col("option_lower")))
    return out.select(*rows.columns, "option_lower", "option_upper", "change_up", "change_down")


def underlying_range(rows: DataFrame, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2), day: int = 240) -> DataFrame:
    """rows (price, atr, hv, band_upper, band_lower, intraday, minutes, sigma) with range_lower, range_upper and method, for what is left of a day of ``day`` minutes.

    sigma, a fitted model's deviation as a share of the price, decides where it is there. Else four ranges are averaged by
    ``weights``: 2 atr, hv (percent) over the rest of the day, the Bollinger band, and the bars' own deviation intraday
    (percent) over the rest of the day. Missing parts count as 1 percent, 1.5, 2 percent and 1.
    """
    price, left = F.col("price"), F.sqrt(F.greatest(F.col("minutes"), F.lit(0)) / day)
    moves = (F.coalesce("atr", price * 0.01) * 2, price * F.coalesce("hv", F.lit(1.5)) / 100 * left, None, price * F.coalesce("intraday", F.lit(1.0)) / 100 * left)
    upper = [F.coalesce("band_upper", price * 1.02) if m is None else price + m for m in moves]
    lower = [F.coalesce("band_lower", price * 0.98) if m is None else price - m for m in moves]
    blend = lambda ends: sum((x * w for x, w in zip(ends, weights, strict=True)), F.lit(0.0)) / sum(weights)
    fitted, move = F.col("sigma") > 0, price * F.col("sigma") * 1.96 * left
    return rows.withColumns({
        "range_lower": F.when(fitted, F.greatest(price - move, price * 0.8)).otherwise(blend(lower)),
        "range_upper": F.when(fitted, price + move).otherwise(blend(upper)),
        "method": F.when(fitted, "garch").otherwise("blend"),
    })
