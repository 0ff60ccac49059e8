"""Snapshots and the scores that read them: index features, margin, sectors, opening strength, rule predictors, near-the-money volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, safe_ratio, sigmoid
from ..functions.windows import full, pct_change, series, sma
from .bars import tail
from .indicators import macd


def index_features(bars: DataFrame, returns: tuple[int, ...] = (5, 10, 20, 60), ranked: tuple[int, ...] = (10, 20), window: int = 500, least: int = 20) -> DataFrame:
    """(symbol, date, close, ret<k>, ret<k>_percentile, volume_ratio) at each symbol's last bar.

    A percentile is the share of the last ``window`` values of that return, the present one among them, that are no larger,
    in percent; null with fewer than ``least`` of them. volume_ratio is the volume over the mean of the last five, from six bars on.
    """
    w = series("symbol")
    out = bars.select("symbol", "date", "close", "volume", F.row_number().over(w).alias("_i"), *[pct_change("close", k, w).alias(f"ret{k}") for k in returns], F.avg("volume").over(w.rowsBetween(-4, 0)).alias("_v"))
    last = tail(out, ["symbol"], "date", 1)
    last = last.withColumn("volume_ratio", F.when((F.col("_i") >= 6) & (F.col("_v") != 0), F.col("volume") / F.col("_v")))
    for k in ranked:
        past = tail(out.filter(F.col(f"ret{k}").isNotNull()), ["symbol"], "date", window).join(last.select("symbol", F.col(f"ret{k}").alias("_now")), "symbol")
        share = past.groupBy("symbol").agg(F.when((F.count("*") >= least), F.avg((F.col(f"ret{k}") <= F.col("_now")).cast("int")) * 100).alias(f"ret{k}_percentile"))
        last = last.join(share, "symbol", "left")
    return last.select("symbol", "date", "close", *[f"ret{k}" for k in returns], *[f"ret{k}_percentile" for k in ranked], "volume_ratio")


def margin_change(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, margin_total, margin_change, margin_proxy, status) of rows (by, date, total, financing), one for each market and day.

    Markets are added up by day (null where none has a value); the totals count, or the financing where no day has a
    total. The change is that of the last two days with a value; the proxy is ten times it, within .3.
    """
    def added(c: str) -> Column:
        return F.when(F.count(c) > 0, F.sum(c)).alias(c)

    days = rows.groupBy(*by, "date").agg(added("total"), added("financing"))
    any_total = F.count("total").over(Window.partitionBy(*by)) > 0
    days = days.withColumn("m", F.when(any_total, F.col("total")).otherwise(F.col("financing"))).filter("m IS NOT NULL")
    w = Window.partitionBy(*by).orderBy("date")
    last = days.withColumns({"was": F.lag("m").over(w), "_n": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))}).filter("_n = 1")
    change = safe_ratio(F.col("m") - F.col("was"), F.col("was"))
    return last.select(*by, F.col("m").alias("margin_total"), F.round(change, 6).alias("margin_change"), F.round(clamp(change * 10, -0.3, 0.3), 6).alias("margin_proxy"), F.when(change.isNotNull(), "info").otherwise("degraded").alias("status"))


def sector_change(rows: DataFrame, by: list[str], keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """(by, *keywords): mean change of the sectors (name, change) whose name has one of a group's keywords; changes beyond 1 are percent."""
    share = F.when(F.abs("change") > 1, F.col("change") / 100).otherwise(F.col("change"))

    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | F.col("name").contains(word)
        return out

    return rows.groupBy(*by).agg(*[F.avg(F.when(has(words), share)).alias(k) for k, words in keywords.items()])


def sector_leaders(rows: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """(by, leaders, leadership): the k named sectors of the greatest change (ties: by name), and their mean change."""
    share = F.when(F.abs("change") > 1, F.col("change") / 100).otherwise(F.col("change"))
    named = rows.withColumn("_s", share).filter(F.col("_s").isNotNull() & (F.trim("name") != ""))
    top = named.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_s"), "name"))).filter(F.col("_n") <= k)
    return top.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("leaders"), F.round(F.avg("_s"), 6).alias("leadership"))


def limit_ups(rows: DataFrame, by: list[str], small: tuple[str, ...] = ("300", "301", "002", "003", "000"), science: tuple[str, ...] = ("688",)) -> DataFrame:
    """(by, count, small_ratio, science_ratio) of limit-up codes, by their prefixes."""
    def share(prefixes: tuple[str, ...]) -> Column:
        return F.round(F.avg(F.substring("code", 1, 3).isin(*prefixes).cast("int")), 4)

    return rows.groupBy(*by).agg(F.count("*").alias("count"), share(small).alias("small_ratio"), share(science).alias("science_ratio"))


def style_spread(bars: DataFrame, first: str, second: str, n: int = 60, window: int = 1250, least: int = 250) -> DataFrame:
    """(spread, percentile): the n-bar return of one symbol less another's, on their common dates, and its place among the last ``window``; the percentile needs more than ``least`` common dates."""
    a, b = (bars.filter(F.col("symbol") == s).select("date", F.col("close").alias(c)) for s, c in ((first, "x"), (second, "y")))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date, not for each bar
    both = a.join(b, "date").withColumns({"s": F.col("x") / F.lag("x", n).over(w) - F.col("y") / F.lag("y", n).over(w), "i": F.row_number().over(w)})
    last = both.agg(F.max_by("s", "date").alias("now"), F.max("i").alias("dates"))
    past = both.filter("s IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))).filter(F.col("_n") <= window)
    share = past.crossJoin(F.broadcast(last)).agg(F.first("now").alias("now"), F.first("dates").alias("dates"), F.avg((F.col("s") <= F.col("now")).cast("int")).alias("p"), F.count("*").alias("n"))
    return share.select(F.round("now", 6).alias("spread"), F.when((F.col("dates") > least) & (F.col("n") >= 20), F.round(F.col("p") * 100, 4)).alias("percentile"))


def macro_proxy(pmi: Column, cpi: Column, credit: Column, lag_days: Column) -> dict[str, Column]:
    """score and weight of growth, inflation and credit; readings 5 days old count half, beyond 15 days nothing."""
    growth = F.when(pmi >= 50, 0.3).when(pmi < 50, -0.2).otherwise(0.0)
    inflation = F.when(cpi <= 2, 0.2).when(cpi >= 3, -0.1).otherwise(0.0)
    money = F.when(credit > 0, 0.3).when(credit <= 0, -0.1).otherwise(0.0)
    return {"score": F.round(growth + inflation + money, 4), "weight": F.when(lag_days < 5, 1.0).when(lag_days <= 15, 0.5).otherwise(0.0)}


def flow_score(net: Column, large: float = 1e5, of: float = 5e9, small: float = 50.0) -> Column:
    """A net inflow from -1 to 1: of 5e9 where it is given in units (beyond 1e5), else of 50."""
    return F.round(F.when(F.abs(net) > large, clamp(net / of, -1.0, 1.0)).otherwise(clamp(net / small, -1.0, 1.0)), 4) + 0.0  # no negative zero


# --- rule predictors


def leading_sector_score(bank: Column, non_bank: Column, petro: Column, ret10: Column, volume_ratio: Column) -> Column:
    """Pulled by heavy sectors, against ten-day moves on thin volume, with small momentum; missing inputs are neutral."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r, thin = zero(ret10), F.coalesce(volume_ratio, F.lit(1.0)) < 0.8
    back = F.when(thin & (r > 0.05), -0.15).when(thin & (r < -0.03), 0.10).otherwise(0.0)
    move = F.when(r > 0.02, 0.08).when(r < -0.02, -0.05).otherwise(0.0)
    return (zero(bank) * 0.35 + zero(non_bank) * 0.25 + zero(petro) * 0.15) * 0.5 + back * 0.3 + move * 0.2


def industry_score(industry: Column, limit_count: Column, ret10: Column) -> Column:
    """The leading industries' change, against many limit-ups, with the index's momentum."""
    n, r = F.coalesce(limit_count, F.lit(0.0)), F.coalesce(ret10, F.lit(0.0))
    heat = F.when(n >= 70, -0.08).when(n >= 40, -0.04).when(n <= 10, 0.04).otherwise(0.0)
    return F.coalesce(industry, F.lit(0.0)) * 0.5 + heat * 0.3 + F.when(r > 0.03, 0.10).when(r < -0.03, -0.05).otherwise(0.0) * 0.2


def science_score(model: Column, limit_ratio: Column, ret10: Column, leadership: Column) -> Column:
    """A fitted model's score, the share of limit-ups, momentum and sector leadership."""
    q, r = F.coalesce(limit_ratio, F.lit(0.0)), F.coalesce(ret10, F.lit(0.0))
    mood = F.when(q > 0.12, -0.10).when(q < 0.04, 0.05).otherwise(0.0)
    move = F.when(r > 0.03, 0.10).when(r < -0.03, -0.10).otherwise(0.0)
    return clamp(F.coalesce(model, F.lit(0.0)), -1.0, 1.0) * 0.4 + mood * 0.3 + move * 0.2 + clamp(F.coalesce(leadership, F.lit(0.0)), -0.2, 0.2) * 0.1


def small_cap_score(ret10: Column, ret5: Column, limit_ratio: Column, margin: Column, flow: Column, model: Column) -> Column:
    """Back from ten-day moves, with sentiment, margin, five-day momentum, flows, and a fitted model's score where there is one."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r10, r5, q = zero(ret10), zero(ret5), zero(limit_ratio)
    back = F.when(r10 > 0.08, -0.35).when(r10 > 0.04, -0.20).when(r10 < -0.08, 0.35).when(r10 < -0.04, 0.20).otherwise(0.0)
    mood = F.when(q > 0.25, -0.15).when(q > 0.18, -0.08).otherwise(0.0)
    move = F.when(r5 > 0.02, -0.05).when(r5 < -0.02, 0.05).otherwise(0.0)
    return back * 0.45 + mood * 0.2 + clamp(zero(margin), -0.1, 0.1) * 0.1 + move * 0.1 + clamp(zero(flow) * 0.15, -0.08, 0.08) * 0.05 + zero(model) * 0.2


#: Fixed names of events and the pattern that finds each in lower-case text, and their share of risk.
EVENTS = {
    "boj": (r"\bboj\b|bank of japan", 0.25), "japan_cpi": (r"japan cpi", 0.18), "japan_gdp": (r"japan gdp", 0.18), "tankan": (r"tankan", 0.18), "fomc": (r"\bfomc\b|federal reserve", 0.25),
    "us_cpi": (r"us cpi", 0.25), "us_jobs": (r"\bnfp\b|nonfarm payroll", 0.25), "china_gdp": (r"china gdp", 0.25), "china_pmi": (r"china pmi", 0.18),
}


def event_gate(text: Column) -> dict[str, Column]:
    """events (names found in a text, in the order of the list, eight at most) and risk (their shares, .8 at most)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.slice(F.filter(F.array(*[F.when(low.rlike(p), F.struct(F.lit(k).alias("name"), F.lit(r).alias("risk"))) for k, (p, r) in EVENTS.items()]), lambda x: x.isNotNull()), 1, 8)
    risk = F.aggregate(found, F.lit(0.0), lambda s, x: s + x["risk"])
    return {"events": F.transform(found, lambda x: x["name"]), "risk": F.round(F.least(F.lit(0.8), risk), 4)}


def overnight_forecast(rows: DataFrame) -> DataFrame:
    """rows (futures, premium, converging, triggers, calendar_risk, index_ret, rsi, deviation, premium_bad, base, base_n) with p_up and direction.

    Futures by tanh, a discount that tends to reopen higher, and events make a score; its probability shrinks towards .5
    by the event risk, and is blended with the share of higher openings of the last ``base_n`` days from 18 days on.
    Within .018 of .5 the direction is flat.
    """
    c = F.col
    prem = c("premium")
    value = F.when(prem <= -1.2, clamp(F.abs(prem) / 11, 0.0, 0.42)).otherwise(0.0) - F.when(prem >= 2, 0.11).otherwise(0.0) + F.when(F.coalesce("converging", F.lit(False)) & (prem < -1), 0.11).otherwise(0.0)
    n = F.coalesce("triggers", F.lit(0))
    drop, hot = F.coalesce(c("index_ret") <= -1.5, F.lit(False)), F.coalesce(c("index_ret") >= 1.5, F.lit(False))
    events = clamp(-F.least(F.lit(0.16), 0.028 * n) + F.when(drop, 0.05).when(hot, -0.045).otherwise(0.0), -0.8, 0.8)
    lift = F.when(drop, 0.12).otherwise(0.0) + F.when((c("rsi") >= 70) | (c("rsi") <= 30), 0.08).otherwise(0.0) + F.when(F.abs("deviation") >= 5, 0.08).otherwise(0.0) + F.when(F.coalesce("premium_bad", F.lit(False)), 0.08).otherwise(0.0)
    risk = clamp(F.coalesce("calendar_risk", F.lit(0.0)) + F.least(F.lit(0.26), lift), 0.0, 0.96)
    score = 0.38 * F.coalesce(F.tanh(c("futures") / 1.5), F.lit(0.0)) + 0.22 * clamp(value, -0.5, 0.55) + 0.25 * events
    shrunk = clamp(0.5 + (1 - 0.62 * risk) * (sigmoid(1.35 * score) - 0.5), 0.001, 0.999)
    weight = F.when(c("base").isNotNull() & (c("base_n") >= 18), 0.24 * F.least(F.lit(1.0), (c("base_n") - 12) / 48)).otherwise(0.0)
    p = clamp((1 - weight) * shrunk + weight * F.coalesce("base", F.lit(0.0)), 0.001, 0.999)
    out = rows.withColumns({"event_risk": risk, "p_up": p})
    return out.withColumn("direction", F.when(F.abs(F.col("p_up") - 0.5) < 0.018, "flat").when(F.col("p_up") >= 0.5, "up").otherwise("down"))


# --- openings and short-term signals


def opening_strength(bars: DataFrame, n: int = 5, threshold: float = 0.5) -> DataFrame:
    """(symbol, date, change, volume_dev, history_dev, score, strength) of bars that have one before: the opening against the close before, and both it and the volume against the mean of the n bars before."""
    w = series("symbol")
    out = bars.withColumn("change", safe_ratio(F.col("open") - F.lag("close").over(w), F.lag("close").over(w)) * 100)
    before = w.rowsBetween(-n, -1)
    out = out.withColumns({"_c": F.avg("change").over(before), "_v": F.avg("volume").over(before)}).filter("change IS NOT NULL")
    out = out.withColumns({"volume_dev": F.coalesce(F.when(F.col("_v") > 0, F.col("volume") / F.col("_v") - 1), F.lit(0.0)), "history_dev": F.col("change") - F.coalesce("_c", F.lit(0.0))})
    out = out.withColumn("score", clamp(F.col("change") / 2, -1.0, 1.0) * 0.5 + F.col("volume_dev") * 0.3 + F.col("history_dev") / 2 * 0.2)
    return out.select("symbol", "date", "change", "volume_dev", "history_dev", "score", F.when(F.col("score") > threshold, "strong").when(F.col("score") < -threshold, "weak").otherwise("neutral").alias("strength"))


def short_term_signals(daily: DataFrame, intraday: DataFrame, least: float = 0.6, loud: float = 1.2) -> DataFrame:
    """(symbol, day, signal, strength, position, stop_loss, take_profit): daily (symbol, date, close) gives the trend by its 20-bar mean, the last intraday bar (symbol, date, close, volume) of the day its confirmation.

    Bullish: within 1 percent of its 10-bar mean, or under it, rising on volume of ``loud`` times the mean; bearish: near the
    mean or over it, falling. MACD turns and louder volume add strength, up to .85; signals under ``least`` are none.
    """
    w = series("symbol")
    turn = macd(daily, factor=2.0).select("symbol", "date", F.col("hist"), F.lag("hist").over(w).alias("was"))
    trend = daily.select("symbol", "date", "close", sma("close", 20, w).alias("ma20")).join(turn, ["symbol", "date"]).filter("ma20 IS NOT NULL")
    fine = intraday.select("symbol", F.to_date("date").alias("day"), "date", F.col("close").alias("price"), F.lag("close").over(w).alias("before"), sma("close", 10, w).alias("ma10"), (F.col("volume") / sma("volume", 10, w)).alias("ratio"))
    fine = fine.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "day").orderBy(F.desc("date")))).filter("_n = 1 AND ma10 > 0").drop("date", "_n")
    out = trend.join(fine, (trend["symbol"] == fine["symbol"]) & (F.to_date(trend["date"]) == fine["day"])).select(trend["symbol"], "day", "close", "ma20", "hist", "was", "price", "before", "ma10", "ratio")
    c = F.col
    near = F.abs(c("price") - c("ma10")) / c("ma10") < 0.01
    buy = (c("close") > c("ma20")) & (near | (c("price") < c("ma10"))) & (c("price") > c("before")) & (c("ratio") >= loud)
    sell = (c("close") < c("ma20")) & (near | (c("price") > c("ma10"))) & (c("price") < c("before"))
    golden, death = (c("was") < 0) & (c("hist") > 0), (c("was") > 0) & (c("hist") < 0)
    extra = lambda test, v: F.when(F.coalesce(test, F.lit(False)), v).otherwise(0.0)
    strength = F.when(buy, F.least(F.lit(0.85), 0.6 + extra(golden, 0.1) + extra(c("ratio") > 1.3, 0.05) + extra(c("ratio") > 1.5, 0.1))).when(sell, 0.6 + extra(death, 0.1))
    out = out.withColumns({"signal": F.when(buy, "buy").when(sell, "sell"), "strength": strength}).filter(F.col("strength") >= least)
    position = F.when(c("strength") >= 0.75, 0.65).when(c("strength") >= 0.65, 0.4).otherwise(0.1)
    return out.select("symbol", "day", "signal", "strength", position.alias("position"), (c("ma20") * 0.95).alias("stop_loss"), (c("close") * 1.03).alias("take_profit"))


def candidate(signal: Column, strength: Column, confidence: Column) -> dict[str, Column]:
    """direction, score (-1 to 1) and confidence of a provider's signal: its type by words, its strength by words or numbers (beyond 1: percent)."""
    s, word = F.lower(F.trim(F.coalesce(signal, F.lit("")))), F.lower(F.trim(strength))
    long = s.isin("buy", "long", "call", "b", "long_signal", "trend_follow", "trend_following") | (s.contains("trend") & s.contains("follow"))
    direction = F.when(long, "long").when(s.isin("sell", "short", "put", "short_signal"), "short").otherwise("neutral")
    number = word.try_cast("double")
    size = F.when(number.between(-1, 1), number).when(number.isNotNull(), clamp(number / 100, -1.0, 1.0)).when(word.isin("high", "strong"), 0.75).when(word.isin("medium", "mid"), 0.5).when(word.isin("low", "weak"), 0.25).otherwise(0.0)
    sure = clamp(F.coalesce(confidence, F.lit(0.35)), 0.0, 1.0)
    size = F.abs(F.when(size != 0, size).otherwise(sure))
    return {"direction": direction, "score": F.when(direction == "long", size).when(direction == "short", -size).otherwise(0.0), "confidence": F.when(sure > 0, sure).otherwise(0.35)}


def etf_consistency(pairs: DataFrame, n: int = 20, most: float = 0.5) -> DataFrame:
    """pairs (symbol, date, price, index_price) with ratio, deviation (percent, from the mean ratio of the n rows before) and signal: trend_follow where it is no more than ``most``.

    The rule that this follows takes the present ratio as its own baseline, so that nothing ever deviates; here the baseline is the past.
    """
    w = series("symbol")
    out = pairs.withColumn("ratio", safe_ratio(F.col("index_price"), F.col("price")))
    base = full(F.avg("ratio"), n, w, F.col("ratio"), skip=1)
    out = out.withColumn("deviation", F.abs(safe_ratio(F.col("ratio") - base, base)) * 100)
    return out.withColumn("signal", F.when(F.col("deviation") <= most, "trend_follow"))


def near_money_volatility(options: DataFrame, as_of: str = "day", least_days: int = 7) -> DataFrame:
    """(underlying, day, expiry, strike, iv, iv_30d) of options (underlying, day, spot, expiry, kind, strike, iv).

    The first expiry at least ``least_days`` off that has calls; of its calls' strikes the one nearest to the spot (ties: the
    lower); iv is the mean of its call and put, or the one there is. iv_30d scales it by sqrt(days / 30), for 30 days or more.
    """
    days = F.date_diff("expiry", as_of)
    far = options.withColumn("days", days).filter(F.col("days") >= least_days)
    keys = ["underlying", as_of]
    front = far.filter("kind = 'call'").groupBy(*keys).agg(F.min("expiry").alias("expiry"))
    rows = far.join(front, [*keys, "expiry"])
    strike = rows.filter("kind = 'call'").groupBy(*keys).agg(F.min(F.struct(F.round(F.abs(F.col("strike") - F.col("spot")), 10).alias("gap"), "strike"))["strike"].alias("strike"))
    mean = rows.join(strike, [*keys, "strike"]).groupBy(*keys, "expiry", "strike", "days").agg(F.avg(F.when(F.col("kind") == "call", F.col("iv"))).alias("c"), F.avg(F.when(F.col("kind") == "put", F.col("iv"))).alias("p"))
    iv = F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), (F.col("c") + F.col("p")) / 2).otherwise(F.coalesce("c", "p"))
    out = mean.withColumn("iv", iv)
    return out.select(*keys, "expiry", "strike", "iv", F.when(F.col("days") >= 30, F.col("iv") * F.sqrt(F.col("days") / 30)).alias("iv_30d"))


#: Fixed grades of liquidity: the widest spread in percent, the least size on both sides.
GRADES = {"excellent": (0.5, 100), "good": (1.5, 50), "fair": (4.0, 15), "poor": (8.0, 8)}


def liquidity_grade(spread: Column, depth: Column, imbalance: Column, estimated: Column) -> dict[str, Column]:
    """grade (critical where none fits), tradable and score (0 to 100, 50 at most for estimated quotes) of a quote."""
    grade = F.lit("critical")
    for name, (widest, least) in reversed(GRADES.items()):
        grade = F.when((spread <= widest) & (depth >= least), name).otherwise(grade)
    raw = F.greatest(F.lit(0.0), 100 - spread * 10) * 0.4 + F.least(F.lit(100.0), depth / 2) * 0.4 + (1 - imbalance) * 100 * 0.2
    score = clamp(F.round(raw, 1), 0.0, 100.0)
    return {"grade": grade, "tradable": grade != "critical", "score": F.when(estimated, F.least(F.lit(50.0), score)).otherwise(score)}
