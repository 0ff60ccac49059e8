"""Technical indicators on bars (symbol, date, open, high, low, close, volume).

Moving statistics are window expressions. The recursive averages (EMA, Wilder) run per symbol in one grouped pandas pass
that yields all of them, after one shuffle by symbol.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import back, crossed, full, series, sma


def recursive_averages(bars: DataFrame, specs: dict[str, tuple[str, float] | Callable[[pd.DataFrame], pd.Series]], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with exponentially weighted averages: name -> (column, alpha), seeded with the first value; or a function of the columns so far.

    A spec may name an earlier one, so that averages of averages take one pass. Nulls before the first value stay null;
    later ones carry the average on. A symbol's bars meet in one task.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        for name, spec in specs.items():
            pdf[name] = spec(pdf) if callable(spec) else pdf[spec[0]].ewm(alpha=spec[1], adjust=False, ignore_na=True).mean()
        return pdf

    schema = T.StructType([*bars.schema.fields, *(T.StructField(name, T.DoubleType()) for name in specs)])
    return bars.groupBy(*keys).applyInPandas(add, schema)


def moving_averages(bars: DataFrame, periods: list[int]) -> DataFrame:
    """Simple averages ma<n> of close, volume_ma of the first period, the arrangement of the first three, and the cross of the first two."""
    w = series("symbol")
    out = bars.select("symbol", "date", "close", "volume", *[sma("close", n, w).alias(f"ma{n}") for n in periods], sma("volume", periods[0], w).alias("volume_ma"))
    a, b, c = (F.col(f"ma{n}") for n in periods[:3])
    arrangement = F.when((a > b) & (b > c), "bull").when((a < b) & (b < c), "bear").when(c.isNotNull(), "mixed")
    return out.withColumn("arrangement", arrangement).withColumn("cross", crossed(f"ma{periods[0]}", f"ma{periods[1]}", w))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, factor: float = 1.0) -> DataFrame:
    """dif, dea, hist = factor * (dif - dea) (1 standard, 2 legacy), and the cross of dif and dea."""
    specs = {"ema_fast": ("close", 2 / (fast + 1)), "ema_slow": ("close", 2 / (slow + 1)), "dif": lambda x: x["ema_fast"] - x["ema_slow"], "dea": ("dif", 2 / (signal + 1))}
    out = recursive_averages(bars.select("symbol", "date", "close"), specs)
    return out.select("symbol", "date", "dif", "dea", (factor * (F.col("dif") - F.col("dea"))).alias("hist"), crossed("dif", "dea", series("symbol")).alias("cross"))


def rsi_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI by plain means of the last n gains and losses; 100 without losses, 50 without moves."""
    w = series("symbol")
    move = F.col("close") - F.lag("close").over(w)
    out = bars.select("symbol", "date", "close", F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))).alias("gain"), F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))).alias("loss"))
    out = out.withColumn("up", sma("gain", n, w)).withColumn("down", sma("loss", n, w))
    value = F.when((F.col("up") == 0) & (F.col("down") == 0), 50.0).when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("up") / F.col("down")))
    return out.select("symbol", "date", F.when(F.col("up").isNotNull(), value).alias("rsi"))


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI by Wilder's averages (alpha 1/n, seeded with the first move), from the n-th move on."""
    w = series("symbol")
    move = F.col("close") - F.lag("close").over(w)
    out = bars.select("symbol", "date", F.greatest(move, F.lit(0.0)).alias("gain"), F.greatest(-move, F.lit(0.0)).alias("loss"), move.isNotNull().alias("moved"), F.row_number().over(w).alias("at"))
    out = out.withColumn("gain", F.when(F.col("moved"), F.col("gain"))).withColumn("loss", F.when(F.col("moved"), F.col("loss")))
    out = recursive_averages(out, {"up": ("gain", 1 / n), "down": ("loss", 1 / n)})
    value = F.when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("up") / F.col("down")))
    return out.select("symbol", "date", F.when(F.col("at") > n, value).alias("rsi"))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, sample: bool = False) -> DataFrame:
    """Middle, upper, lower band, bandwidth in percent and %B (0.5 where the band is flat); the deviation divides by n, or n - 1."""
    w = series("symbol")
    deviation = (F.stddev_samp if sample else F.stddev_pop)("close")
    out = bars.select("symbol", "date", "close", sma("close", n, w).alias("middle"), full(deviation, n, w, F.col("close")).alias("_d"))
    out = out.withColumn("upper", F.col("middle") + k * F.col("_d")).withColumn("lower", F.col("middle") - k * F.col("_d"))
    flat = F.col("upper") == F.col("lower")
    percent_b = F.when(F.col("middle").isNotNull(), F.when(flat, 0.5).otherwise((F.col("close") - F.col("lower")) / (F.col("upper") - F.col("lower"))))
    return out.select("symbol", "date", "middle", "upper", "lower", ((F.col("upper") - F.col("lower")) / F.col("middle") * 100).alias("bandwidth"), percent_b.alias("percent_b"))


def true_range(bars: DataFrame) -> DataFrame:
    """bars with tr: the largest of high - low and the distances of both to the previous close."""
    was = F.lag("close").over(series("symbol"))
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was), F.abs(F.col("low") - was)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of the last n bars, and as a percentage of close."""
    out = true_range(bars).withColumn("atr", sma("tr", n, series("symbol")))
    return out.select("symbol", "date", "atr", (F.col("atr") / F.col("close") * 100).alias("natr"))


def kdj(bars: DataFrame, n: int = 9, m: int = 3) -> DataFrame:
    """K and D as averages of the raw stochastic value (alpha 1/m, from the first full window), J = 3K - 2D."""
    w = series("symbol")
    low, high = full(F.min("low"), n, w, F.col("low")), full(F.max("high"), n, w, F.col("high"))
    out = bars.select("symbol", "date", "close", low.alias("_low"), high.alias("_high"))
    out = out.withColumn("rsv", F.when(F.col("_high") > F.col("_low"), (F.col("close") - F.col("_low")) / (F.col("_high") - F.col("_low")) * 100).when(F.col("_high").isNotNull(), 50.0))
    out = recursive_averages(out.select("symbol", "date", "rsv"), {"k": ("rsv", 1 / m), "d": ("k", 1 / m)})
    return out.withColumn("j", 3 * F.col("k") - 2 * F.col("d")).select("symbol", "date", "k", "d", "j")


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """(typical - mean) / (0.015 * mean absolute deviation) of the last n typical prices; null where the deviation is 0."""
    w = series("symbol")
    out = bars.select("symbol", "date", ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("tp"))
    out = out.withColumn("mean", sma("tp", n, w)).withColumn("all", F.collect_list("tp").over(back(w, n)))
    deviation = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("mean"))) / n
    return out.withColumn("md", deviation).select("symbol", "date", F.when(F.col("md") > 0, (F.col("tp") - F.col("mean")) / (0.015 * F.col("md"))).alias("cci"))


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement by Wilder's averages: plus_di, minus_di, adx, and its strength (over 25 strong, under 20 weak)."""
    w = series("symbol")
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    out = true_range(bars).select("symbol", "date", F.when(up.isNotNull(), F.col("tr")).alias("tr"), F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)).alias("pdm"), F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)).alias("mdm"))
    total = lambda x: x["plus_di"] + x["minus_di"]
    specs = {
        "a": ("tr", 1 / n), "p": ("pdm", 1 / n), "m": ("mdm", 1 / n),
        "plus_di": lambda x: 100 * x["p"] / x["a"].where(x["a"] > 0), "minus_di": lambda x: 100 * x["m"] / x["a"].where(x["a"] > 0),
        "dx": lambda x: (100 * (x["plus_di"] - x["minus_di"]).abs() / total(x).where(total(x) > 0)).mask(total(x) == 0, 0.0), "adx": ("dx", 1 / n),
    }
    out = recursive_averages(out, specs)
    return out.select("symbol", "date", "plus_di", "minus_di", "adx", F.when(F.col("adx") > 25, "strong").when(F.col("adx") < 20, "weak").when(F.col("adx").isNotNull(), "medium").alias("strength"))


def key_levels(bars: DataFrame, window: int = 60, near: float = 0.035, most: int = 3) -> DataFrame:
    """Per symbol at its last bar: supports and resistances among the 20-bar mean, the hundreds around the close and the
    extremes of the window, within ``near`` of the close, nearest first; the nearest one where none is that near."""
    w = series("symbol")
    out = bars.select("symbol", "date", "close", sma("close", 20, w).alias("ma"), F.max("high").over(back(w, window)).alias("high"), F.min("low").over(back(w, window)).alias("low"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc())).alias("_n")).filter("_n = 1")
    all_ = F.array_distinct(F.filter(F.array("ma", F.floor(F.col("close") / 100) * 100.0, F.ceil(F.col("close") / 100) * 100.0, "high", "low"), lambda x: x.isNotNull() & (x > 0)))

    def side(keep):
        ranked = F.array_sort(F.transform(F.filter(all_, keep), lambda x: F.struct(F.abs(x - F.col("close")).alias("gap"), x.alias("level"))))
        close_by = F.filter(ranked, lambda x: x["gap"] <= near * F.col("close"))
        return F.transform(F.slice(F.when(F.size(close_by) > 0, close_by).otherwise(F.slice(ranked, 1, 1)), 1, most), lambda x: F.round(x["level"], 4))

    return out.select("symbol", "date", side(lambda x: x < F.col("close")).alias("supports"), side(lambda x: x > F.col("close")).alias("resistances"))


def divergence(bars: DataFrame, n: int = 20, gap: float = 5.0) -> DataFrame:
    """bullish where close is the low of the last n bars while its RSI is over that at the previous low by gap; bearish likewise at highs."""
    w = series("symbol")
    out = bars.select("symbol", "date", "close").join(rsi_simple(bars), ["symbol", "date"])
    frame = back(w, n - 1, 1)
    low, high = F.min(F.struct("close", "rsi")).over(frame), F.max(F.struct("close", "rsi")).over(frame)
    out = out.select("symbol", "date", "close", "rsi", low.alias("_low"), high.alias("_high"), F.count("rsi").over(frame).alias("_n"))
    kind = F.when(F.col("_n") < n - 1, "none").when((F.col("close") < F.col("_low.close")) & (F.col("rsi") > F.col("_low.rsi") + gap), "bullish").when((F.col("close") > F.col("_high.close")) & (F.col("rsi") < F.col("_high.rsi") - gap), "bearish").otherwise("none")
    return out.select("symbol", "date", kind.alias("divergence"))
