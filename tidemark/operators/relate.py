"""Joins in time, comparisons of sets and of runs, fills and summaries of the last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, safe_ratio
from ..functions.windows import series


def with_next(bars: DataFrame, *columns: str) -> DataFrame:
    """Each bar with the date and the given columns (next_...) of the symbol's next one; its last bar has none and is left out."""
    w = series("symbol")
    out = bars.withColumns({"next_date": F.lead("date").over(w), **{f"next_{c}": F.lead(c).over(w) for c in columns}})
    return out.filter("next_date IS NOT NULL")


def nearest_in_time(rows: DataFrame, by: list[str], ts: str, minute: int, tie: list[str]) -> DataFrame:
    """Of each key the row whose time of day is nearest to a minute of the day, the earliest by ``tie`` if several are."""
    off = F.abs(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) - minute * 60)
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(off, *tie)).alias("_x")).select(*by, "_x.*")


def recent(asks: DataFrame, facts: DataFrame, key: str, ts: str, minutes: int, id_: str, value: str) -> DataFrame:
    """asks (key, ts, id) with n, the number of facts of their key in the minutes up to them, and last, the value of the latest.

    Both sides are joined on the key and a stretch of that many minutes: a fact can matter in its own stretch and the next.
    """
    size = minutes * 60
    stretch = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / size)
    x = asks.withColumn("_s", stretch(ts))
    y = facts.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col(id_).alias("_id"), F.col(value).alias("_v"), F.explode(F.array(stretch(ts), stretch(ts) + 1)).alias("_in"))
    near = (x[key] == y["_k"]) & (x["_s"] == y["_in"]) & (y["_t"] <= x[ts]) & (y["_t"] > x[ts] - F.expr(f"INTERVAL {minutes} MINUTES"))
    out = x.join(y, near, "left")
    return out.groupBy(*[x[c] for c in asks.columns]).agg(F.count("_id").alias("n"), F.max_by("_v", F.struct("_t", "_id")).alias("last"))


def fill_gaps(bars: DataFrame, x: str, limit: int = 5) -> DataFrame:
    """x filled from at most ``limit`` rows before, then from as many after."""
    w = series("symbol")
    forward = F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))
    out = bars.withColumn("_f", forward)
    return out.withColumn(x, F.first("_f", ignorenulls=True).over(w.rowsBetween(0, limit))).drop("_f")


def last_summary(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, rows, first, last, change): the first and last close of each symbol's last n bars, and the change in percent."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last = bars.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    out = last.groupBy("symbol").agg(F.count("*").alias("rows"), F.max_by("close", "_n").alias("first"), F.min_by("close", "_n").alias("last"))
    return out.withColumn("change", safe_ratio(F.col("last") - F.col("first"), F.col("first")) * 100)


def extreme_divergence(bars: DataFrame, x: str, y: str, n: int, least: float) -> DataFrame:
    """bottom where x is at its least of n bars while y is ``least`` over the y of the bar with the least x before; top the other way; else none."""
    w = series("symbol").rowsBetween(-(n - 1), -1)
    at_low, at_high = F.min_by(y, F.struct(x, "date")).over(w), F.max_by(y, F.struct(x, "date")).over(w)
    full = F.count(x).over(w) == n - 1
    bottom = full & (F.col(x) <= F.min(x).over(w)) & (F.col(y) >= at_low + least)
    top = full & (F.col(x) >= F.max(x).over(w)) & (F.col(y) <= at_high - least)
    return bars.withColumn("divergence", F.when(bottom, "bottom").when(top, "top").otherwise("none"))


def min_max(x: str, by: list[str]) -> Column:
    """x between its least and greatest value in the group, from 0 to 1; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, clamp((F.col(x) - low) / (high - low), 0.0, 1.0)).otherwise(0.5)


def top_sets(rows: DataFrame, by: list[str], score: str, item: str, k: int) -> DataFrame:
    """(by, items): the k items of the highest score, ties by item; partial lists of at most k are merged, so no group is held whole."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(item))
    top = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item]).alias("items"))


def turnover(sets: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """Each set with kept (items that the one before has too), turnover (1 - kept / k; 0 for the first) and its label."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    was = F.lag("items").over(w)
    out = sets.withColumn("_was", was).withColumn("kept", F.size(F.array_intersect("items", F.coalesce("_was", F.array().cast("array<string>")))))
    out = out.withColumn("turnover", F.when(F.col("_was").isNull(), 0.0).otherwise(1 - F.col("kept") / k)).drop("_was")
    return out.withColumn("label", F.when(F.col("turnover") < 0.3, "stable").when(F.col("turnover") < 0.6, "normal").otherwise("fast"))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys of either side: both, left or right; one full join of distinct keys."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").select(key, F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both").alias("side"))


def first_distinct(rows: DataFrame, by: list[str], item: str, order: list[str], most: int) -> DataFrame:
    """(by, place, item): the first ``most`` different items in order of their first appearance."""
    first = rows.groupBy(*by, item).agg(F.min(F.struct(*order)).alias("_at"))
    w = Window.partitionBy(*by).orderBy("_at")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(*by, "place", item)


def method_performance(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of predictions (lower, upper, base, confidence, hit): number, hit rate, widths in percent of the base (mean, least, greatest, population deviation), mean confidence, and how near the mean width is to the real one (real)."""
    width = (F.col("upper") - F.col("lower")) / F.col("base") * 100
    out = rows.withColumn("_w", F.when(F.col("base") > 0, width)).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("_w").alias("mean_width"), F.min("_w").alias("min_width"), F.max("_w").alias("max_width"),
        F.stddev_pop("_w").alias("width_dev"), F.avg("confidence").alias("confidence"), F.avg("real").alias("_real"),
    )
    return out.withColumn("calibration", 1 - F.least(F.lit(1.0), F.abs(safe_ratio(F.col("mean_width"), F.col("_real")) - 1))).drop("_real")


def daily_fields(rows: DataFrame, by: list[str], value: str, ts: str, id_: str, minute: int = 900) -> DataFrame:
    """(by, n, mean, median, close, last): of each key's values their number, mean, median, the one nearest to the close and the last."""
    off = F.abs(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) - minute * 60)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min_by(value, F.struct(off, ts, id_)).alias("close"), F.max_by(value, F.struct(ts, id_)).alias("last"))
