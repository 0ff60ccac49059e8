"""Bars: trades and ticks to OHLCV, cleaning, gaps and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import series


def ohlcv(trades: DataFrame, keys: list[str], bucket: Column, price: str, volume: str, order: list[str]) -> DataFrame:
    """(keys, date, open, high, low, close, volume, amount, trades) by bucket; first and last by the order columns.

    One aggregate with partial sums before its shuffle; the shuffle carries a row per task, key and bucket.
    """
    at = F.struct(*order)
    return trades.groupBy(*keys, bucket.alias("date")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"), F.sum(F.col(price) * F.col(volume)).alias("amount"), F.count("*").alias("trades"),
    )


def right_closed(ts: str, minutes: int) -> Column:
    """The right end of the interval (end - minutes, end] that holds ts."""
    micros = minutes * 60_000_000
    return F.timestamp_micros((F.ceil(F.unix_micros(F.col(ts).cast("timestamp")) / micros) * micros).cast("long"))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in the order. A maximum by key, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).select(*rows.columns)


def tail(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def missing_dates(bars: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """The calendar's dates within each key's span that its bars lack."""
    span = bars.groupBy(*keys).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    wanted = span.join(F.broadcast(calendar), (calendar["date"] >= span["_from"]) & (calendar["date"] <= span["_to"])).select(*keys, "date")
    return wanted.join(bars.select(*keys, "date"), [*keys, "date"], "left_anti")


def weekdays(bars: DataFrame) -> DataFrame:
    """(date): the weekdays between the first and the last bar; a calendar has a few hundred rows a year."""
    ends = bars.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("date")).filter(F.weekday("date") < 5)


def fill(bars: DataFrame, x: str, limit: int, *keys: str) -> Column:
    """x, carried forward at most ``limit`` rows, then back at most ``limit``."""
    w = series(*keys)
    ahead = F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))
    return F.coalesce(ahead, F.first(x, ignorenulls=True).over(w.rowsBetween(0, limit)))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: list[str], days: int | None = None) -> DataFrame:
    """left with the latest right row at or before ``at`` (within ``days``, if given), by one sort of both sides together."""
    rest = [c for c in left.columns if c not in (key, at)]
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest]
    marks = right.select(key, at, *empty, F.struct(F.col(at).alias("at"), *value).alias("_seen"), F.lit(0).alias("_left"))
    asks = left.select(key, at, *rest, F.lit(None).cast(marks.schema["_seen"].dataType).alias("_seen"), F.lit(1).alias("_left"))
    w = Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    found = asks.unionByName(marks).withColumn("_seen", F.last("_seen", ignorenulls=True).over(w)).filter("_left = 1")
    near = F.lit(True) if days is None else F.col("_seen.at") >= F.col(at) - F.expr(f"INTERVAL {days} DAYS")
    return found.select(*left.columns, *[F.when(near, F.col("_seen")[v]).alias(v) for v in value], F.when(near, F.col("_seen.at")).alias("matched_at"))
