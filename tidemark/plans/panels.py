"""Input panels of the queries, and the queries on bars: resampling, cleaning, gaps, completeness, as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import bars as B

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly OHLCV bars of the lines of each brand."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    week = F.date_trunc("week", "l_shipdate").cast("date")
    return B.ohlcv(lines.join(parts, "l_partkey"), ["symbol"], week, "price", "l_quantity", ORDER)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars of the lines of each return flag."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity", F.col("l_returnflag").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return B.ohlcv(lines, ["symbol"], F.col("l_shipdate").cast("date"), "price", "l_quantity", ORDER)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id", "user_id")


#: The same panels for DuckDB: w (weekly), b (daily).
_AT = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_OHLCV = f"arg_min(price, {_AT}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {_AT}) AS close, sum(l_quantity) AS volume, sum(price * l_quantity) AS amount, count(*) AS trades"
W = f"w AS (SELECT symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_OHLCV} FROM (SELECT p_brand AS symbol, l_extendedprice / l_quantity AS price, l.* FROM lineitem l JOIN part ON l_partkey = p_partkey) GROUP BY ALL)"
D = f"b AS (SELECT symbol, CAST(l_shipdate AS DATE) AS date, {_OHLCV} FROM (SELECT l_returnflag AS symbol, l_extendedprice / l_quantity AS price, l.* FROM lineitem l) GROUP BY ALL)"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_BAR = "symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 2) AS volume, round(amount, 2) AS amount, trades"


@query("e16_ohlcv_weekly", f"WITH {W} SELECT {_BAR} FROM w")
def ohlcv_weekly(spark, sf_dir):
    return rounded(rounded(weekly_bars(spark, sf_dir), 6, "open", "high", "low", "close"), 2, "volume", "amount")


@query("e16_ohlcv_daily", f"WITH {D} SELECT {_BAR} FROM b")
def ohlcv_daily(spark, sf_dir):
    return rounded(rounded(daily_bars(spark, sf_dir), 6, "open", "high", "low", "close"), 2, "volume", "amount")


@query(
    "i4_minute_bars_30",
    """SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTES, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTES AS date,
       arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume, count(*) AS trades
       FROM events GROUP BY ALL""",
)
def minute_bars(spark, sf_dir):
    """Half-hour bars, closed and labelled at the right."""
    out = B.ohlcv(ticks(spark, sf_dir), ["symbol"], B.right_closed("ts", 30), "price", "volume", ["ts", "event_id"])
    return out.drop("amount").withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    "b2_close_series",
    """SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, row(ts, event_id)) AS close FROM events GROUP BY ALL""",
)
def close_series(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("symbol", F.col("ts").cast("date").alias("date"), "ts", "event_id", F.col("price").alias("close"))
    return B.keep_last(rows, ["symbol", "date"], [F.col("ts"), F.col("event_id")]).select("symbol", "date", "close")


@query("b3_tail", f"WITH {W} SELECT symbol, date, round(close, 6) AS close FROM w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 120")
def tail_rows(spark, sf_dir):
    return rounded(B.tail(weekly_bars(spark, sf_dir), ["symbol"], "date", 120).select("symbol", "date", "close"), 6, "close")


@query(
    "a4_missing_dates",
    f"""WITH {D}, s AS (SELECT symbol, min(date) AS a, max(date) AS z FROM b GROUP BY symbol),
    c AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM b), (SELECT max(date) FROM b), INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT s.symbol, c.date FROM s JOIN c ON c.date BETWEEN s.a AND s.z WHERE isodow(c.date) < 6 AND NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = s.symbol AND b.date = c.date)""",
)
def missing(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).select("symbol", "date")
    return B.missing_dates(bars, B.weekdays(bars), ["symbol"])


@query(
    "a17_completeness",
    f"""WITH {D}, s AS (SELECT symbol, min(date) AS a, max(date) AS z, count(*) FILTER (isodow(date) < 6) AS n FROM b GROUP BY symbol),
    c AS (SELECT symbol, n, (SELECT count(*) FROM generate_series(a, z, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS wanted FROM s)
    SELECT symbol, n, wanted, round(n / wanted, 6) AS coverage, CASE WHEN n = 0 THEN 'miss' WHEN n < wanted THEN 'partial' ELSE 'hit' END AS status FROM c""",
)
def completeness(spark, sf_dir):
    """How much of the calendar each symbol's bars cover; a partial hit is not a success."""
    bars = daily_bars(spark, sf_dir).filter(F.weekday("date") < 5)
    span = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    wanted = F.size(F.filter(F.sequence("a", "z"), lambda d: F.weekday(d) < 5)).cast("long")
    out = span.join(bars.groupBy("symbol").agg(F.count("*").alias("n")), "symbol", "left").select("symbol", F.coalesce("n", F.lit(0)).alias("n"), wanted.alias("wanted"))
    status = F.when(F.col("n") == 0, "miss").when(F.col("n") < F.col("wanted"), "partial").otherwise("hit")
    return out.withColumn("coverage", F.round(F.col("n") / F.col("wanted"), 6)).withColumn("status", status)


@query(
    "c7_as_of",
    """SELECT p.event_id, p.user_id, c.value AS last_click, c.ts AS matched_at FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def as_of_clicks(spark, sf_dir):
    """Each purchase with the user's latest click before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    asks = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_click"))
    return B.as_of(asks, clicks, "user_id", "ts", ["last_click"]).select("event_id", "user_id", "last_click", "matched_at")
