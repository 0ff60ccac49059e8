"""Queries on volatility and ranges, over weekly bars: per bar, but for the full-day range, which has its own scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import volatility as V
from .indicators import OVER, TR, rolling
from .panels import W, rounded, table, weekly_bars

RET = f"r AS (SELECT symbol, date, close, high, low, close / lag(close) {OVER} - 1 AS ret FROM w)"


def hv(n: int) -> str:
    return hv_year(n, 1)


def hv_year(n: int, periods: int) -> str:
    x = f"{rolling('stddev_samp({})', n, 'ret')} * sqrt({periods}) * 100"
    return f"CASE WHEN ({x}) IS NOT NULL THEN least({x}, 500) END"


@query("k01_historical_volatility", f"WITH {W}, {RET} SELECT symbol, date, round({hv(5)}, 6) AS hv5, round({hv(20)}, 6) AS hv20, round({hv(60)}, 6) AS hv60 FROM r")
def historical_volatility(spark, sf_dir):
    return rounded(V.historical_volatility(weekly_bars(spark, sf_dir), [5, 20, 60], 1), 6, "hv5", "hv20", "hv60")


@query(
    "k03_volatility_cone",
    f"""WITH {W}, {RET}, h AS (SELECT symbol, date, 10 AS win, {hv(10)} AS hv FROM r UNION ALL SELECT symbol, date, 30, {hv(30)} FROM r), l AS (SELECT * FROM h WHERE hv IS NOT NULL),
    c AS (SELECT symbol, win, arg_max(hv, date) AS cur, max(date) AS last, count(*) AS points FROM l GROUP BY ALL)
    SELECT symbol, win AS "window", points, round(cur, 6) AS current, round(CASE WHEN points >= 60 THEN min(hv) END, 6) AS low, round(CASE WHEN points >= 60 THEN max(hv) END, 6) AS high,
    round(CASE WHEN points >= 60 THEN avg(hv) END, 6) AS mean, round(CASE WHEN points >= 60 THEN avg(CASE WHEN hv <= cur THEN 1.0 ELSE 0 END) FILTER (date < last) * 100 END, 6) AS percentile
    FROM l JOIN c USING (symbol, win) GROUP BY symbol, win, cur, points""",
)
def volatility_cone(spark, sf_dir):
    return rounded(V.volatility_cone(weekly_bars(spark, sf_dir), [10, 30], periods=1), 6, "current", "low", "high", "mean", "percentile")


@query("k05_mean_range", f"WITH {W}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM w) SELECT symbol, round(CASE WHEN count(*) >= 5 THEN avg((high - low) / close * 100) END, 6) AS mean_range FROM l WHERE n <= 22 GROUP BY symbol")
def mean_range(spark, sf_dir):
    return rounded(V.mean_range(weekly_bars(spark, sf_dir)), 6, "mean_range")


@query(
    "k06_full_day_range",
    f"""WITH {W}, {RET}, {TR}, a AS (SELECT symbol, date, close, {rolling('avg({})', 14, 'tr')} / close * 100 AS natr FROM t),
    h AS (SELECT symbol, date, {hv_year(5, 252)} AS h5, {hv_year(10, 252)} AS h10, {hv_year(22, 252)} AS h22 FROM r),
    m AS (SELECT symbol, CASE WHEN count(*) >= 5 THEN avg((high - low) / close * 100) END AS park FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM w) WHERE n <= 22 GROUP BY symbol),
    l AS (SELECT *, least(12, greatest(1, ((h5 * 0.3 + h10 * 0.3 + h22 * 0.2) / sqrt(252) + (natr + park) / 2 * 0.2) / 1.0 * 2.2)) AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM a JOIN h USING (symbol, date) JOIN m USING (symbol))
    SELECT symbol, date, round(close, 6) AS close, round(p, 6) AS range_pct, round(close - close * p / 200, 6) AS lower, round(close + close * p / 200, 6) AS upper FROM l WHERE n = 1""",
)
def full_day_range(spark, sf_dir):
    return rounded(V.full_day_range(weekly_bars(spark, sf_dir)), 6, "close", "range_pct", "lower", "upper")


@query(
    "k13_ewma_volatility",
    f"""WITH {W}, x AS (SELECT symbol, date, ln(close / lag(close) {OVER}) AS r FROM w), y AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS age FROM x WHERE r IS NOT NULL)
    SELECT symbol, round(sqrt(sum(pow(0.94, age) * r * r) / sum(pow(0.94, age))) * sqrt(252) * 100, 6) AS volatility FROM y WHERE age < 250 GROUP BY symbol""",
)
def ewma_volatility(spark, sf_dir):
    return rounded(V.ewma_volatility(weekly_bars(spark, sf_dir)), 6, "volatility")


@query("k14_black_scholes")
def black_scholes(spark, sf_dir):
    """An option per part: spot its price, strike from its size, tenor and volatility from its key."""
    spot, key = F.col("p_retailprice"), F.col("p_partkey")
    options = table(spark, sf_dir, "part").select("p_partkey", spot.alias("spot"), (spot * (0.8 + F.col("p_size") / 125)).alias("strike"), ((key % 400) / 365.0).alias("years"), F.lit(0.02).alias("rate"), (0.1 + (key % 7) / 20.0).alias("sigma"), (key % 2 == 0).alias("is_call"))
    return V.black_scholes(options).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("price", "delta", "gamma", "vega", "theta", "rho")])


@query(
    "k11_breakthrough",
    """WITH x AS (SELECT event_id, (event_id % 101 - 10) / 80.0 AS p, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 100 END AS wide, event_id % 260 - 10 AS m, (event_id % 13) / 10.0 AS c FROM events),
    y AS (SELECT event_id, CASE WHEN wide > 0 THEN greatest(0, least(1, p)) ELSE 0.5 END AS position, CASE WHEN wide > 0 THEN sqrt(greatest(0, least(1, m / 240.0))) ELSE 0 END AS time, greatest(0, least(1, c)) AS c FROM x)
    SELECT event_id, round((1 - position) * time * c, 6) AS up, round(position * time * c, 6) AS down, round(time, 6) AS time, round(position, 6) AS position FROM y""",
)
def breakthrough(spark, sf_dir):
    key = F.col("event_id")
    low, wide = F.lit(20.0), F.when(key % 17 == 0, 0.0).otherwise(100.0)
    made = V.breakthrough(low + 100 * (key % 101 - 10) / 80.0, low, low + wide, (key % 13) / 10.0, key % 260 - 10)
    return table(spark, sf_dir, "events").select("event_id", *[F.round(x, 6).alias(k) for k, x in made.items()])


@query(
    "k06_intraday_bump",
    """WITH c AS (SELECT event_type, value AS close, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events QUALIFY n <= 30),
    r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY event_type ORDER BY n DESC), 0) - 1 AS r FROM c),
    s AS (SELECT event_type, stddev_samp(r) AS sd, count(r) AS k, arg_max(close, n) AS a, arg_min(close, n) AS z FROM r GROUP BY event_type)
    SELECT event_type, round(CASE WHEN k >= 2 THEN least(0.8, least(0.8, sd * sqrt(240.0 / k) * 50) + CASE WHEN a > 0 THEN least(0.4, abs(z / a - 1) * 15) ELSE 0 END) ELSE 0 END, 6) AS bump FROM s""",
)
def intraday_bump(spark, sf_dir):
    closes = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.col("value").alias("close"))
    return rounded(V.intraday_bump(closes, ["event_type"], ["ts", "event_id"]), 6, "bump")


@query(
    "k10_state_weights",
    """WITH h AS (SELECT o_orderstatus AS state, o_orderpriority AS method, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0 END) AS hit_rate, avg(least(1, o_totalprice / 300000)) AS width_quality FROM orders GROUP BY ALL),
    s AS (SELECT *, 0.6 * hit_rate + 0.4 * width_quality AS score FROM h), c AS (SELECT *, least(0.5, greatest(0.1, score / sum(score) OVER (PARTITION BY state))) AS share FROM s)
    SELECT state, method, round(hit_rate, 6) AS hit_rate, round(width_quality, 6) AS width_quality, round(score, 6) AS score, round(share / sum(share) OVER (PARTITION BY state), 6) AS weight FROM c""",
)
def state_weights(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    hits = orders.groupBy(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("method")).agg(F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("hit_rate"), F.avg(F.least(F.lit(1.0), F.col("o_totalprice") / 300000)).alias("width_quality"))
    return rounded(V.state_weights(hits), 6, "hit_rate", "width_quality", "score", "weight")


@query(
    "k15_iv_percentile",
    f"""WITH {W}, {RET}, h AS (SELECT symbol, date, {hv(20)} AS iv FROM r), v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM h WHERE iv IS NOT NULL), l AS (SELECT symbol, iv AS cur FROM v WHERE n = 1),
    p AS (SELECT symbol, cur, avg(CASE WHEN iv <= cur THEN 1.0 ELSE 0 END) * 100 AS p FROM v JOIN l USING (symbol) WHERE n <= 252 GROUP BY ALL)
    SELECT symbol, round(cur, 6) AS current, round(p, 6) AS percentile, round(CASE WHEN p >= 80 THEN greatest(1 - 0.15 * (p - 80) / 20, 0.75) WHEN p <= 20 THEN least(1 + 0.15 * (20 - p) / 20, 1.25) ELSE greatest(0.95, least(1.05, 1 + (abs(p - 50) / 50 - 0.5) * 0.1)) END, 6) AS factor FROM p""",
)
def iv_percentile(spark, sf_dir):
    history = V.historical_volatility(weekly_bars(spark, sf_dir), [20], 1).select("symbol", "date", F.col("hv20").alias("iv")).filter("iv IS NOT NULL")
    return rounded(V.iv_percentile_factor(history), 6, "current", "percentile", "factor")
