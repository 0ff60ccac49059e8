"""Queries on rotation scoring, over weekly bars; pools are the parity of a brand's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import rotation as R
from .indicators import OVER, rolling
from .panels import W, rounded, table, weekly_bars

METRICS = f"""x AS (SELECT symbol, date, close, row_number() {OVER} AS i, close / lag(close, 5) {OVER} - 1 AS m5, close / lag(close, 20) {OVER} - 1 AS m20, close / lag(close, 60) {OVER} - 1 AS m60, close / lag(close) {OVER} - 1 AS ret, {rolling('avg({})', 20, 'close')} AS ma20 FROM w),
    v AS (SELECT *, {rolling('stddev_pop({})', 20, 'ret')} * sqrt(252) AS vol20, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age FROM x),
    l AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM v WHERE age <= 60),
    n AS (SELECT symbol, date, close, m5, m20, m60, vol20, close > ma20 AS above_ma FROM l WHERE age = 1),
    p AS (SELECT l.symbol, avg(CASE WHEN l.vol20 IS NOT NULL THEN CASE WHEN l.vol20 <= n.vol20 THEN 1.0 ELSE 0 END END) AS crowding, min(dd) AS mdd60, avg(CASE WHEN age <= 20 AND ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0 END END) AS win20,
          least(1, greatest(0, coalesce(regr_r2(ln(greatest(l.close, 1e-12)), i), 0))) AS r2 FROM l JOIN n USING (symbol) GROUP BY l.symbol),
    bm AS (SELECT * FROM n JOIN p USING (symbol))"""
_ROUND = "symbol, date, round(close, 6) AS close, round(m5, 6) AS m5, round(m20, 6) AS m20, round(m60, 6) AS m60, round(vol20, 6) AS vol20, above_ma, round(crowding, 6) AS crowding, round(mdd60, 6) AS mdd60, round(win20, 6) AS win20, round(r2, 6) AS r2"
CORR = f"""cd AS (SELECT date FROM w GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM w) ORDER BY date DESC LIMIT 61),
    lr AS (SELECT * FROM (SELECT symbol, date, ln(close / lag(close) {OVER}) AS r FROM w WHERE date IN (SELECT date FROM cd)) WHERE r IS NOT NULL),
    cc AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.r, y.r) AS corr FROM lr x JOIN lr y ON x.date = y.date AND x.symbol <> y.symbol GROUP BY ALL),
    mc AS (SELECT a AS symbol, avg(abs(corr)) AS mean_corr FROM cc GROUP BY a)"""
NUMBERS = ("close", "m5", "m20", "m60", "vol20", "crowding", "mdd60", "win20", "r2")


@query("l01_base_metrics", f"WITH {W}, {METRICS} SELECT {_ROUND} FROM bm")
def base_metrics(spark, sf_dir):
    return rounded(R.base_metrics(weekly_bars(spark, sf_dir)), 6, *NUMBERS)


@query("l04_log_returns", f"WITH {W}, {CORR} SELECT symbol, date, round(r, 8) AS r FROM lr")
def log_returns(spark, sf_dir):
    return rounded(R.log_returns(weekly_bars(spark, sf_dir)), 8, "r")


@query("c12_correlations", f"WITH {W}, {CORR} SELECT a, b, round(corr, 8) AS corr FROM cc")
def correlations(spark, sf_dir):
    return rounded(R.correlations(R.log_returns(weekly_bars(spark, sf_dir))), 8, "corr")


@query("l05_mean_correlation", f"WITH {W}, {CORR} SELECT symbol, round(mean_corr, 8) AS mean_corr FROM mc")
def mean_correlation(spark, sf_dir):
    return rounded(R.mean_abs_correlation(R.correlations(R.log_returns(weekly_bars(spark, sf_dir)))), 8, "mean_corr")


_SHARES = ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY pool) > 1 THEN (row_number() OVER (PARTITION BY pool ORDER BY {k} {'ASC' if k in R.ASCENDING else 'DESC'} NULLS LAST, symbol) - 1) / (count(*) OVER (PARTITION BY pool) - 1) ELSE 1 END * {v} AS s_{k}" for k, v in R.WEIGHTS.items()
)
_POOL = "CAST(substr(symbol, 7) AS INTEGER) % 2"
_RANKED = f"""bp AS (SELECT *, {_POOL} AS pool FROM bm JOIN mc USING (symbol)), sh AS (SELECT *, {_SHARES} FROM bp), sc AS (SELECT *, {' + '.join(f's_{k}' for k in R.WEIGHTS)} AS score FROM sh),
    rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY round(score, 10) DESC, symbol) AS rank FROM sc)"""


def _ranked(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    metrics = R.base_metrics(bars).join(R.mean_abs_correlation(R.correlations(R.log_returns(bars))), "symbol")
    return R.pool_ranks(metrics.withColumn("pool", F.substring("symbol", 7, 9).cast("int") % 2), "pool")


@query("l10_pool_ranking", f"WITH {W}, {METRICS}, {CORR}, {_RANKED} SELECT pool, symbol, round(score, 6) AS score, rank FROM rk")
def pool_ranking(spark, sf_dir):
    return _ranked(spark, sf_dir).select("pool", "symbol", F.round("score", 6).alias("score"), "rank")


@query(
    "l08_penalties",
    f"""WITH {W}, {METRICS} SELECT symbol, CASE WHEN m60 IS NULL THEN 'short_history' WHEN vol20 > 15 THEN 'high_volatility' WHEN r2 < 0.1 THEN 'no_trend' ELSE '' END AS reason,
    (m60 IS NULL OR vol20 > 15 OR r2 < 0.1) AS excluded, round(CASE WHEN NOT above_ma THEN 0.8 ELSE 1 END * CASE WHEN mdd60 < -0.3 THEN 0.9 ELSE 1 END * CASE WHEN crowding > 0.9 THEN 0.95 ELSE 1 END, 6)::DOUBLE AS penalty FROM bm""",
)
def penalties(spark, sf_dir):
    out = R.penalties(R.base_metrics(weekly_bars(spark, sf_dir)), F.lit(15.0))
    return out.select("symbol", "reason", "excluded", F.round("penalty", 6).alias("penalty"))


@query("l09_greedy_filter")
def greedy_filter(spark, sf_dir):
    pairs = R.correlations(R.log_returns(weekly_bars(spark, sf_dir)))
    return R.greedy_filter(_ranked(spark, sf_dir).select("pool", "symbol", "rank"), pairs, 0.1)


@query(
    "l06_stability",
    """WITH runs AS (SELECT run, list(o_orderpriority ORDER BY total DESC, o_orderpriority) AS ranked FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run, o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY ALL) GROUP BY run ORDER BY run DESC LIMIT 6),
    r AS (SELECT run, unnest(ranked) AS symbol, unnest(range(1, len(ranked) + 1)) AS rank FROM runs), s AS (SELECT DISTINCT symbol FROM r),
    g AS (SELECT s.symbol, coalesce(r.rank, (SELECT count(*) FROM s) + 5) AS rank FROM s CROSS JOIN (SELECT run FROM runs) u LEFT JOIN r ON r.run = u.run AND r.symbol = s.symbol), w AS (SELECT symbol, 1 / (stddev_pop(rank) + 0.01) AS raw FROM g GROUP BY symbol)
    SELECT symbol, round(CASE WHEN max(raw) OVER () > min(raw) OVER () THEN (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) ELSE 0.5 END, 6) AS stability FROM w""",
)
def stability(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("run"), F.col("o_orderpriority").alias("symbol")).agg(F.sum("o_totalprice").alias("total"))
    runs = totals.groupBy("run").agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "symbol"))).alias("x")).select("run", F.col("x.symbol").alias("ranked"))
    return rounded(R.stability(runs), 6, "stability")
