"""Queries on event back-tests, over weekly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import backtests as K
from ..operators import scoring as G
from .indicators import OVER, averaged, crossing, rolling
from .panels import W, rounded, weekly_bars

#: Bars that pass before the slow strategies may act: fewer than their usual 200, so that brands with few bars trade too.
WARM = {"sma_crossover": 60, "ema_crossover": 60}
_SIDES = {
    "sma_crossover": (f"{crossing('sf', 'ss')} = 'golden'", f"{crossing('sf', 'ss')} = 'death'"), "ema_crossover": (f"{crossing('ef', 'es')} = 'golden'", f"{crossing('ef', 'es')} = 'death'"),
    "rsi_reversal": (f"lag(rsi) {OVER} <= 40 AND rsi > 40", f"lag(rsi) {OVER} >= 60 AND rsi < 60"), "macd": (f"{crossing('dif', 'dea')} = 'golden'", f"{crossing('dif', 'dea')} = 'death'"),
    "bollinger_bands": (f"lag(close) {OVER} >= lag(mean - 1.5 * dev) {OVER} AND close < mean - 1.5 * dev", f"lag(close) {OVER} <= lag(mean + 1.5 * dev) {OVER} AND close > mean + 1.5 * dev"), "breakout": ("close > top", "close < bottom"),
    "mean_reversion": (f"lag(z) {OVER} >= -1.5 AND z < -1.5", f"lag(z) {OVER} < 0 AND z >= 0"), "momentum": (f"lag(roc) {OVER} <= 5 AND roc > 5", f"lag(roc) {OVER} >= 0 AND roc < 0"),
}
_FLAGS = ", ".join(f"CASE WHEN i > {(K.STRATEGIES | WARM)[k]} THEN CASE WHEN {a} THEN 'entry' WHEN {b} THEN 'exit' END END AS ev_{k}" for k, (a, b) in _SIDES.items())
_EVENTS = f"""{averaged('qe', 'w', {'ef': ('close', 2 / 13), 'es': ('close', 2 / 27)})}, qd AS (SELECT * EXCLUDE (i), ef - es AS dif FROM qe), {averaged('qs', 'qd', {'dea': ('dif', 0.2)})},
    qm AS (SELECT *, close - lag(close) {OVER} AS d, {rolling('avg({})', 20, 'close')} AS mean, {rolling('stddev_samp({})', 20, 'close')} AS dev, {rolling('avg({})', 20, 'close')} AS sf, {rolling('avg({})', 50, 'close')} AS ss, CASE WHEN count(high) OVER b20 = 20 THEN max(high) OVER b20 END AS top, CASE WHEN count(low) OVER b20 = 20 THEN min(low) OVER b20 END AS bottom, (close / nullif(lag(close, 13) {OVER}, 0) - 1) * 100 AS roc
           FROM qs WINDOW b20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    qg AS (SELECT *, greatest(coalesce(d, 0), 0) AS u, greatest(coalesce(-d, 0), 0) AS n FROM qm), qa AS (SELECT *, {rolling('avg({})', 14, 'u')} AS g, {rolling('avg({})', 14, 'n')} AS l FROM qg),
    qr AS (SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END AS rsi, CASE WHEN dev > 0 THEN (close - mean) / dev END AS z FROM qa), qf AS (SELECT symbol, date, close, i, {_FLAGS} FROM qr),
    qv AS (SELECT symbol, date, close, i, substr(name, 4) AS strategy, event FROM qf UNPIVOT INCLUDE NULLS (event FOR name IN ({", ".join(f"ev_{k}" for k in _SIDES)})))"""
_CURVE = """h1 AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER v = 'entry', false) AS held, lead(i) OVER o IS NULL AS final FROM qv WINDOW v AS (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY strategy, symbol ORDER BY date)),
    h2 AS (SELECT *, held AND NOT coalesce(lag(held) OVER o, false) AS entered, NOT held AND coalesce(lag(held) OVER o, false) AS left_ FROM h1 WINDOW o AS (PARTITION BY strategy, symbol ORDER BY date)),
    h3 AS (SELECT *, last_value(CASE WHEN entered THEN close * 1.0005 END IGNORE NULLS) OVER v AS entry_price, CASE WHEN left_ OR (held AND final) THEN close * 0.9995 END AS exit_price FROM h2 WINDOW v AS (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    h4 AS (SELECT *, 1 - 0.95 * 1.001 + 0.95 * 0.999 * exit_price / entry_price AS gain FROM h3),
    h5 AS (SELECT *, 10000 * exp(coalesce(sum(CASE WHEN left_ THEN ln(gain) END) OVER v, 0)) AS cash FROM h4 WINDOW v AS (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    h6 AS (SELECT *, left_ OR (held AND final) AS exited, CASE WHEN held AND final THEN cash * gain WHEN held THEN cash * (1 - 0.95 * 1.001 + 0.95 * close / entry_price) ELSE cash END AS equity FROM h5)"""


def _events(spark, sf_dir):
    return K.strategy_events(weekly_bars(spark, sf_dir), WARM, low=40.0, high=60.0, width=1.5)


@query("q2_strategy_events", f"WITH {W}, {_EVENTS} SELECT symbol, date, strategy, event FROM qv WHERE event IS NOT NULL")
def strategy_events(spark, sf_dir):
    """Entries and exits of eight strategies, with bounds that the smooth weekly bars reach."""
    return _events(spark, sf_dir).filter("event IS NOT NULL").select("symbol", "date", "strategy", "event")


@query("q3_equity", f"WITH {W}, {_EVENTS}, {_CURVE} SELECT symbol, date, strategy, held, round(cash, 4) AS cash, round(equity, 4) AS equity FROM h6")
def equity(spark, sf_dir):
    """Cash and equity of every strategy and brand, with slippage on both sides and commission."""
    return rounded(K.equity_curves(_events(spark, sf_dir)).select("symbol", "date", "strategy", "held", "cash", "equity"), 4, "cash", "equity")


@query("q3_event_trades", f"WITH {W}, {_EVENTS}, {_CURVE}, h7 AS (SELECT *, last_value(CASE WHEN entered THEN date END IGNORE NULLS) OVER v AS entry_date, last_value(CASE WHEN entered THEN cash END IGNORE NULLS) OVER v AS bought FROM h6 WINDOW v AS (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT strategy, symbol, entry_date, date AS exit_date, round(entry_price, 7) AS entry_price, round(exit_price, 7) AS exit_price, round(0.95 * bought / entry_price, 6) AS size, round((exit_price / entry_price - 1) * 100, 6) AS return_pct FROM h7 WHERE exited")
def event_trades(spark, sf_dir):
    out = K.event_trades(K.equity_curves(_events(spark, sf_dir)))
    return rounded(rounded(out, 7, "entry_price", "exit_price"), 6, "size", "return_pct")


@query(
    "q4_event_metrics",
    f"""WITH {W}, {_EVENTS}, {_CURVE}, h7 AS (SELECT *, greatest(10000, max(equity) OVER v) AS peak FROM h6 WINDOW v AS (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    h8 AS (SELECT *, sum(CASE WHEN equity < peak THEN 0 ELSE 1 END) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM h7), h9 AS (SELECT strategy, symbol, max(n) AS longest FROM (SELECT strategy, symbol, run, count(*) FILTER (equity < peak) AS n FROM h8 GROUP BY ALL) GROUP BY ALL),
    hm AS (SELECT strategy, symbol, arg_max(equity, date) AS final, count(*) FILTER (exited) AS trades, count(*) FILTER (exited AND exit_price > entry_price) AS wins, sum(CASE WHEN exited THEN greatest(exit_price / entry_price - 1, 0) END) AS p, sum(CASE WHEN exited THEN greatest(1 - exit_price / entry_price, 0) END) AS m, min((equity / peak - 1) * 100) AS dd FROM h8 GROUP BY ALL)
    SELECT strategy, symbol, round(final, 4) AS final, round((final / 10000 - 1) * 100, 6) AS return_pct, trades, round(CASE WHEN trades > 0 THEN wins / trades * 100 END, 6) AS win_rate, round(CASE WHEN m > 0 THEN p / m END, 6) AS profit_factor, round(dd, 6) AS max_drawdown_pct, longest AS longest_drawdown FROM hm JOIN h9 USING (strategy, symbol)""",
)
def event_metrics(spark, sf_dir):
    """Also E10: the longest run of bars under the peak."""
    out = K.equity_metrics(K.equity_curves(_events(spark, sf_dir)))
    return rounded(rounded(out, 6, "return_pct", "win_rate", "profit_factor", "max_drawdown_pct"), 4, "final")


_PAYLOAD = "pw AS (SELECT *, CAST(substr(symbol, 7) AS INTEGER) AS k FROM w), pc AS (SELECT date, symbol, 'sector ' || k % 5 AS sector, (40 + (day(date) * 7 + k % 5 * 13) % 60)::DOUBLE AS sector_score, (k % 9)::DOUBLE AS leader_score, close AS limit_close FROM pw WHERE k % 5 <> (day(date) + 2) % 5 AND (day(date) + k % 5) % 2 = 0)"
_GRID4 = [(least, hold, stop, target) for least in (50, 60, 80) for hold in (3, 5, 7) for stop in (3, 5, 8) for target in (3, 5, 8)]
_PARAMS4 = ", ".join(f"({k}, {m}, {h}, {s}, {t})" for k, (m, h, s, t) in enumerate(_GRID4))
_DIPS = f"""dp(p, least_score, hold, stop_pct, target_pct) AS (VALUES {_PARAMS4}), dn AS (SELECT symbol, date AS entry_date, open AS entry, volume, lag(date) {OVER} AS date, lag(low) {OVER} AS low_, lag(volume) {OVER} AS was, row_number() {OVER} AS i FROM w),
    dt AS (SELECT dp.*, n.symbol, n.entry_date, n.entry, n.i, least(coalesce(low_, limit_close * 0.95), limit_close * (1 - stop_pct / 100)) AS stop, limit_close * (1 + target_pct / 100) AS target FROM pc JOIN dn n ON n.symbol = pc.symbol AND n.date = pc.date CROSS JOIN dp WHERE sector_score >= least_score AND (entry - limit_close) / limit_close * 100 BETWEEN -20 AND 10 AND NOT coalesce(volume / was > 0.95, false)),
    db AS (SELECT t.*, y.i - t.i AS d, CASE WHEN b.low <= stop THEN 'stop' WHEN b.high >= target THEN 'target' END AS how, CASE WHEN b.low <= stop THEN stop WHEN b.high >= target THEN target END AS price, b.close FROM dt t JOIN dn y ON y.symbol = t.symbol AND y.i BETWEEN t.i AND t.i + t.hold JOIN w b ON b.symbol = y.symbol AND b.date = y.entry_date),
    dr AS (SELECT p, symbol, entry_date, entry, coalesce(arg_min(how, d) FILTER (how IS NOT NULL), 'time') AS how, coalesce(min(d) FILTER (how IS NOT NULL), max(d)) AS held, (coalesce(arg_min(price, d) FILTER (how IS NOT NULL), arg_max(close, d)) - entry) / entry * 100 AS pnl_pct FROM db GROUP BY p, symbol, entry_date, entry)"""


def _candidates(spark, sf_dir):
    """Each week's sectors with their leaders, nested as they are collected, and the candidates among them."""
    k = F.substring("symbol", 7, 9).cast("int")
    bars = weekly_bars(spark, sf_dir).withColumns({"k": k, "sector": F.concat(F.lit("sector "), k % 5)})
    odd = F.col("k") % 2 == 1  # every other leader's price is in the day's list only
    leader = F.struct(F.col("symbol").alias("code"), F.lower("symbol").alias("name"), F.when(odd, 0.0).otherwise(F.col("close")).alias("latest_price"), (F.col("k") % 9).alias("leader_score"))
    group = bars.groupBy("date", "sector", (F.col("k") % 5).alias("g")).agg(F.collect_list(leader).alias("leaders"), F.collect_list(F.struct(F.col("symbol").alias("code"), F.col("close").alias("latest_price"))).alias("listed"))
    phase = F.when((F.day("date") + F.col("g")) % 2 == 0, "start").otherwise("ebb")
    sector = F.struct(F.col("sector").alias("name"), phase.alias("phase"), (40 + (F.day("date") * 7 + F.col("g") * 13) % 60).alias("score"), "leaders")
    kept = F.col("g") != (F.day("date") + 2) % 5
    payloads = group.groupBy("date").agg(F.collect_list(F.when(kept, sector)).alias("sectors"), F.flatten(F.collect_list("listed")).alias("limit_ups"))
    return K.dip_candidates(payloads, "start")


@query("q6_dip_candidates", f"WITH {W}, {_PAYLOAD} SELECT date, symbol, lower(symbol) AS name, sector, sector_score, leader_score, round(limit_close, 6) AS limit_close FROM pc")
def dip_candidates(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir), 6, "limit_close")


def _dips(spark, sf_dir):
    params = spark.createDataFrame([(k, float(m), h, float(s), float(t), -20.0, 10.0, 0.95) for k, (m, h, s, t) in enumerate(_GRID4)], "p int, least_score double, hold int, stop_pct double, target_pct double, dip_min double, dip_max double, shrink double")
    return K.dip_trades(_candidates(spark, sf_dir).select("symbol", "date", "limit_close", "sector_score"), weekly_bars(spark, sf_dir), params, 7)


@query("q6_dip_trades", f"WITH {W}, {_PAYLOAD}, {_DIPS} SELECT symbol, entry_date, round(entry, 6) AS entry, how, CAST(held AS INTEGER) AS held, round(pnl_pct, 6) AS pnl_pct FROM dr WHERE p = 40")
def dip_trades(spark, sf_dir):
    """Leaders of starting sectors bought on a dip with thin volume, at the middle of the grid."""
    return rounded(_dips(spark, sf_dir).filter("p = 40").drop("p"), 6, "entry", "pnl_pct")


@query("q7_dip_grid", f"WITH {W}, {_PAYLOAD}, {_DIPS}, g AS (SELECT p, count(*) AS trades, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) * 100 AS win_rate, avg(pnl_pct) AS avg_pnl, min(pnl_pct) AS worst FROM dr GROUP BY p) SELECT p, trades, round(win_rate, 6) AS win_rate, round(avg_pnl, 6) AS avg_pnl, round(worst, 6) AS worst, round(win_rate * 0.5 + greatest(0, avg_pnl) * 0.3 - abs(worst) * 0.2, 6) AS score FROM g")
def dip_grid(spark, sf_dir):
    """All 81 settings of sector score, hold, stop and target."""
    return rounded(G.pullback_grid(_dips(spark, sf_dir)), 6, "win_rate", "avg_pnl", "worst", "score")
