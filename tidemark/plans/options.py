"""Queries on options: Greeks of tall rows, signals, ranges. Contracts are made of events: each says a field and a value, some of them broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import forecasts as P
from ..operators import options as O  # noqa: E741
from ..operators import scoring as S
from ..operators import volatility as V
from ..operators.indicators import atr, bollinger
from .indicators import MOVES, OVER, TR, averaged, rolling
from .panels import W, rounded, table, weekly_bars

FIELDS = {"delta": "Delta", "gamma": "Gamma", "iv": "IV"}


def tall_greeks(spark, sf_dir):
    """(contract, kind, trade_date, ts, field, value): every event gives its contract three fields at its time, one value in thirteen is no number."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Brand#"), (1 + F.col("event_id") % 25).cast("string")).alias("contract"), F.when(F.col("event_id") % 2 == 0, "call").otherwise("put").alias("kind"), "ts", "value")
    values = {"Delta": F.col("value") / 500, "Gamma": 0.01 + (F.col("event_id") % 50) / 1000, "IV": 15 + F.col("value") / 20}
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.when((F.col("event_id") + i) % 13 == 0, "--").otherwise(v.cast("string")).alias("value")) for i, (k, v) in enumerate(values.items())]))
    return e.select("contract", "kind", F.to_date("ts").alias("trade_date"), "ts", said.alias("x")).select("contract", "kind", "trade_date", "ts", "x.*")


_WIDE = """gw AS (SELECT 'Brand#' || (1 + event_id % 25) AS contract, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'put' END AS kind, CAST(ts AS DATE) AS trade_date, ts,
    max(CASE WHEN event_id % 13 <> 0 THEN value / 500 END) AS delta, max(CASE WHEN (event_id + 1) % 13 <> 0 THEN 0.01 + (event_id % 50) / 1000 END) AS gamma, max(CASE WHEN (event_id + 2) % 13 <> 0 THEN 15 + value / 20 END) AS iv FROM events GROUP BY ALL)"""


def _wide(spark, sf_dir):
    return O.greeks_wide(tall_greeks(spark, sf_dir), ["contract", "kind", "trade_date", "ts"], FIELDS)


@query("a08_greeks_wide", f"WITH {_WIDE} SELECT contract, kind, ts, round(delta, 8) AS delta, round(gamma, 8) AS gamma, round(iv, 8) AS iv FROM gw")
def greeks_wide(spark, sf_dir):
    return rounded(_wide(spark, sf_dir).drop("trade_date"), 8, "delta", "gamma", "iv")


_ASKS = "ak AS (SELECT c.contract, CAST(x AS DATE) AS day FROM (SELECT DISTINCT contract FROM gw) c, generate_series(DATE '2024-01-01', DATE '2024-02-20', INTERVAL 3 DAY) t(x))"
_CLOSEST = """cd AS (SELECT ak.contract, ak.day, max(d.trade_date) AS trade_date FROM ak JOIN (SELECT DISTINCT contract, trade_date FROM gw WHERE day(trade_date) % 4 = 1) d ON d.contract = ak.contract AND d.trade_date <= ak.day AND d.trade_date > ak.day - 10 GROUP BY ALL)"""


@query("a09_closest_greeks", f"WITH {_WIDE}, {_ASKS}, {_CLOSEST} SELECT cd.contract, cd.day, cd.trade_date, gw.ts, round(gw.delta, 8) AS delta FROM cd JOIN gw USING (contract, trade_date)")
def closest_greeks(spark, sf_dir):
    """Every third day's Greeks of each contract, from the newest stored day up to it; one day in four is stored."""
    wide = _wide(spark, sf_dir)
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-02-20', INTERVAL 3 DAYS)) AS day")
    asks = wide.select("contract").distinct().join(F.broadcast(days), how="cross")
    out = O.closest_greeks(asks, wide.filter(F.day("trade_date") % 4 == 1), 10)
    return rounded(out.select("contract", "day", "trade_date", "ts", "delta"), 8, "delta")


_LAST = "arg_max({0}, ts) FILTER ({0} IS NOT NULL)"
_SECOND = "list({0} ORDER BY ts DESC) FILTER ({0} IS NOT NULL)[2]"
_CHANGE = f"""gc AS (SELECT contract, kind, {{by}} count(*) AS n, list(delta ORDER BY ts DESC) FILTER (delta IS NOT NULL) AS ds, avg(gamma) AS gm, arg_max(gamma, ts) FILTER (gamma IS NOT NULL) AS gl, list(iv ORDER BY ts DESC) FILTER (iv IS NOT NULL) AS vs FROM gw GROUP BY ALL),
    gr AS (SELECT *, CASE WHEN n >= 2 THEN coalesce(ds[1] - ds[2], 0) ELSE 0 END AS delta_change, CASE WHEN n >= 2 AND gm > 0 THEN coalesce(gl / gm, 1) ELSE 1 END AS gamma_peak, CASE WHEN n >= 2 THEN coalesce((vs[1] - vs[2]) / nullif(vs[2], 0) * 100, 0) ELSE 0 END AS iv_change, CASE WHEN n < 2 THEN 'insufficient' WHEN n < 5 THEN 'low' ELSE 'good' END AS quality FROM gc),
    gs AS (SELECT *, least(0.2, (CASE WHEN abs(delta_change) >= 0.1 THEN least(abs(delta_change) / 0.5, 1) * 0.1 ELSE 0 END + CASE WHEN gamma_peak >= 1.5 THEN least(gamma_peak - 1, 1) * 0.1 ELSE 0 END + CASE WHEN abs(iv_change) >= 5 THEN least(abs(iv_change) / 20, 1) * 0.05 ELSE 0 END) * CASE quality WHEN 'low' THEN 0.8 WHEN 'insufficient' THEN 0.6 ELSE 1 END) AS score FROM gr)"""


@query("o1_greeks_change", f"WITH {_WIDE}, {_CHANGE.format(by='trade_date,')} SELECT contract, kind, trade_date, n, round(delta_change, 8) AS delta_change, round(gamma_peak, 8) AS gamma_peak, round(iv_change, 6) AS iv_change, quality, round(score, 8) AS score FROM gs")
def greeks_change(spark, sf_dir):
    """What changed in each contract's Greeks on each day, and the score that it gives a signal."""
    out = O.greeks_change(_wide(spark, sf_dir), ["contract", "kind", "trade_date"])
    out = out.withColumn("score", O.greeks_score(F.col("delta_change"), F.col("gamma_peak"), F.col("iv_change"), F.col("quality")))
    return rounded(rounded(out, 8, "delta_change", "gamma_peak", "score"), 6, "iv_change")


_TREND = f"""ta AS (SELECT symbol, date, close, {rolling('avg({})', 20, 'close')} AS ma FROM w), tb AS (SELECT *, lag(ma, 4) {OVER} AS was FROM ta), tc AS (SELECT *, coalesce((ma - was) / was * 100, 0) AS slope, sign(close - ma) AS side, abs(close - ma) / ma * 100 AS gap FROM tb WHERE ma IS NOT NULL),
    td AS (SELECT symbol, date, CASE WHEN side > 0 THEN 'bullish' WHEN side < 0 THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN side = 0 THEN 0 ELSE least(0.1, least(gap / 5, 1) * 0.05 + greatest(0, side * slope) / 2 * 0.05) END AS trend FROM tc)"""
_RSI = f"ra AS (SELECT symbol, date, close, {rolling('avg({})', 14, 'gain')} AS up, {rolling('avg({})', 14, 'loss')} AS down FROM g), rs AS (SELECT symbol, date, close, CASE WHEN up IS NULL THEN NULL WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM ra)"
_DIVERGED = """r5 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 15)),
    re AS (SELECT symbol, min(row(close, i)) AS lo, min(row(-close, i)) AS hi FROM r5 GROUP BY symbol HAVING count(*) = 15),
    rp AS (SELECT r.symbol, any_value(a.rsi) - arg_min(r.rsi, row(r.close, r.i)) FILTER (r.i < lo[2]) AS up, arg_min(r.rsi, row(-r.close, r.i)) FILTER (r.i < hi[2]) - any_value(b.rsi) AS down FROM re JOIN r5 r USING (symbol) JOIN r5 a ON a.symbol = re.symbol AND a.i = lo[2] JOIN r5 b ON b.symbol = re.symbol AND b.i = hi[2] GROUP BY r.symbol),
    dv AS (SELECT symbol, CASE WHEN up > 5 THEN 'bullish' WHEN down > 5 THEN 'bearish' END AS kind, CASE WHEN up > 5 THEN least(up / 20, 1) WHEN down > 5 THEN least(down / 20, 1) END AS strength FROM rp)"""
_TURNS = f"""{averaged('me', 'w', {'ef': ('close', 2 / 13), 'es': ('close', 2 / 27)})}, md AS (SELECT symbol, date, ef - es AS dif FROM me), {averaged('ms', 'md', {'dea': ('dif', 0.2)})},
    mh AS (SELECT symbol, date, 2 * (dif - dea) AS hist, lag(2 * (dif - dea)) {OVER} AS was FROM ms),
    mt AS (SELECT *, CASE WHEN (hist > 0 AND was < 0) OR (hist < 0 AND was > 0) THEN CASE WHEN hist > 0 THEN 'bullish' ELSE 'bearish' END WHEN ((hist > 0 AND was > 0) OR (hist < 0 AND was < 0)) AND abs(hist) < abs(was) * 0.8 THEN CASE WHEN hist < 0 THEN 'bullish' ELSE 'bearish' END END AS kind,
           CASE WHEN (hist > 0 AND was < 0) OR (hist < 0 AND was > 0) THEN least(abs(hist - was) / 10, 1) WHEN abs(hist) < abs(was) * 0.8 THEN least((abs(was) - abs(hist)) / abs(was), 1) END AS strength FROM mh),
    bd AS (SELECT symbol, date, close, (close - min(low) OVER v) / nullif(max(high) OVER v - min(low) OVER v, 0) AS pos FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    tu AS (SELECT bd.symbol, bd.date, bd.close, CASE WHEN pos < 0.25 THEN 'call' WHEN pos > 0.75 THEN 'put' END AS b_kind, CASE WHEN pos < 0.25 THEN least((0.25 - pos) / 0.25, 1) WHEN pos > 0.75 THEN least((pos - 0.75) / 0.25, 1) END AS b_strength, dv.kind AS d_kind, dv.strength AS d_strength, mt.kind AS m_kind, mt.strength AS m_strength, td.direction, td.trend
           FROM bd LEFT JOIN dv USING (symbol) LEFT JOIN mt USING (symbol, date) LEFT JOIN td USING (symbol, date) QUALIFY row_number() OVER (PARTITION BY bd.symbol ORDER BY bd.date DESC) = 1)"""


def _turns(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    return O.underlying_turns(bars, S.daily_trend(bars))


@query("o1_turns", f"WITH {W}, {MOVES}, {_TREND}, {_RSI}, {_DIVERGED}, {_TURNS} SELECT symbol, date, b_kind, round(b_strength, 6) AS b_strength, d_kind, round(d_strength, 6) AS d_strength, m_kind, round(m_strength, 6) AS m_strength, direction, round(trend, 6) AS trend FROM tu")
def turns(spark, sf_dir):
    """Boundary rebound, RSI divergence and MACD turn of each underlying at its last bar (also J13)."""
    out = _turns(spark, sf_dir).select("symbol", "date", *[F.col(f"{p}.{c}").alias(f"{p[0]}_{c}") for p in ("boundary", "divergence", "macd") for c in ("kind", "strength")], "direction", "trend")
    return rounded(out, 6, "b_strength", "d_strength", "m_strength", "trend")


@query(
    "o1_option_signals",
    f"""WITH {W}, {MOVES}, {_TREND}, {_RSI}, {_DIVERGED}, {_TURNS}, {_WIDE}, {_CHANGE.format(by='')},
    sg AS (SELECT tu.*, k.kind, k.toward, least(0.7, coalesce(b_strength, 0) * 0.4 + coalesce(d_strength, 0) * 0.15 + coalesce(m_strength, 0) * 0.15) AS turn, coalesce(gs.score, 0) AS greeks, CASE WHEN direction = k.toward THEN trend ELSE 0 END AS tr,
           CASE CAST(substr(symbol, 7) AS INTEGER) % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS side
           FROM tu CROSS JOIN (VALUES ('call', 'bullish'), ('put', 'bearish')) k(kind, toward) LEFT JOIN gs ON gs.contract = tu.symbol AND gs.kind = k.kind),
    sh AS (SELECT *, turn + greeks + coalesce(tr, 0) AS strength FROM sg WHERE turn > 0 AND (b_kind = kind OR d_kind = toward OR m_kind = toward))
    SELECT symbol, date, kind, round(turn, 6) AS turn, round(greeks, 6) AS greeks, round(coalesce(tr, 0), 6) AS trend, round(strength, 6) AS strength, CASE WHEN strength >= 0.75 THEN 'strong' WHEN strength >= 0.55 THEN 'medium' ELSE 'weak' END AS level
    FROM sh WHERE strength >= CASE WHEN side = 'neutral' THEN 0.45 WHEN side = toward THEN 0.35 ELSE 0.55 END""",
)
def option_signals(spark, sf_dir):
    """Call and put signals of each brand, with the Greeks of its two contracts."""
    greeks = O.greeks_change(_wide(spark, sf_dir), ["contract", "kind"])
    score = O.greeks_score(F.col("delta_change"), F.col("gamma_peak"), F.col("iv_change"), F.col("quality"))
    turns_ = _turns(spark, sf_dir)
    number = F.substring("symbol", 7, 9).cast("int") % 3
    sides = turns_.select("symbol", F.when(number == 0, "bullish").when(number == 1, "bearish").otherwise("neutral").alias("side"))
    out = O.option_signals(turns_, greeks.select(F.col("contract").alias("symbol"), "kind", score.alias("score")), sides)
    return rounded(out, 6, "turn", "greeks", "trend", "strength")


_BANDS = f"""{TR}, kb AS (SELECT symbol, date, close, {rolling('avg({})', 14, 'tr')} AS atr, {rolling('avg({})', 20, 'close')} AS mid, {rolling('stddev_pop({})', 20, 'close')} AS dv FROM t),
    kr AS (SELECT symbol, date, close / lag(close) {OVER} - 1 AS ret FROM w), kh AS (SELECT symbol, date, CASE WHEN {rolling('stddev_samp({})', 20, 'ret')} * sqrt(252) * 100 > 500 THEN 500 ELSE {rolling('stddev_samp({})', 20, 'ret')} * sqrt(252) * 100 END AS hv, {rolling('stddev_samp({})', 10, 'ret')} * 100 AS intraday FROM kr),
    ki AS (SELECT symbol, date, close AS price, atr, hv, mid + 2 * dv AS band_upper, mid - 2 * dv AS band_lower, intraday, day(date) * 8 AS minutes FROM kb JOIN kh USING (symbol, date)),
    kx AS (SELECT *, sqrt(minutes / 240) AS lft, coalesce(atr, price * 0.01) * 2 AS a, price * coalesce(hv, 1.5) / 100 AS h, price * coalesce(intraday, 1.0) / 100 AS y FROM ki),
    kz AS (SELECT symbol, date, price, minutes, (price - a) * 0.3 + (price - h * lft) * 0.3 + coalesce(band_lower, price * 0.98) * 0.2 + (price - y * lft) * 0.2 AS range_lower, (price + a) * 0.3 + (price + h * lft) * 0.3 + coalesce(band_upper, price * 1.02) * 0.2 + (price + y * lft) * 0.2 AS range_upper FROM kx)"""


def _ranges(spark, sf_dir, sigma=None):
    from ..functions.windows import full, pct_change, series

    bars = weekly_bars(spark, sf_dir)
    w = series("symbol")
    ret = bars.select("symbol", "date", "close", pct_change("close", 1, w).alias("ret"))
    rows = ret.select("symbol", "date", F.col("close").alias("price"), (full(F.stddev_samp("ret"), 10, w, F.col("ret")) * 100).alias("intraday"), (F.day("date") * 8).alias("minutes"))
    rows = rows.join(atr(bars).select("symbol", "date", "atr"), ["symbol", "date"]).join(V.historical_volatility(bars, [20]).withColumnRenamed("hv20", "hv"), ["symbol", "date"])
    rows = rows.join(bollinger(bars).select("symbol", "date", F.col("upper").alias("band_upper"), F.col("lower").alias("band_lower")), ["symbol", "date"])
    rows = rows.join(sigma, "symbol", "left") if sigma is not None else rows.withColumn("sigma", F.lit(None).cast("double"))
    return O.underlying_range(rows)


@query("k7_underlying_range", f"WITH {W}, {_BANDS} SELECT symbol, date, round(range_lower, 6) AS range_lower, round(range_upper, 6) AS range_upper, 'blend' AS method FROM kz")
def underlying_range(spark, sf_dir):
    """What is left of a session: the blend of four ranges at every bar."""
    return rounded(_ranges(spark, sf_dir).select("symbol", "date", "range_lower", "range_upper", "method"), 6, "range_lower", "range_upper")


@query("k18_garch_range")
def garch_range(spark, sf_dir):
    """The same at each brand's last bar with the fitted volatility in front (K18)."""
    sigma = P.garch_forecast(weekly_bars(spark, sf_dir)).filter("converged").select("symbol", (F.col("sigma_next") / 1000).alias("sigma"))
    out = _ranges(spark, sf_dir, sigma)
    last = out.groupBy("symbol").agg(F.max("date").alias("date"))
    return rounded(out.join(last, ["symbol", "date"]).select("symbol", "date", "price", "range_lower", "range_upper", "method"), 6, "price", "range_lower", "range_upper")


_OPTION = """oi AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, 0.02 + (o_orderkey % 97) / 397 AS price, 3 + (o_orderkey % 41) / 20 AS spot, CASE WHEN o_orderkey % 5 > 0 THEN 3 + (o_orderkey % 37) / 18 END AS strike, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 19 - 9) / 10.0 END AS delta,
    CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 13) / 10.0 END AS gamma, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 29) / 5.0 END AS vega, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 61)::DOUBLE END AS iv, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 211)::DOUBLE END AS hv, o_orderkey % 241 AS minutes, CASE o_orderkey % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS trend FROM orders),
    oj AS (SELECT *, spot * (1 - (id % 23 + 1) / 503) AS lower, spot * (1 + (id % 17 + 1) / 499) AS upper FROM oi),
    om AS (SELECT *, CASE WHEN strike > 0 THEN spot / strike ELSE 1 END AS money FROM oj),
    og AS (SELECT *, coalesce(delta, CASE kind WHEN 'call' THEN 1 ELSE -1 END * CASE WHEN strike IS NULL THEN 0.2 WHEN kind = 'call' THEN CASE WHEN money < 0.95 THEN 0.1 WHEN money < 0.98 THEN 0.2 ELSE 0.3 END ELSE CASE WHEN money > 1.05 THEN 0.1 WHEN money > 1.02 THEN 0.2 ELSE 0.3 END END) AS d, coalesce(gamma, 0.02) AS ga, coalesce(vega, 0.001) AS ve,
           (upper - spot) / spot AS u, (spot - lower) / spot AS dn, (upper - lower) / spot AS rg, sqrt(minutes / 60000) AS sh, CASE WHEN iv > 0 AND CASE WHEN iv < 5 THEN iv * 100 ELSE iv END BETWEEN 5 AND 50 THEN CASE WHEN iv < 5 THEN iv * 100 ELSE iv END END AS v FROM om),
    oa AS (SELECT *, abs(CASE WHEN kind = 'call' THEN d * u + 0.5 * ga * u * u ELSE abs(d) * dn + 0.5 * ga * dn * dn END) AS ca, abs(CASE WHEN kind = 'call' THEN -d * dn + 0.5 * ga * dn * dn ELSE abs(d) * u + 0.5 * ga * u * u END) AS cb, CASE WHEN ve > 0 THEN least(0.2, ve * least(rg * 50, 5) / 100) ELSE 0 END AS vi, greatest(rg * 4, least(abs(d) * rg * spot / price, rg * 10)) AS lv, abs(d) * v / 100 * sh AS im FROM og),
    ob AS (SELECT *, greatest(lv, coalesce(im, 0)) + least(ca, 0.15) + vi * 1.5 AS a, greatest(lv, coalesce(im, 0)) + least(cb, 0.15) + vi * 1.5 AS b FROM oa),
    oc AS (SELECT *, CASE WHEN hv > 0 AND a + b > 0 THEN hv / 100 * sh / ((a + b) / 2) END AS ratio FROM ob),
    oe AS (SELECT *, CASE WHEN ratio IS NULL OR ratio <= 0 THEN 1 WHEN ratio > 1.3 THEN least(1.5, ratio) WHEN ratio < 0.7 THEN greatest(0.7, ratio) ELSE 1 + (ratio - 1) / 2 END * CASE WHEN abs(d) < 0.3 THEN 1 + (0.3 - abs(d)) * 1.5 ELSE 1 END AS f, CASE WHEN abs(d) < 0.3 THEN 0.6 ELSE 0.5 END AS most FROM oc),
    of_ AS (SELECT *, least(most, a * f * CASE trend WHEN 'up' THEN 1.1 WHEN 'down' THEN 0.9 ELSE 1 END) AS change_up, least(most, b * f * CASE trend WHEN 'up' THEN 0.9 WHEN 'down' THEN 1.1 ELSE 1 END) AS change_down FROM oe),
    oh AS (SELECT *, price * (1 + change_up) AS option_upper, greatest(0.001, price * (1 - change_down)) AS ol FROM of_)"""


@query("k12_option_range", f"WITH {_OPTION} SELECT id, round(change_up, 8) AS change_up, round(change_down, 8) AS change_down, round(option_upper, 8) AS option_upper, round(CASE WHEN option_upper <= ol THEN greatest(0.001, option_upper * 0.95) ELSE ol END, 8) AS option_lower FROM oh")
def option_range(spark, sf_dir):
    """The range of an option for every order: all branches of missing Greeks, volatility and trend come up."""
    k = F.col("o_orderkey")
    some = lambda n, x: F.when(k % n > 0, x)
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, "call").otherwise("put").alias("kind"), (0.02 + (k % 97) / 397).alias("price"), (3 + (k % 41) / 20).alias("spot"), some(5, 3 + (k % 37) / 18).alias("strike"), some(7, (k % 19 - 9) / 10.0).alias("delta"),
        some(11, (k % 13) / 10.0).alias("gamma"), some(6, (k % 29) / 5.0).alias("vega"), some(4, (k % 61).cast("double")).alias("iv"), some(3, (k % 211).cast("double")).alias("hv"), (k % 241).alias("minutes"), F.when(k % 5 == 0, "up").when(k % 5 == 1, "down").alias("trend"),
    )
    rows = rows.withColumns({"lower": F.col("spot") * (1 - (F.col("id") % 23 + 1) / 503), "upper": F.col("spot") * (1 + (F.col("id") % 17 + 1) / 499)})
    out = O.option_range(rows).select("id", "change_up", "change_down", "option_upper", "option_lower")
    return rounded(out, 8, "change_up", "change_down", "option_upper", "option_lower")
