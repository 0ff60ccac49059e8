"""Queries on snapshots, predictors, openings and short-term signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import bars as B
from ..operators import evaluation as E
from ..operators import snapshot as N
from .indicators import OVER, averaged, rolling
from .panels import D, W, daily_bars, rounded, table, ticks, weekly_bars

_RETURNS = ", ".join(f"close / nullif(lag(close, {k}) {OVER}, 0) - 1 AS ret{k}" for k in (5, 10, 20, 60))
_PERCENTILES = ", ".join(f"r{k} AS (SELECT symbol, CASE WHEN count(*) >= 20 THEN avg(CASE WHEN ret{k} <= now THEN 1.0 ELSE 0 END) * 100 END AS ret{k}_percentile FROM (SELECT symbol, ret{k}, first_value(ret{k}) OVER v AS now, row_number() OVER v AS n FROM ix WHERE ret{k} IS NOT NULL WINDOW v AS (PARTITION BY symbol ORDER BY date DESC)) WHERE n <= 500 GROUP BY symbol)" for k in (10, 20))


@query("s1_index_features", f"WITH {W}, ix AS (SELECT symbol, date, close, volume, row_number() {OVER} AS i, {_RETURNS}, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS v5 FROM w), {_PERCENTILES} SELECT symbol, date, round(close, 6) AS close, round(ret5, 6) AS ret5, round(ret10, 6) AS ret10, round(ret20, 6) AS ret20, round(ret60, 6) AS ret60, round(ret10_percentile, 4) AS ret10_percentile, round(ret20_percentile, 4) AS ret20_percentile, round(CASE WHEN i >= 6 THEN volume / nullif(v5, 0) END, 6) AS volume_ratio FROM (SELECT * FROM ix QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) LEFT JOIN r10 USING (symbol) LEFT JOIN r20 USING (symbol)")
def index_features(spark, sf_dir):
    out = N.index_features(weekly_bars(spark, sf_dir))
    return rounded(rounded(out, 6, "close", "ret5", "ret10", "ret20", "ret60", "volume_ratio"), 4, "ret10_percentile", "ret20_percentile")


@query(
    "s1_margin_change",
    """WITH r AS (SELECT o_orderpriority AS region, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS market, sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_custkey % 3 > 0 THEN o_totalprice END) AS total, sum(o_totalprice) AS financing FROM orders GROUP BY ALL),
    d AS (SELECT region, date, sum(total) AS total, sum(financing) AS financing FROM r GROUP BY ALL), m AS (SELECT region, date, CASE WHEN count(total) OVER (PARTITION BY region) > 0 THEN total ELSE financing END AS m FROM d), k AS (SELECT * FROM m WHERE m IS NOT NULL),
    l AS (SELECT *, lag(m) OVER (PARTITION BY region ORDER BY date) AS was FROM k QUALIFY row_number() OVER (PARTITION BY region ORDER BY date DESC) = 1)
    SELECT region, round(m, 2) AS margin_total, round((m - was) / was, 6) AS margin_change, round(least(0.3, greatest(-0.3, (m - was) / was * 10)), 6) AS margin_proxy, CASE WHEN was IS NULL THEN 'degraded' ELSE 'info' END AS status FROM l""",
)
def margin_change(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    total = F.when((F.col("o_orderpriority") != "1-URGENT") & (F.col("o_custkey") % 3 > 0), F.col("o_totalprice"))
    rows = o.groupBy(F.col("o_orderpriority").alias("region"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("market")).agg(F.sum(total).alias("total"), F.sum("o_totalprice").alias("financing"))
    return rounded(N.margin_change(rows, ["region"]), 2, "margin_total")


_SECTORS = "sx AS (SELECT p_brand AS day, p_name AS name, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 41 - 20) / 8.1 END AS change FROM part), sy AS (SELECT *, CASE WHEN abs(change) > 1 THEN change / 100 ELSE change END AS s FROM sx)"


def _sectors(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("day"), F.col("p_name").alias("name"), F.when(k % 7 > 0, (k % 41 - 20) / 8.1).alias("change"))


@query("s1_sector_change", f"WITH {_SECTORS} SELECT day, round(avg(s) FILTER (name LIKE '%ring%'), 8) AS rings, round(avg(s) FILTER (name LIKE '%red%' OR name LIKE '%blue%'), 8) AS colours FROM sy GROUP BY day")
def sector_change(spark, sf_dir):
    return rounded(N.sector_change(_sectors(spark, sf_dir), ["day"], {"rings": ("ring",), "colours": ("red", "blue")}), 8, "rings", "colours")


@query("s1_sector_leaders", f"WITH {_SECTORS}, st AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY s DESC, name, n) AS r FROM (SELECT day, name, s, 1 AS n FROM sy WHERE s IS NOT NULL AND trim(name) <> '') QUALIFY r <= 3) SELECT day, array_to_string(list(name ORDER BY r), ',') AS leaders, round(avg(s), 6) AS leadership FROM st GROUP BY day")
def sector_leaders(spark, sf_dir):
    return N.sector_leaders(_sectors(spark, sf_dir), ["day"]).withColumn("leaders", F.array_join("leaders", ","))


@query("s1_limit_ups", "WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CASE o_custkey % 7 WHEN 0 THEN '688' WHEN 1 THEN '300' WHEN 2 THEN '002' WHEN 3 THEN '000' ELSE '600' END AS p FROM orders) SELECT day, count(*) AS count, round(avg(CASE WHEN p IN ('300', '301', '002', '003', '000') THEN 1.0 ELSE 0 END), 4) AS small_ratio, round(avg(CASE WHEN p = '688' THEN 1.0 ELSE 0 END), 4) AS science_ratio FROM c GROUP BY day")
def limit_ups(spark, sf_dir):
    k = F.col("o_custkey") % 7
    rows = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("day"), F.concat(F.when(k == 0, "688").when(k == 1, "300").when(k == 2, "002").when(k == 3, "000").otherwise("600"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("code"))
    return N.limit_ups(rows, ["day"])


@query("s1_style_spread", f"WITH {W}, j AS (SELECT a.date, a.close AS x, b.close AS y FROM w a JOIN w b ON a.date = b.date AND a.symbol = 'Brand#3' AND b.symbol = 'Brand#7'), s AS (SELECT date, x / lag(x, 60) OVER (ORDER BY date) - y / lag(y, 60) OVER (ORDER BY date) AS s, count(*) OVER () AS dates FROM j), l AS (SELECT arg_max(s, date) AS now, any_value(dates) AS dates FROM s), p AS (SELECT s FROM s WHERE s IS NOT NULL ORDER BY date DESC LIMIT 1250) SELECT round(now, 6) AS spread, CASE WHEN dates > 250 AND (SELECT count(*) FROM p) >= 20 THEN round((SELECT avg(CASE WHEN s <= l.now THEN 1.0 ELSE 0 END) FROM p) * 100, 4) END AS percentile FROM l")
def style_spread(spark, sf_dir):
    return N.style_spread(weekly_bars(spark, sf_dir), "Brand#3", "Brand#7")


@query("s1_macro_flow", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 45 + o_orderkey % 11 END AS pmi, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 5 END AS cpi, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 9 - 4 END AS credit, o_orderkey % 20 AS lag_days, (o_totalprice - 150000) * CASE WHEN o_orderkey % 2 = 0 THEN 40000 ELSE 0.0004 END AS net FROM orders) SELECT o_orderkey, round(CASE WHEN pmi >= 50 THEN 0.3 WHEN pmi < 50 THEN -0.2 ELSE 0 END + CASE WHEN cpi <= 2 THEN 0.2 WHEN cpi >= 3 THEN -0.1 ELSE 0 END + CASE WHEN credit > 0 THEN 0.3 WHEN credit <= 0 THEN -0.1 ELSE 0 END, 4)::DOUBLE AS macro, CASE WHEN lag_days < 5 THEN 1.0 WHEN lag_days <= 15 THEN 0.5 ELSE 0 END::DOUBLE AS weight, round(CASE WHEN abs(net) > 1e5 THEN least(1, greatest(-1, net / 5e9)) ELSE least(1, greatest(-1, net / 50)) END, 4) + 0 AS flow FROM x")
def macro_flow(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    macro = N.macro_proxy(F.when(k % 5 > 0, 45 + k % 11), F.when(k % 7 > 0, c % 5), F.when(k % 3 > 0, c % 9 - 4), k % 20)
    net = (F.col("o_totalprice") - 150000) * F.when(k % 2 == 0, 40000.0).otherwise(0.0004)
    return table(spark, sf_dir, "orders").select("o_orderkey", macro["score"].alias("macro"), macro["weight"].alias("weight"), N.flow_score(net).alias("flow"))


_INPUTS = "ip AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 23 - 11) / 101.0::DOUBLE END AS a, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 31 - 15) / 103.0::DOUBLE END AS b, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 37 - 18) / 107.0::DOUBLE END AS c, CASE WHEN o_orderkey % 9 > 0 THEN (o_custkey % 29) / 97.0::DOUBLE END AS q, CASE WHEN o_orderkey % 8 > 0 THEN 0.5 + (o_custkey % 13) / 11.0::DOUBLE END AS v, CASE WHEN o_orderkey % 10 > 0 THEN o_custkey % 83 END AS n FROM orders)"
_C0 = {x: f"coalesce({x}, 0)" for x in "abcqn"}


@query(
    "s2_sector_predictors",
    f"""WITH {_INPUTS} SELECT k, round((coalesce(a, 0) * 0.35 + coalesce(b, 0) * 0.25 + coalesce(c, 0) * 0.15) * 0.5 + CASE WHEN coalesce(v, 1) < 0.8 THEN CASE WHEN coalesce(c, 0) > 0.05 THEN -0.15 WHEN coalesce(c, 0) < -0.03 THEN 0.10 ELSE 0 END ELSE 0 END * 0.3 + CASE WHEN coalesce(c, 0) > 0.02 THEN 0.08 WHEN coalesce(c, 0) < -0.02 THEN -0.05 ELSE 0 END * 0.2, 8) AS leading,
    round(coalesce(a, 0) * 0.5 + CASE WHEN coalesce(n, 0) >= 70 THEN -0.08 WHEN coalesce(n, 0) >= 40 THEN -0.04 WHEN coalesce(n, 0) <= 10 THEN 0.04 ELSE 0 END * 0.3 + CASE WHEN coalesce(c, 0) > 0.03 THEN 0.1 WHEN coalesce(c, 0) < -0.03 THEN -0.05 ELSE 0 END * 0.2, 8) AS industry,
    round(least(1, greatest(-1, coalesce(b, 0))) * 0.4 + CASE WHEN coalesce(q, 0) > 0.12 THEN -0.1 WHEN coalesce(q, 0) < 0.04 THEN 0.05 ELSE 0 END * 0.3 + CASE WHEN coalesce(c, 0) > 0.03 THEN 0.1 WHEN coalesce(c, 0) < -0.03 THEN -0.1 ELSE 0 END * 0.2 + least(0.2, greatest(-0.2, coalesce(a, 0))) * 0.1, 8) AS science,
    round(CASE WHEN coalesce(c, 0) > 0.08 THEN -0.35 WHEN coalesce(c, 0) > 0.04 THEN -0.2 WHEN coalesce(c, 0) < -0.08 THEN 0.35 WHEN coalesce(c, 0) < -0.04 THEN 0.2 ELSE 0 END * 0.45 + CASE WHEN coalesce(q, 0) > 0.25 THEN -0.15 WHEN coalesce(q, 0) > 0.18 THEN -0.08 ELSE 0 END * 0.2 + least(0.1, greatest(-0.1, coalesce(a, 0))) * 0.1 + CASE WHEN coalesce(b, 0) > 0.02 THEN -0.05 WHEN coalesce(b, 0) < -0.02 THEN 0.05 ELSE 0 END * 0.1 + least(0.08, greatest(-0.08, coalesce(v, 0) * 0.15)) * 0.05 + coalesce(b, 0) * 0.2, 8) AS small_cap FROM ip""",
)
def sector_predictors(spark, sf_dir):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda n, x: F.when(k % n > 0, x)
    a, b, c, q, v, n = some(6, (k % 23 - 11) / 101.0), some(4, (u % 31 - 15) / 103.0), some(5, (k % 37 - 18) / 107.0), some(9, (u % 29) / 97.0), some(8, 0.5 + (u % 13) / 11.0), some(10, u % 83)
    out = table(spark, sf_dir, "orders").select(k.alias("k"), N.leading_sector_score(a, b, c, c, v).alias("leading"), N.industry_score(a, n, c).alias("industry"), N.science_score(b, q, c, a).alias("science"), N.small_cap_score(c, b, q, a, v, b).alias("small_cap"))
    return rounded(out, 8, "leading", "industry", "science", "small_cap")


@query("n4_opening_strength", f"WITH {W}, a AS (SELECT *, (open - lag(close) {OVER}) / nullif(lag(close) {OVER}, 0) * 100 AS change FROM w), b AS (SELECT *, avg(change) OVER v AS c5, avg(volume) OVER v AS v5 FROM a WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), s AS (SELECT symbol, date, change, coalesce(CASE WHEN v5 > 0 THEN volume / v5 - 1 END, 0) AS vd, change - coalesce(c5, 0) AS hd FROM b WHERE change IS NOT NULL), t AS (SELECT *, least(1, greatest(-1, change / 2)) * 0.5 + vd * 0.3 + hd / 2 * 0.2 AS score FROM s) SELECT symbol, date, round(change, 6) AS change, round(vd, 6) AS volume_dev, round(hd, 6) AS history_dev, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 'strong' WHEN score < -0.5 THEN 'weak' ELSE 'neutral' END AS strength FROM t")
def opening_strength(spark, sf_dir):
    return rounded(N.opening_strength(weekly_bars(spark, sf_dir)), 6, "change", "volume_dev", "history_dev", "score")


_FINE = "fi AS (SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTES, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTES AS date, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL), da AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, row(ts, event_id)) AS close FROM events GROUP BY ALL)"


@query(
    "o3_short_term",
    f"""WITH {_FINE}, {averaged('oe', 'da', {'ef': ('close', 2 / 13), 'es': ('close', 2 / 27)})}, od AS (SELECT symbol, date, close, ef - es AS dif FROM oe), {averaged('os', 'od', {'dea': ('dif', 0.2)})},
    oh AS (SELECT symbol, date, close, 2 * (dif - dea) AS hist, lag(2 * (dif - dea)) {OVER} AS was, {rolling('avg({})', 20, 'close')} AS ma20 FROM os),
    of1 AS (SELECT symbol, CAST(date AS DATE) AS day, date, close AS price, lag(close) {OVER} AS before, {rolling('avg({})', 10, 'close')} AS ma10, volume / {rolling('avg({})', 10, 'volume')} AS ratio FROM fi), of2 AS (SELECT * FROM of1 QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY date DESC) = 1),
    oj AS (SELECT h.symbol, f.day, h.close, ma20, hist, was, price, before, ma10, ratio, abs(price - ma10) / ma10 < 0.01 AS near FROM oh h JOIN of2 f ON f.symbol = h.symbol AND f.day = h.date WHERE ma20 IS NOT NULL AND ma10 > 0),
    ok AS (SELECT *, close > ma20 AND (near OR price < ma10) AND price > before AND ratio >= 1.2 AS buy, close < ma20 AND (near OR price > ma10) AND price < before AS sell FROM oj),
    ol AS (SELECT *, CASE WHEN buy THEN least(0.85, 0.6 + CASE WHEN was < 0 AND hist > 0 THEN 0.1 ELSE 0 END + CASE WHEN ratio > 1.3 THEN 0.05 ELSE 0 END + CASE WHEN ratio > 1.5 THEN 0.1 ELSE 0 END) WHEN sell THEN 0.6 + CASE WHEN was > 0 AND hist < 0 THEN 0.1 ELSE 0 END END AS strength FROM ok)
    SELECT symbol, day, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS signal, round(strength, 6)::DOUBLE AS strength, CASE WHEN strength >= 0.75 THEN 0.65 WHEN strength >= 0.65 THEN 0.4 ELSE 0.1 END::DOUBLE AS position, round(ma20 * 0.95, 6) AS stop_loss, round(close * 1.03, 5) AS take_profit FROM ol WHERE strength >= 0.6""",
)
def short_term(spark, sf_dir):
    """Daily and half-hour bars of events."""
    t = ticks(spark, sf_dir)
    fine = B.ohlcv(t, ["symbol"], B.right_closed("ts", 30), "price", "volume", ["ts", "event_id"])
    day = B.ohlcv(t, ["symbol"], F.to_date("ts"), "price", "volume", ["ts", "event_id"])
    return rounded(rounded(N.short_term_signals(day, fine), 6, "strength", "stop_loss"), 5, "take_profit")


@query("o5_candidates", "WITH x AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'BUY' WHEN 1 THEN ' sell ' WHEN 2 THEN 'trend-follow' WHEN 3 THEN 'put' WHEN 4 THEN NULL WHEN 5 THEN 'call' ELSE 'hold' END AS t, CASE o_orderkey % 6 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' WHEN 2 THEN '0.35' WHEN 3 THEN '62' WHEN 4 THEN NULL ELSE 'x' END AS s, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 23) / 19 END AS c FROM orders), y AS (SELECT o_orderkey, CASE WHEN lower(trim(t)) IN ('buy', 'call') OR (t LIKE '%trend%' AND t LIKE '%follow%') THEN 'long' WHEN lower(trim(t)) IN ('sell', 'put') THEN 'short' ELSE 'neutral' END AS direction, CASE s WHEN 'High' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN '0.35' THEN 0.35 WHEN '62' THEN 0.62 ELSE 0 END AS size, least(1, greatest(0, coalesce(c, 0.35))) AS sure FROM x) SELECT o_orderkey, direction, round(CASE direction WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END * CASE WHEN size <> 0 THEN size ELSE sure END, 8)::DOUBLE AS score, round(CASE WHEN sure > 0 THEN sure ELSE 0.35 END, 8)::DOUBLE AS confidence FROM y")
def candidates(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("BUY", " sell ", "trend-follow", "put", None, "call", "hold")]), (k % 7).cast("int"))
    strength = F.get(F.array(*[F.lit(x) for x in ("High", "medium", "0.35", "62", None, "x")]), (k % 6).cast("int"))
    made = N.candidate(kind, strength, F.when(k % 4 > 0, (F.col("o_custkey") % 23) / 19))
    out = table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(n) for n, v in made.items()])
    return rounded(out, 8, "score", "confidence")


@query("n9_consistency", f"WITH {W}, {D}, p AS (SELECT w.symbol, w.date, w.close / 10 AS price, avg(w.close) OVER (PARTITION BY w.date) AS index_price FROM w), r AS (SELECT *, index_price / nullif(price, 0) AS ratio FROM p), q AS (SELECT *, {rolling('avg({})', 20, 'ratio', 1)} AS base FROM r) SELECT symbol, date, round(ratio, 6) AS ratio, round(abs((ratio - base) / base) * 100, 6) AS deviation, CASE WHEN abs((ratio - base) / base) * 100 <= 20 THEN 'trend_follow' END AS signal FROM q")
def consistency(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("symbol", "date", "close")
    index = bars.groupBy("date").agg(F.avg("close").alias("index_price"))
    out = N.etf_consistency(bars.join(index, "date").select("symbol", "date", (F.col("close") / 10).alias("price"), "index_price"), most=20.0)
    return rounded(out.select("symbol", "date", "ratio", "deviation", "signal"), 6, "ratio", "deviation")


@query("k4_near_money", "WITH o AS (SELECT 'u' || o_custkey % 30 AS underlying, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, 100.0 AS spot, CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey % 4 * 21 + 3 AS INTEGER) AS expiry, CASE WHEN o_orderkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, 90 + o_custkey % 21 AS strike, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice / 9973 END AS iv FROM orders), f AS (SELECT *, expiry - day AS days FROM o WHERE expiry - day >= 7), x AS (SELECT underlying, day, min(expiry) AS expiry FROM f WHERE kind = 'call' GROUP BY ALL), r AS (SELECT f.* FROM f JOIN x USING (underlying, day, expiry)), s AS (SELECT underlying, day, min(row(abs(strike - spot), strike))[2] AS strike FROM r WHERE kind = 'call' GROUP BY ALL), m AS (SELECT underlying, day, expiry, strike, any_value(days) AS days, avg(iv) FILTER (kind = 'call') AS c, avg(iv) FILTER (kind = 'put') AS p FROM r JOIN s USING (underlying, day, strike) GROUP BY ALL), i AS (SELECT *, coalesce((c + p) / 2, c, p) AS iv FROM m) SELECT underlying, day, expiry, strike::DOUBLE AS strike, round(iv, 6) AS iv, round(CASE WHEN days >= 30 THEN iv * sqrt(days / 30) END, 6) AS iv_30d FROM i")
def near_money(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.trunc("o_orderdate", "month")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey") % 30).alias("underlying"), day.alias("day"), F.lit(100.0).alias("spot"), F.date_add(day, (k % 4 * 21 + 3).cast("int")).alias("expiry"), F.when(k % 2 == 0, "call").otherwise("put").alias("kind"), (90 + F.col("o_custkey") % 21).cast("double").alias("strike"), F.when(k % 9 > 0, F.col("o_totalprice") / 9973).alias("iv"))
    return rounded(N.near_money_volatility(rows), 6, "iv", "iv_30d")


@query("s5_event_gate", "SELECT doc_id, round(CASE WHEN regexp_matches(t, '\\bboj\\b|bank of japan') THEN 0.25 ELSE 0 END + CASE WHEN t LIKE '%tankan%' THEN 0.18 ELSE 0 END + CASE WHEN regexp_matches(t, '\\bfomc\\b|federal reserve') THEN 0.25 ELSE 0 END, 4)::DOUBLE AS risk FROM (SELECT event_id AS doc_id, lower(CASE event_id % 5 WHEN 0 THEN 'BOJ and Tankan' WHEN 1 THEN 'the Federal Reserve' WHEN 2 THEN 'fomcx' ELSE event_type END) AS t FROM events)")
def event_gate(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 5 == 0, "BOJ and Tankan").when(k % 5 == 1, "the Federal Reserve").when(k % 5 == 2, "fomcx").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(k.alias("doc_id"), N.event_gate(text)["risk"].alias("risk"))


@query(
    "s5_overnight_forecast",
    """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 61 - 30) / 11.0::DOUBLE END AS f, CASE WHEN o_orderkey % 5 > 0 THEN (o_custkey % 71 - 40) / 13.0::DOUBLE END AS pr, o_orderkey % 3 = 0 AS cv, o_custkey % 8 AS n, (o_custkey % 9) / 10.0::DOUBLE AS cr, (o_orderkey % 47 - 23) / 9.0::DOUBLE AS ir, (o_custkey % 101)::DOUBLE AS rsi, (o_orderkey % 17 - 8)::DOUBLE AS dv, o_orderkey % 7 = 0 AS bad, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 11) / 10.0::DOUBLE END AS base, o_custkey % 70 AS bn FROM orders),
    y AS (SELECT *, greatest(-0.5, least(0.55, CASE WHEN pr <= -1.2 THEN least(0.42, abs(pr) / 11) ELSE 0 END - CASE WHEN pr >= 2 THEN 0.11 ELSE 0 END + CASE WHEN cv AND pr < -1 THEN 0.11 ELSE 0 END)) AS v, -least(0.16, 0.028 * n) + CASE WHEN ir <= -1.5 THEN 0.05 WHEN ir >= 1.5 THEN -0.045 ELSE 0 END AS e,
          least(0.96, cr + least(0.26, CASE WHEN ir <= -1.5 THEN 0.12 ELSE 0 END + CASE WHEN rsi >= 70 OR rsi <= 30 THEN 0.08 ELSE 0 END + CASE WHEN abs(dv) >= 5 THEN 0.08 ELSE 0 END + CASE WHEN bad THEN 0.08 ELSE 0 END)) AS risk FROM x),
    z AS (SELECT *, 0.5 + (1 - 0.62 * risk) * (1 / (1 + exp(-1.35 * (0.38 * coalesce((exp(2 * f / 1.5) - 1) / (exp(2 * f / 1.5) + 1), 0) + 0.22 * v + 0.25 * e))) - 0.5) AS s, CASE WHEN base IS NOT NULL AND bn >= 18 THEN 0.24 * least(1, (bn - 12) / 48) ELSE 0 END AS w FROM y),
    q AS (SELECT *, least(0.999, greatest(0.001, (1 - w) * s + w * coalesce(base, 0))) AS p FROM z) SELECT k, round(risk, 8) AS event_risk, round(p, 8) AS p_up, CASE WHEN abs(p - 0.5) < 0.018 THEN 'flat' WHEN p >= 0.5 THEN 'up' ELSE 'down' END AS direction FROM q""",
)
def overnight_forecast(spark, sf_dir):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda n, x: F.when(k % n > 0, x)
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), some(6, (k % 61 - 30) / 11.0).alias("futures"), some(5, (u % 71 - 40) / 13.0).alias("premium"), (k % 3 == 0).alias("converging"), (u % 8).alias("triggers"), ((u % 9) / 10.0).alias("calendar_risk"), ((k % 47 - 23) / 9.0).alias("index_ret"),
        (u % 101).cast("double").alias("rsi"), (k % 17 - 8).cast("double").alias("deviation"), (k % 7 == 0).alias("premium_bad"), some(4, (u % 11) / 10.0).alias("base"), (u % 70).alias("base_n"),
    )
    return rounded(N.overnight_forecast(rows).select("k", "event_risk", "p_up", "direction"), 8, "event_risk", "p_up")


@query("k17_liquidity_grade", "WITH x AS (SELECT o_orderkey, (o_orderkey % 97) / 9.3::DOUBLE AS spread, o_custkey % 230 AS depth, (o_custkey % 11) / 10.0::DOUBLE AS im, o_orderkey % 5 = 0 AS est FROM orders), g AS (SELECT *, CASE WHEN spread <= 0.5 AND depth >= 100 THEN 'excellent' WHEN spread <= 1.5 AND depth >= 50 THEN 'good' WHEN spread <= 4 AND depth >= 15 THEN 'fair' WHEN spread <= 8 AND depth >= 8 THEN 'poor' ELSE 'critical' END AS grade, least(100, greatest(0, round(greatest(0, 100 - spread * 10) * 0.4 + least(100, depth / 2) * 0.4 + (1 - im) * 100 * 0.2, 1))) AS s FROM x) SELECT o_orderkey, grade, grade <> 'critical' AS tradable, CASE WHEN est THEN least(50, s) ELSE s END::DOUBLE AS score FROM g")
def liquidity_grade(spark, sf_dir):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    made = N.liquidity_grade((k % 97) / 9.3, u % 230, (u % 11) / 10.0, k % 5 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(n) for n, v in made.items()])


@query("d11_weekly_metrics", "WITH r AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderpriority AS method, o_custkey % 30 AS symbol, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice > 150000 END AS hit, (o_custkey % 10) / 9.0::DOUBLE AS p, o_orderkey % 8 = 0 AS degraded FROM orders), s AS (SELECT week, method, symbol, count(*) AS n FROM r GROUP BY ALL), h AS (SELECT week, method, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM s GROUP BY ALL) SELECT week, method, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0 END), 8) AS hit_rate, round(avg(CASE WHEN hit IS NOT NULL THEN (p - hit::INT) ** 2 END), 8) AS brier, round(avg(degraded::INT), 8) AS degraded_share, round(any_value(hhi), 8) AS concentration FROM r JOIN h USING (week, method) GROUP BY week, method")
def weekly_metrics(spark, sf_dir):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("week"), F.col("o_orderpriority").alias("method"), (u % 30).alias("symbol"), F.when(k % 6 > 0, F.col("o_totalprice") > 150000).alias("hit"), ((u % 10) / 9.0).alias("p"), (k % 8 == 0).alias("degraded"))
    return rounded(E.prediction_metrics(rows, ["week", "method"]), 8, "hit_rate", "brier", "degraded_share", "concentration")
