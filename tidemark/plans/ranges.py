"""Queries on ranges held against the market, votes of models, and event back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.windows import series
from ..operators import ranges as G
from .indicators import crossing, rolling
from .panels import W, rounded, table, weekly_bars

_QUOTES = """q AS (SELECT p_partkey AS id, p_retailprice * (0.9 + (p_partkey % 7) / 100.0::DOUBLE) AS lower, p_retailprice * (CASE WHEN p_partkey % 23 = 0 THEN 0.8 ELSE 1.02 END + (p_partkey % 11) / 100.0::DOUBLE) AS upper,
    CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE p_retailprice * (0.97 + (p_partkey % 13) / 100.0::DOUBLE) END AS bid, p_retailprice * (1.0 + (p_partkey % 13) / 100.0::DOUBLE) AS ask, p_partkey % 5 > 0 AS tradable, p_partkey % 3 = 0 AS estimated, p_size + 1 AS bid_size, p_partkey % 40 + 1 AS ask_size FROM part)"""


def quotes(spark, sf_dir):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (price * (0.9 + k % 7 / 100)).alias("lower"), (price * (F.when(k % 23 == 0, 0.8).otherwise(1.02) + k % 11 / 100)).alias("upper"), F.when(k % 29 == 0, 0.0).otherwise(price * (0.97 + k % 13 / 100)).alias("bid"),
        (price * (1.0 + k % 13 / 100)).alias("ask"), (k % 5 > 0).alias("tradable"), (k % 3 == 0).alias("estimated"), (F.col("p_size") + 1).alias("bid_size"), (k % 40 + 1).alias("ask_size"),
    )


@query(
    "k17_quoted_range",
    f"""WITH {_QUOTES}, m AS (SELECT *, (bid + ask) / 2 AS mid, CASE WHEN tradable THEN bid * 0.98 ELSE (bid + ask) / 2 * 0.95 END AS le, CASE WHEN tradable THEN ask * 1.02 ELSE (bid + ask) / 2 * 1.05 END AS he FROM q),
    c AS (SELECT *, greatest(lower, le) AS a, least(upper, he) AS b, lower >= upper AS odd, bid <= 0 OR ask <= 0 AS dead, (le + he) / 2 AS ctr FROM m),
    d AS (SELECT *, CASE WHEN odd OR dead THEN 0 WHEN ctr > 0 THEN abs(((lower + upper) / 2 - ctr) / ctr * 100) ELSE 0 END AS dev FROM c)
    SELECT id, round(CASE WHEN odd THEN mid * 0.95 WHEN dead THEN lower WHEN a >= b THEN mid * 0.95 ELSE a END, 6) AS low, round(CASE WHEN odd THEN mid * 1.05 WHEN dead THEN upper WHEN a >= b THEN mid * 1.05 ELSE b END, 6) AS high,
      CASE WHEN odd OR dead OR a >= b THEN 'fallback' ELSE 'success' END AS status, round(CASE WHEN odd OR dead THEN 0.5 ELSE greatest(0.5, least(1, CASE WHEN dev <= 20 THEN 1 - dev / 20 * 0.3 ELSE 0.7 END * CASE WHEN estimated THEN 0.8 ELSE 1 END)) END, 6)::DOUBLE AS confidence, round(dev, 6)::DOUBLE AS deviation,
      round((ask - bid) / nullif(mid, 0) * 100, 6) AS spread, round((bid_size - ask_size) / (bid_size + ask_size), 6) AS imbalance FROM d""",
)
def quoted_range(spark, sf_dir):
    c = F.col
    x = quotes(spark, sf_dir)
    made = G.quoted_range(c("lower"), c("upper"), c("bid"), c("ask"), c("tradable"), c("estimated")) | G.liquidity(c("bid"), c("ask"), c("bid_size"), c("ask_size"))
    return rounded(x.select("id", *[v.alias(k) for k, v in made.items()]), 6, "low", "high", "confidence", "deviation", "spread", "imbalance")


@query(
    "i05_realised_range",
    """WITH x AS (SELECT p_partkey AS id, p_retailprice * 0.98 AS lower, p_retailprice * 1.02 AS upper, p_retailprice * (0.975 + (p_partkey % 51) / 1000.0::DOUBLE) AS price, 4.0 AS pct, (p_partkey % 90) / 10.0::DOUBLE AS vol, (p_partkey % 7 - 3) / 1000.0::DOUBLE AS trend FROM part),
    f AS (SELECT *, CASE WHEN vol / pct > 1.2 THEN least(1.5, 1 + (vol / pct - 1.2) * 0.5) ELSE 1 END AS f FROM x), r AS (SELECT *, (upper + lower) / 2 - (upper - lower) / 2 * f AS lo, (upper + lower) / 2 + (upper - lower) / 2 * f AS hi FROM f), p AS (SELECT *, (price - lo) / (hi - lo) AS pos FROM r)
    SELECT id, round(CASE WHEN pos < 0.15 AND trend < -0.001 THEN lo - (hi - lo) * 0.1 ELSE lo END, 6) AS low, round(CASE WHEN pos > 0.85 AND trend > 0.001 THEN hi + (hi - lo) * 0.1 ELSE hi END, 6) AS high FROM p""",
)
def realised_range(spark, sf_dir):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    made = G.realised_range(price * 0.98, price * 1.02, price * (0.975 + k % 51 / 1000), F.lit(4.0), k % 90 / 10, (k % 7 - 3) / 1000)
    return table(spark, sf_dir, "part").select(k.alias("id"), *[F.round(v, 6).alias(n) for n, v in made.items()])


@query(
    "k16_iv_scaled",
    """WITH x AS (SELECT p_partkey AS id, p_retailprice * 0.97 AS lower, p_retailprice * 1.03 AS upper, (0.1 + (p_partkey % 37) / 100.0::DOUBLE) / 0.25 AS r FROM part),
    s AS (SELECT *, CASE WHEN r > 1.15 THEN 1 + least(0.3, (r - 1.15) * 0.5) WHEN r < 0.85 THEN 1 - least(0.15, (0.85 - r) * 0.3) ELSE 1 END AS a, greatest(0.7, least(1.5, 0.6 * r + 0.4)) AS b FROM x)
    SELECT id, round(greatest(0, (upper + lower) / 2 - (upper - lower) / 2 * a), 6) AS low, round((upper + lower) / 2 + (upper - lower) / 2 * a, 6) AS high, round(a, 6) AS scale, round(b, 6) AS fused_scale FROM s""",
)
def iv_scaled(spark, sf_dir):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    iv, hv = 0.1 + k % 37 / 100, F.lit(0.25)
    made = G.iv_scaled(price * 0.97, price * 1.03, iv, hv)
    fused = G.iv_scaled(price * 0.97, price * 1.03, iv, hv, 0.6)["scale"]
    return table(spark, sf_dir, "part").select(k.alias("id"), *[F.round(v, 6).alias(n) for n, v in made.items()], F.round(fused, 6).alias("fused_scale"))


@query(
    "k09_session_range",
    """WITH x AS (SELECT p_partkey AS id, p_retailprice AS price, p_size / 2.0::DOUBLE AS atr, (p_partkey % 40)::DOUBLE AS hv, p_partkey % 260 - 10 AS m FROM part), y AS (SELECT *, sqrt(greatest(m, 0) / 240.0::DOUBLE) AS root FROM x),
    z AS (SELECT id, price, greatest(0.5, least(4, (atr * 1.5 * root * 0.6 + price * hv / 100 * root * 0.4) * 2 / price * 100)) AS pct FROM y) SELECT id, round(price - price * pct / 200, 6) AS low, round(price + price * pct / 200, 6) AS high, round(pct, 6) AS range_pct FROM z""",
)
def session_range(spark, sf_dir):
    k = F.col("p_partkey")
    made = G.session_range(F.col("p_retailprice"), F.col("p_size") / 2, (k % 40).cast("double"), k % 260 - 10)
    return table(spark, sf_dir, "part").select(k.alias("id"), *[F.round(v, 6).alias(n) for n, v in made.items()])


@query(
    "k08_blended_periods",
    f"""WITH {W}, a AS (SELECT symbol, date, 0.6 AS weight, {rolling('min({})', 6, 'low')} AS lower, {rolling('max({})', 6, 'high')} AS upper, 0.5 AS confidence FROM w UNION ALL SELECT symbol, date, 0.4, {rolling('min({})', 3, 'low')}, {rolling('max({})', 3, 'high')}, 0.7 FROM w)
    SELECT symbol, date, round(sum(lower * weight) / sum(weight), 6) AS lower, round(sum(upper * weight) / sum(weight), 6) AS upper, round(sum(confidence * weight) / sum(weight), 6)::DOUBLE AS confidence FROM a WHERE lower IS NOT NULL GROUP BY symbol, date""",
)
def blended_periods(spark, sf_dir):
    from ..functions.windows import full

    bars, w = weekly_bars(spark, sf_dir), series("symbol")
    one = lambda n, weight, sure: bars.select("symbol", "date", F.lit(weight).alias("weight"), full(F.min("low"), n, w, F.col("low")).alias("lower"), full(F.max("high"), n, w, F.col("high")).alias("upper"), F.lit(sure).alias("confidence"))
    rows = one(6, 0.6, 0.5).union(one(3, 0.4, 0.7)).filter("lower IS NOT NULL")
    return rounded(G.blended(rows, ["symbol", "date"]), 6, "lower", "upper", "confidence")


_VOTES = """v AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'neutral' END AS pd, (o_orderkey % 97) / 97.0::DOUBLE AS pc, CASE o_custkey % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'neutral' END AS ad, (o_custkey % 89) / 89.0::DOUBLE AS ac,
    CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'up' WHEN 2 THEN 'down' ELSE 'neutral' END AS td, (o_orderkey % 83) / 83.0::DOUBLE AS tc FROM orders)"""
_VAL = "CASE {0} WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END"


@query(
    "o2_model_vote",
    f"""WITH {_VOTES}, s AS (SELECT *, {_VAL.format('pd')} * 0.35::DOUBLE * pc + {_VAL.format('ad')} * 0.30::DOUBLE * ac + {_VAL.format('td')} * 0.35::DOUBLE * tc AS score FROM v),
    g AS (SELECT *, ({_VAL.format('pd')} * score > 0)::INT + ({_VAL.format('ad')} * score > 0)::INT + ({_VAL.format('td')} * score > 0)::INT AS n,
      CASE WHEN pc > CASE WHEN pd = 'down' THEN 0.72 ELSE 0.70 END AND pd <> 'neutral' AND ((ad = 'neutral' AND td = 'neutral') OR (pc >= ac AND pc >= tc)) THEN 'prophet'
           WHEN ac > 0.65 AND ad <> 'neutral' AND ((pd = 'neutral' AND td = 'neutral') OR (ac >= pc AND ac >= tc)) THEN 'arima'
           WHEN tc > 0.80 AND td <> 'neutral' AND ((pd = 'neutral' AND ad = 'neutral') OR (tc >= pc AND tc >= ac)) THEN 'technical' END AS alone FROM s)
    SELECT id, round(score, 6) AS score, CASE WHEN score > 0.45 AND n >= 2 THEN 'up' WHEN score < -0.55 AND n >= 2 THEN 'down' WHEN alone = 'prophet' THEN pd WHEN alone = 'arima' THEN ad WHEN alone = 'technical' THEN td ELSE 'neutral' END AS direction,
      round(CASE WHEN (score > 0.45 OR score < -0.55) AND n >= 2 THEN least(abs(score), 1) WHEN alone = 'prophet' THEN pc WHEN alone = 'arima' THEN ac WHEN alone = 'technical' THEN tc ELSE 0.5 END, 6)::DOUBLE AS confidence,
      CASE WHEN (score > 0.45 OR score < -0.55) AND n >= 2 THEN 'agreement' ELSE coalesce(alone, 'neutral') END AS kind FROM g""",
)
def model_vote(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = lambda x: F.when(x == 0, "up").when(x == 1, "down").otherwise("neutral")
    t = (k + c) % 5
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), side(k % 3).alias("prophet_dir"), (k % 97 / 97).alias("prophet_conf"), side(c % 4).alias("arima_dir"), (c % 89 / 89).alias("arima_conf"),
        F.when(t < 2, "up").when(t == 2, "down").otherwise("neutral").alias("technical_dir"), (k % 83 / 83).alias("technical_conf"),
    )
    return rounded(G.vote(rows).select("id", "score", "direction", "confidence", "kind"), 6, "score", "confidence")


_CROSS = f"cx AS (SELECT symbol, date, {rolling('avg({})', 20, 'close')} AS f, {rolling('avg({})', 50, 'close')} AS s FROM w), cy AS (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY date) AS sp, {crossing('f', 's')} AS x FROM cx), ev AS (SELECT symbol, date, CASE x WHEN 'golden' THEN 'entry' ELSE 'exit' END AS event FROM cy WHERE x <> 'none' AND sp IS NOT NULL)"
_TRADES = """fe AS (SELECT * FROM (SELECT *, lag(event) OVER (PARTITION BY symbol ORDER BY date) AS was FROM ev) WHERE was IS NULL OR was <> event), pr AS (SELECT fe.symbol, fe.date, fe.event, w.close, lead(fe.date) OVER v AS nd, lead(w.close) OVER v AS nc FROM fe JOIN w USING (symbol, date) WINDOW v AS (PARTITION BY fe.symbol ORDER BY fe.date)),
    en AS (SELECT symbol, max(date) AS ed, arg_max(close, date) AS ec FROM w GROUP BY symbol) SELECT symbol, date AS entry_date, coalesce(nd, ed) AS exit_date, round((coalesce(nc, ec) - close) / close * 100, 6) AS pnl_pct FROM pr JOIN en USING (symbol) WHERE event = 'entry'"""


@query("q2_crossover_events", f"WITH {W}, {_CROSS} SELECT symbol, date, event FROM ev")
def crossover_events(spark, sf_dir):
    return G.crossover_events(weekly_bars(spark, sf_dir))


@query("q3_crossover_trades", f"WITH {W}, {_CROSS}, {_TRADES}")
def crossover_trades(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    return rounded(G.held_trades(G.crossover_events(bars), bars), 6, "pnl_pct")


_BREAK = "ev AS (SELECT symbol, date, CASE WHEN n = 20 AND close > h THEN 'entry' WHEN n = 20 AND close < l THEN 'exit' END AS event FROM (SELECT *, count(high) OVER v AS n, max(high) OVER v AS h, min(low) OVER v AS l FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE n = 20 AND (close > h OR close < l))"


@query("q3_breakout_trades", f"WITH {W}, {_BREAK}, {_TRADES}")
def breakout_trades(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    return rounded(G.held_trades(G.breakout_events(bars), bars), 6, "pnl_pct")


_REV = f"""rm AS (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM w), rg AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS n FROM rm), ra AS (SELECT symbol, date, {rolling('avg({})', 14, 'u')} AS g, {rolling('avg({})', 14, 'n')} AS l FROM rg),
    rr AS (SELECT symbol, date, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END AS rsi FROM ra), rw AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol ORDER BY date) AS was FROM rr),
    ev AS (SELECT symbol, date, CASE WHEN was <= 45 AND rsi > 45 THEN 'entry' ELSE 'exit' END AS event, CASE WHEN was <= 45 AND rsi > 45 THEN least(1, (45 - was) / 10) ELSE 1 END::DOUBLE AS strength FROM rw WHERE (was <= 45 AND rsi > 45) OR (was >= 55 AND rsi < 55))"""


@query("q2_reversal_events", f"WITH {W}, {_REV} SELECT symbol, date, event, round(strength, 6) AS strength FROM ev")
def reversal_events(spark, sf_dir):
    """Bounds of 45 and 55, which the smooth weekly bars reach."""
    return rounded(G.reversal_events(weekly_bars(spark, sf_dir), 14, 45.0, 55.0), 6, "strength")
