"""Queries on scores, screening paradigms, trends, gaps, rule predictors, orders and the pull-back back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.windows import full, series, sma
from ..operators import indicators as I
from ..operators import rotation as R
from ..operators import scoring as S
from .evaluation import SIGNALS, signals
from .indicators import averaged, rolling
from .panels import W, rounded, table, weekly_bars
from .rotation import CORR, METRICS

_BMC = f"{METRICS}, {CORR}, k AS (SELECT *, CAST(substr(symbol, 7) AS INTEGER) % 2 AS pool FROM bm JOIN mc USING (symbol))"


def metrics(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    out = R.base_metrics(bars).join(R.mean_abs_correlation(R.correlations(R.log_returns(bars))), "symbol")
    return out.withColumn("pool", F.substring("symbol", 7, 9).cast("int") % 2)


@query("l07_composite", f"WITH {W}, {_BMC} SELECT symbol, round(0.45 * m20 + 0.35 * m60 - 0.15 * vol20 + 0.05 * mdd60, 6) AS legacy, round(0.3 * m20 + 0.25 * m60 - 0.15 * vol20 + 0.05 * mdd60 + 0.1 * r2 - 0.2 * mean_corr, 6) AS composite FROM k")
def composite(spark, sf_dir):
    return metrics(spark, sf_dir).select("symbol", F.round(S.weighted(S.LEGACY), 6).alias("legacy"), F.round(S.weighted(S.FACTORS), 6).alias("composite"))


def states(spark, sf_dir):
    """The inputs of the five states at each symbol's last bar."""
    bars = weekly_bars(spark, sf_dir)
    last = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    x = last.join(bars.select("symbol", "date", "close"), ["symbol", "date"])
    for made in (I.macd(bars).select("symbol", "date", "dif", "dea", "hist"), I.rsi_wilder(bars).select("symbol", "date", "rsi"), I.adx(bars).select("symbol", "date", "adx"), I.atr(bars).select("symbol", "date", "natr"), I.bollinger(bars, sample=True).select("symbol", "date", "middle", "upper", "lower")):
        x = x.join(made, ["symbol", "date"], "left")
    return S.state_scores(x)


@query("j11_states")
def five_states(spark, sf_dir):
    """The joined indicators have their own SQL; tests compare the states with plain rules."""
    return rounded(states(spark, sf_dir).select("symbol", "macd_state", "rsi_state", "strength", "natr_score", "band_state"), 6, "natr_score")


@query("l07_state_composite")
def state_composite(spark, sf_dir):
    x = metrics(spark, sf_dir).join(states(spark, sf_dir).drop("date", "close"), "symbol")
    return x.select("symbol", F.round(S.state_composite(), 6).alias("score"))


_V2 = """nn AS (SELECT *, max(m20) OVER p AS h20, min(m20) OVER p AS l20, max(m60) OVER p AS h60, min(m60) OVER p AS l60, max(greatest(0, crowding)) OVER p AS hc, min(greatest(0, crowding)) OVER p AS lc FROM k WINDOW p AS (PARTITION BY pool)),
    v2 AS (SELECT symbol, pool, 0.4 * CASE WHEN h20 > l20 THEN (m20 - l20) / (h20 - l20) ELSE 0.5 END + 0.3 * CASE WHEN h60 > l60 THEN (m60 - l60) / (h60 - l60) ELSE 0.5 END + 0.3 * least(1, CASE WHEN hc > lc THEN (greatest(0, crowding) - lc) / (hc - lc) ELSE 0.5 END / 0.5) AS momentum, r2, above_ma FROM nn),
    s2 AS (SELECT *, (momentum * 0.40 + 0.5 * 0.35) * 0.9 * 0.85 + 0.6 * 0.25 AS score FROM v2)"""


def factors(spark, sf_dir):
    return S.three_factor(metrics(spark, sf_dir), ["pool"], "repair", {"climax": 0.5, "ebb": 0.7, "repair": 0.9}, 0.45, 0.6, 1.2, -0.4)


@query("l11_three_factor_v2", f"WITH {W}, {_BMC}, {_V2} SELECT symbol, pool, round(momentum, 6) AS momentum, round(score, 6) AS score FROM s2")
def three_factor_v2(spark, sf_dir):
    return rounded(factors(spark, sf_dir).select("symbol", "pool", "momentum", "score"), 6, "momentum", "score")


@query(
    "l11_three_factor_v3",
    f"""WITH {W}, {_BMC}, {_V2}, xx AS (SELECT symbol, momentum, r2 AS breadth, CASE WHEN above_ma THEN 0.8 ELSE 0.4 END AS leadership, CASE WHEN CAST(substr(symbol, 7) AS INTEGER) % 3 = 0 THEN -0.2 ELSE 0.5 END AS share FROM s2)
    SELECT symbol, round((momentum * leadership * breadth * 0.55 + 0.5 * 0.2 + share * 0.15 + 0.6 * 0.1) * 0.765, 6) AS score_v3,
    CASE WHEN breadth < 0.35 AND share < 0 AND momentum > 0 THEN 'breadth_collapse,price_share_divergence' WHEN breadth < 0.35 THEN 'breadth_collapse' WHEN share < 0 AND momentum > 0 THEN 'price_share_divergence' ELSE '' END AS events FROM xx""",
)
def three_factor_v3(spark, sf_dir):
    k = F.substring("symbol", 7, 9).cast("int")
    x = factors(spark, sf_dir).withColumns({"breadth": F.col("r2"), "leadership": F.when(F.col("above_ma"), 0.8).otherwise(0.4), "share": F.when(k % 3 == 0, -0.2)})
    return S.three_factor_v3(x).select("symbol", F.round("score_v3", 6).alias("score_v3"), "events")


@query("l12_readiness", f"WITH {W}, {METRICS} SELECT CAST(substr(symbol, 7) AS INTEGER) % 4 AS pool, count(*) AS total, count(*) FILTER (NOT (m60 IS NULL OR vol20 > 15 OR r2 < 0.1)) AS ok, count(*) FILTER (NOT (m60 IS NULL OR vol20 > 15 OR r2 < 0.1)) < 5 AS degraded FROM bm GROUP BY ALL")
def readiness(spark, sf_dir):
    rows = R.penalties(R.base_metrics(weekly_bars(spark, sf_dir)), F.lit(15.0))
    return S.readiness(rows.select((F.substring("symbol", 7, 9).cast("int") % 4).alias("pool"), "excluded"))


@query(
    "l13_premium_penalty",
    """WITH x AS (SELECT s_suppkey, s_acctbal AS score, CASE s_suppkey % 3 WHEN 0 THEN 'WAIT' WHEN 1 THEN 'GO_LIGHT' ELSE '' END AS action, CASE s_nationkey % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cool' END AS band FROM supplier),
    y AS (SELECT *, round(score * CASE WHEN action = 'WAIT' THEN 0.7 WHEN action = 'GO_LIGHT' THEN 0.85 WHEN band = 'hot' THEN 0.75 WHEN band = 'warm' THEN 0.9 ELSE 1 END, 4) AS adjusted FROM x) SELECT s_suppkey, adjusted, row_number() OVER (PARTITION BY band ORDER BY adjusted DESC, s_suppkey) AS rank FROM y""",
)
def premium_penalty(spark, sf_dir):
    from pyspark.sql import Window

    k, n = F.col("s_suppkey") % 3, F.col("s_nationkey") % 3
    x = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.when(k == 0, "WAIT").when(k == 1, "GO_LIGHT").otherwise("").alias("action"), F.when(n == 0, "hot").when(n == 1, "warm").otherwise("cool").alias("band"))
    x = x.withColumn("adjusted", F.round(F.col("s_acctbal") * S.premium_penalty(F.col("action"), F.col("band")), 4))
    return x.select("s_suppkey", "adjusted", F.row_number().over(Window.partitionBy("band").orderBy(F.col("adjusted").desc(), "s_suppkey")).alias("rank"))


_SCREEN = "sx AS (SELECT o_orderkey AS symbol, (o_totalprice - 150000) * 2000 AS inflow, (o_orderkey % 80 - 55) / 10.0 AS pct, 0.8 + (o_custkey % 15) / 10.0 AS ratio, (o_orderkey % 31 - 5) / 10.0 AS last30, (o_custkey % 61 - 20) / 10.0 AS dist, o_totalprice * 1000 AS amount FROM orders)"
_FLOW = "CASE WHEN inflow >= 2e8 THEN 40 WHEN inflow >= 1e8 THEN 32 WHEN inflow >= 5e7 THEN 24 WHEN inflow > 0 THEN 12 ELSE 0 END + CASE WHEN pct BETWEEN -3 AND 0 THEN 30 WHEN pct > -4 AND pct < -3 THEN 20 WHEN pct BETWEEN -5 AND -4 THEN 10 ELSE 0 END + CASE WHEN ratio >= 1.8 THEN 30 WHEN ratio >= 1.5 THEN 24 WHEN ratio >= 1.2 THEN 15 ELSE 0 END"
_GRAB = "CASE WHEN last30 >= 2 THEN 40 WHEN last30 >= 1 THEN 32 WHEN last30 >= 0.5 THEN 20 ELSE 0 END + CASE WHEN ratio >= 2 THEN 30 WHEN ratio >= 1.5 THEN 24 WHEN ratio >= 1.2 THEN 15 ELSE 0 END + CASE WHEN dist > 0 AND dist <= 3 THEN 30 WHEN dist > 3 THEN 22 WHEN abs(dist) <= 0.5 THEN 15 ELSE 0 END"
_OVER = "CASE WHEN pct BETWEEN -4 AND -2 THEN 50 WHEN pct >= -5 AND pct < -4 THEN 38 WHEN pct > -5.5 AND pct <= -5 THEN 22 ELSE 0 END + CASE WHEN ratio >= 1.5 THEN 30 WHEN ratio >= 1.2 THEN 22 WHEN ratio >= 1.0 THEN 12 ELSE 0 END + CASE WHEN amount >= 2e8 THEN 20 WHEN amount >= 1e8 THEN 16 WHEN amount >= 5e7 THEN 10 ELSE 0 END"
_PARADIGMS = f"{_SCREEN}, pd AS (SELECT symbol, amount, ({_FLOW})::DOUBLE AS fund_flow, ({_GRAB})::DOUBLE AS tail_grab, ({_OVER})::DOUBLE AS oversold FROM sx)"


def paradigms(spark, sf_dir):
    # shares of tenths as decimals would differ from doubles at the steps; both sides divide doubles
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    x = table(spark, sf_dir, "orders").select(
        key.alias("symbol"), ((price - 150000) * 2000).alias("inflow"), ((key % 80 - 55) / 10.0).alias("pct"), (0.8 + cust % 15 / 10.0).alias("ratio"),
        ((key % 31 - 5) / 10.0).alias("last30"), ((cust % 61 - 20) / 10.0).alias("dist"), (price * 1000).alias("amount"),
    )
    c = F.col
    return x.select("symbol", "amount", S.fund_flow_score(c("inflow"), c("pct"), c("ratio")).alias("fund_flow"), S.tail_grab_score(c("last30"), c("ratio"), c("dist")).alias("tail_grab"), S.oversold_score(c("pct"), c("ratio"), c("amount")).alias("oversold"))


@query("m3_paradigms", f"WITH {_PARADIGMS} SELECT symbol, fund_flow, tail_grab, oversold FROM pd")
def paradigm_scores(spark, sf_dir):
    return paradigms(spark, sf_dir).drop("amount")


@query(
    "m3_sector_rotation",
    """WITH x AS (SELECT o_orderkey, (o_custkey % 50 - 20) / 10.0::DOUBLE AS ind, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 30 - 12) / 10.0::DOUBLE END AS ex, o_custkey % 4 = 0 AS l, o_custkey % 3 = 0 AS t, (o_orderkey % 60 - 25) / 10.0::DOUBLE AS r FROM orders)
    SELECT o_orderkey, (least(45, CASE WHEN ind >= 2 THEN 18 WHEN ind >= 1 THEN 14 WHEN ind >= 0.5 THEN 10 WHEN ind >= 0 THEN 6 ELSE 0 END + CASE WHEN ex >= 0.5 THEN 15 WHEN ex >= 0 THEN 10 WHEN ex >= -0.5 THEN 5 ELSE 0 END)
      + CASE WHEN l AND t THEN 35 WHEN l THEN 22 WHEN t THEN 12 ELSE 0 END + CASE WHEN r >= 2 THEN 20 WHEN r >= 1 THEN 15 WHEN r >= 0 THEN 10 WHEN r >= -1 THEN 5 ELSE 0 END)::DOUBLE AS score FROM x""",
)
def sector_rotation(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    extra = F.when(key % 5 > 0, (key % 30 - 12) / 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.sector_score((cust % 50 - 20) / 10, extra, cust % 4 == 0, cust % 3 == 0, (key % 60 - 25) / 10).alias("score"))


_POOLED = f"{_PARADIGMS}, po AS (SELECT symbol, 'fund_flow' AS paradigm, fund_flow AS score, amount FROM pd WHERE fund_flow >= 72 UNION ALL SELECT symbol, 'oversold', oversold, amount FROM pd WHERE oversold >= 65 UNION ALL SELECT symbol, 'tail_grab', tail_grab, amount FROM pd WHERE tail_grab >= 70)"


def pools(spark, sf_dir):
    x = paradigms(spark, sf_dir)
    part = lambda name, least: x.filter(F.col(name) >= least).select("symbol", F.lit(name).alias("paradigm"), F.col(name).alias("score"), "amount")
    return part("fund_flow", 72).union(part("oversold", 65)).union(part("tail_grab", 70))


@query("m4_pools", f"WITH {_POOLED} SELECT paradigm, symbol, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY paradigm ORDER BY score DESC, amount DESC, symbol) AS place FROM po) WHERE place <= 10")
def pool_tops(spark, sf_dir):
    """The ten best of each pool; the limit is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("paradigm").orderBy(F.col("score").desc(), F.col("amount").desc(), "symbol")
    return pools(spark, sf_dir).withColumn("place", F.row_number().over(w)).filter("place <= 10").select("paradigm", "symbol", "score", "place")


@query(
    "m5_confluence",
    f"""WITH {_POOLED}, g AS (SELECT symbol, max(score) AS m, count(DISTINCT paradigm) AS k, arg_min(amount, row(-score, paradigm)) AS a FROM po GROUP BY symbol)
    SELECT symbol, round(m + least(12, 4 * (k - 1)) + CASE WHEN max(a) OVER () > min(a) OVER () THEN round(2 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 2) ELSE 0 END, 2) AS score, k FROM g""",
)
def confluence(spark, sf_dir):
    return rounded(S.confluence(pools(spark, sf_dir)), 2, "score")


@query("m6_top_third", "WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_retailprice AS threshold FROM r WHERE r = greatest(1, ceil(n * 2 / 3.0))")
def top_third(spark, sf_dir):
    return S.top_third(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")


@query(
    "m8_reweighted",
    """WITH x AS (SELECT o_orderkey, o_orderpriority AS g, CASE WHEN o_orderpriority = '1-URGENT' THEN 50.0 ELSE (o_orderkey % 101)::DOUBLE END AS a, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL WHEN o_orderkey % 9 > 0 THEN (o_custkey % 101)::DOUBLE END AS b, o_totalprice / 5000 AS c FROM orders),
    y AS (SELECT *, CASE WHEN max(abs(coalesce(a, 50) - 50)) OVER p < 1e-9 OR count(a) OVER p = 0 THEN 0 ELSE 0.5 END AS wa, CASE WHEN max(abs(coalesce(b, 50) - 50)) OVER p < 1e-9 OR count(b) OVER p = 0 THEN 0 ELSE 0.3 END AS wb, CASE WHEN max(abs(coalesce(c, 50) - 50)) OVER p < 1e-9 OR count(c) OVER p = 0 THEN 0 ELSE 0.2 END AS wc FROM x WINDOW p AS (PARTITION BY g))
    SELECT o_orderkey, round((wa * coalesce(a, 50) + wb * coalesce(b, 50) + wc * coalesce(c, 50))::DOUBLE / (wa + wb + wc)::DOUBLE, 4) AS score FROM y""",
)
def reweighted(spark, sf_dir):
    g, key = F.col("o_orderpriority"), F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(
        "o_orderkey", g.alias("g"), F.when(g == "1-URGENT", 50.0).otherwise((key % 101).cast("double")).alias("a"),
        F.when((g != "2-HIGH") & (key % 9 > 0), (F.col("o_custkey") % 101).cast("double")).alias("b"), (F.col("o_totalprice") / 5000).alias("c"),
    )
    return S.reweighted(x, ["g"], {"a": 0.5, "b": 0.3, "c": 0.2}).select("o_orderkey", F.round("score", 4).alias("score"))


_TREND = f"""{averaged('e', 'w', {'ef': ('close', 2 / 13), 'es': ('close', 2 / 27)})}, dd AS (SELECT symbol, date, ef - es AS dif FROM e), {averaged('s', 'dd', {'dea': ('dif', 0.2)})},
    mm AS (SELECT symbol, date, close, {rolling('avg({})', 20, 'close')} AS ma20, {rolling('avg({})', 60, 'close')} AS ma60 FROM w),
    it AS (SELECT symbol, date, CASE WHEN ma60 IS NOT NULL THEN CASE WHEN close > ma20 AND ma20 > ma60 THEN 0.4 WHEN close < ma20 AND ma20 < ma60 THEN 0 ELSE 0.2 END + CASE WHEN dif > dea THEN 0.4 WHEN dif < dea THEN 0 ELSE 0.2 END + CASE WHEN close > ma20 THEN 0.2 ELSE 0 END END::DOUBLE AS score FROM mm JOIN s USING (symbol, date))"""
_LABEL = "CASE WHEN {0} >= 0.7 THEN 'strong' WHEN {0} <= 0.3 THEN 'weak' ELSE 'choppy' END"


def trends(spark, sf_dir):
    bars, w = weekly_bars(spark, sf_dir), series("symbol")
    x = bars.select("symbol", "date", "close", sma("close", 20, w).alias("ma20"), sma("close", 60, w).alias("ma60")).join(I.macd(bars).select("symbol", "date", "dif", "dea"), ["symbol", "date"])
    score = S.index_trend_score(F.col("close"), F.col("ma20"), F.col("ma60"), F.col("dif"), F.col("dea"))
    return x.select("symbol", "date", F.round(score, 6).alias("score")).filter("score IS NOT NULL")


@query("n2_index_trend", f"WITH {W}, {_TREND} SELECT symbol, date, round(score, 6) AS score, {_LABEL.format('round(score, 6)')} AS trend, round(CASE WHEN round(score, 6) >= 0.7 THEN score WHEN round(score, 6) <= 0.3 THEN 1 - score ELSE abs(score - 0.5) * 2 END, 6) AS strength FROM it WHERE score IS NOT NULL")
def index_trend(spark, sf_dir):
    made = S.trend_label(F.col("score"))
    return rounded(trends(spark, sf_dir).withColumns(made), 6, "strength")


@query(
    "n3_overall_trend",
    f"""WITH {W}, {_TREND}, t AS (SELECT symbol, date, {_LABEL.format('round(score, 6)')} AS trend FROM it WHERE score IS NOT NULL), r AS (SELECT date, avg(CASE WHEN close > was THEN 1.0 ELSE 0 END) AS rising FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS was FROM w) WHERE was IS NOT NULL GROUP BY date),
    o AS (SELECT a.date, round(CASE a.trend WHEN 'strong' THEN 1 WHEN 'weak' THEN 0 ELSE 0.5 END * 0.4 + CASE b.trend WHEN 'strong' THEN 1 WHEN 'weak' THEN 0 ELSE 0.5 END * 0.4 + rising * 0.2, 6)::DOUBLE AS score FROM t a JOIN t b ON a.date = b.date AND a.symbol = 'Brand#11' AND b.symbol = 'Brand#22' JOIN r ON r.date = a.date)
    SELECT date, score, {_LABEL.format('score')} AS trend FROM o""",
)
def overall_trend(spark, sf_dir):
    labelled = trends(spark, sf_dir).select("symbol", "date", S.trend_label(F.col("score"))["trend"].alias("trend"))
    one = lambda symbol, name: labelled.filter(F.col("symbol") == symbol).select("date", F.col("trend").alias(name))
    was = F.lag("close").over(series("symbol"))
    rising = weekly_bars(spark, sf_dir).withColumn("was", was).filter("was IS NOT NULL").groupBy("date").agg(F.avg((F.col("close") > F.col("was")).cast("int")).alias("rising"))
    out = one("Brand#11", "a").join(one("Brand#22", "b"), "date").join(rising, "date")
    out = out.select("date", F.round(S.overall_trend_score(F.col("a"), F.col("b"), F.col("rising")), 6).alias("score"))
    return out.withColumn("trend", S.trend_label(F.col("score"))["trend"])


@query(
    "n6_overnight_impact",
    f"WITH {W}, c AS (SELECT symbol, date, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS c FROM w) SELECT x.date, round(greatest(-1, least(1, (x.c - y.c) / 3)), 4) AS impact FROM c x JOIN c y ON x.date = y.date AND x.symbol = 'Brand#11' AND y.symbol = 'Brand#22' WHERE x.c IS NOT NULL AND y.c IS NOT NULL",
)
def overnight_impact(spark, sf_dir):
    change = (F.col("close") / F.lag("close").over(series("symbol")) - 1) * 100
    moves = weekly_bars(spark, sf_dir).select("symbol", "date", change.alias("c")).filter("c IS NOT NULL")
    one = lambda symbol, name: moves.filter(F.col("symbol") == symbol).select("date", F.col("c").alias(name))
    return one("Brand#11", "a").join(one("Brand#22", "b"), "date").select("date", F.round(S.overnight_impact(F.col("a"), F.col("b")), 4).alias("impact"))


@query(
    "j14_daily_trend",
    f"""WITH {W}, a AS (SELECT symbol, date, close, {rolling('avg({})', 20, 'close')} AS ma FROM w), b AS (SELECT *, lag(ma, 4) OVER (PARTITION BY symbol ORDER BY date) AS was FROM a), c AS (SELECT *, coalesce((ma - was) / was * 100, 0) AS slope, sign(close - ma) AS side, abs(close - ma) / ma * 100 AS gap FROM b WHERE ma IS NOT NULL)
    SELECT symbol, date, CASE WHEN side > 0 THEN 'bullish' WHEN side < 0 THEN 'bearish' ELSE 'neutral' END AS direction, round(CASE WHEN side = 0 THEN 0 ELSE least(0.1, least(gap / 5, 1) * 0.05 + greatest(0, side * slope) / 2 * 0.05) END, 6) AS score FROM c""",
)
def daily_trend(spark, sf_dir):
    return rounded(S.daily_trend(weekly_bars(spark, sf_dir)), 6, "score")


@query(
    "o8_gap_trades",
    f"""WITH {W}, g AS (SELECT *, (open - lag(close) OVER v) / lag(close) OVER v * 100 AS gap FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date)), b AS (SELECT *, CASE WHEN gap > 0 THEN (open - low) / open ELSE (high - open) / open END * 100 AS back FROM g WHERE abs(gap) >= 0.8)
    SELECT symbol, date, round(gap, 6) AS gap, CASE WHEN gap > 0 THEN 'up' ELSE 'down' END AS direction, back >= 0.5 AS filled, round(least(0.8, 0.5 + 0.3 * greatest(0, least(1, back / abs(gap)))), 6) AS strength FROM b""",
)
def gap_trades(spark, sf_dir):
    return rounded(S.gap_trades(weekly_bars(spark, sf_dir)), 6, "gap", "strength")


@query(
    "o4_stock_rule",
    f"""WITH {W}, m AS (SELECT symbol, date, close, volume, (close / lag(close) OVER v - 1) * 100 AS change, {rolling('avg({})', 20, 'close')} AS ma20, {rolling('avg({})', 5, 'volume')} AS ma5, close - lag(close) OVER v AS d FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date)),
    r AS (SELECT *, {rolling('avg({})', 6, 'u')} AS up, {rolling('avg({})', 6, 'dn')} AS down FROM (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM m)),
    s AS (SELECT *, CASE WHEN down = 0 AND up = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM r), q AS (SELECT *, ma5 > 0 AND volume >= ma5 * 1.35 AND NOT abs(coalesce(change, 0)) >= 9.5 AS loud FROM s),
    z AS (SELECT symbol, date, rsi, CASE WHEN loud AND close > ma20 AND rsi < 35 THEN 'bullish_pullback' WHEN loud AND close < ma20 AND rsi > 65 THEN 'bearish_bounce' ELSE 'none' END AS signal FROM q)
    SELECT symbol, date, signal, round(least(0.85, 0.45 + CASE signal WHEN 'bullish_pullback' THEN 35 - rsi ELSE rsi - 65 END / 100), 6) AS strength FROM z WHERE signal <> 'none'""",
)
def stock_rule(spark, sf_dir):
    bars, w = weekly_bars(spark, sf_dir), series("symbol")
    x = bars.select("symbol", "date", "close", "volume", ((F.col("close") / F.lag("close").over(w) - 1) * 100).alias("change"), sma("close", 20, w).alias("ma20"), sma("volume", 5, w).alias("ma5"), (F.col("close") - F.lag("close").over(w)).alias("d"))
    mean = lambda side: full(F.avg(F.when(F.col("d").isNotNull(), F.greatest(side * F.col("d"), F.lit(0.0)))), 6, w, F.col("d"))
    x = x.withColumns({"up": mean(1), "down": mean(-1)})
    rsi = F.when((F.col("down") == 0) & (F.col("up") == 0), 50.0).when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("up", "down")))
    x = x.withColumn("rsi", rsi)
    made = S.stock_rule(F.col("close"), F.col("ma20"), F.col("rsi"), F.col("volume"), F.col("ma5"), F.col("change"))
    return rounded(x.withColumns(made).filter("signal != 'none'").select("symbol", "date", "signal", "strength"), 6, "strength")


@query(
    "s2_rule_predictors",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 101)::DOUBLE END AS p, (o_custkey % 21 - 10) / 100.0::DOUBLE AS r, (o_totalprice - 150000) / 100000 AS f FROM orders),
    y AS (SELECT o_orderkey, CASE WHEN p > 90 THEN -0.3 WHEN p < 10 THEN 0.3 ELSE 0 END * 0.6 + greatest(-0.2, least(0.2, f * 0.25)) * 0.25 + sign(r) * 0.0225 AS a, greatest(-1, least(1, f)) * 0.35 + greatest(-1, least(1, r * 5)) * 0.35 + CASE WHEN p < 30 THEN 0.15 WHEN p > 70 THEN -0.15 ELSE 0 END * 0.3 AS b FROM x),
    z AS (SELECT o_orderkey, round(greatest(35, least(80, 50 + a * 100)), 6) AS reversion, round(greatest(35, least(80, 50 + b * 100)), 6) AS valuation FROM y)
    SELECT *, CASE WHEN reversion >= 55 THEN 'up' WHEN reversion <= 45 THEN 'down' ELSE 'neutral' END AS reversion_call, CASE WHEN valuation >= 55 THEN 'up' WHEN valuation <= 45 THEN 'down' ELSE 'neutral' END AS valuation_call FROM z""",
)
def rule_predictors(spark, sf_dir):
    key = F.col("o_orderkey")
    p, r, f = F.when(key % 11 > 0, (key % 101).cast("double")), (F.col("o_custkey") % 21 - 10) / 100, (F.col("o_totalprice") - 150000) / 100000
    out = table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.call(S.reversion_score(p, r, f))["probability"], 6).alias("reversion"), F.round(S.call(S.valuation_score(f, r, p, 5.0))["probability"], 6).alias("valuation"))
    side = lambda c: S.call((F.col(c) - 50) / 100)["direction"]
    return out.withColumns({"reversion_call": F.when(F.col("reversion") >= 55, "up").when(F.col("reversion") <= 45, "down").otherwise("neutral"), "valuation_call": F.when(F.col("valuation") >= 55, "up").when(F.col("valuation") <= 45, "down").otherwise("neutral")})


@query(
    "p2_single_risk",
    "SELECT o_orderkey, round(CASE WHEN s > 0 THEN o_totalprice * (1 - s * 1.5) ELSE o_totalprice * 0.97 END, 4) AS stop, round(greatest(0, least(0.25, w - (1 - w) / (1.5 / 1.1))), 6) AS kelly FROM (SELECT *, (o_custkey % 30) / 1000.0::DOUBLE AS s, (o_orderkey % 100) / 100.0::DOUBLE AS w FROM orders)",
)
def single_risk(spark, sf_dir):
    made = S.single_risk(F.col("o_totalprice"), F.col("o_custkey") % 30 / 1000, F.col("o_orderkey") % 100 / 100, F.lit(1.5), F.lit(1.1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(made["stop"], 4).alias("stop"), F.round(made["kelly"], 6).alias("kelly"))


@query(
    "p3_stress_and_stops",
    "SELECT p_partkey, CAST(shock AS DOUBLE) AS shock, CAST(shock AS DOUBLE) AS move, round(p_retailprice * (1 - p_size / 100.0::DOUBLE), 4) AS stop_price FROM part, (VALUES (-5), (-10), (-20)) v(shock) WHERE p_retailprice > 0",
)
def stress_and_stops(spark, sf_dir):
    """Positions moving with the index, for three shocks, and their stop lines."""
    parts = table(spark, sf_dir, "part").filter("p_retailprice > 0")
    shocks = F.explode(F.array(*[F.lit(float(x)) for x in (-5, -10, -20)]))
    return parts.select("p_partkey", shocks.alias("shock"), F.round(F.col("p_retailprice") * (1 - F.col("p_size") / 100), 4).alias("stop_price")).withColumn("move", F.col("shock"))


@query(
    "p6_order_check",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ETF' WHEN 1 THEN 'OPTION' WHEN 2 THEN 'INDEX' WHEN 3 THEN 'MIXED' ELSE 'BOND' END AS i, CASE o_custkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS s, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS st, o_custkey % 10 - 1 AS t FROM orders)
    SELECT o_orderkey, round(CASE i WHEN 'ETF' THEN 0.0007 WHEN 'OPTION' THEN 0.0021 WHEN 'INDEX' THEN 0 WHEN 'MIXED' THEN 0.0011 END, 6)::DOUBLE AS cost, concat_ws(',', CASE WHEN st IS NULL THEN 'strategy' END, CASE WHEN i = 'BOND' THEN 'instrument' END, CASE WHEN s = 'HOLD' THEN 'side' END, CASE WHEN t <= 0 THEN 'target' END) AS errors FROM x""",
)
def order_check(spark, sf_dir):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey") % 3
    x = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k == 0, "ETF").when(k == 1, "OPTION").when(k == 2, "INDEX").when(k == 3, "MIXED").otherwise("BOND").alias("i"), F.when(c == 0, "BUY").when(c == 1, "SELL").otherwise("HOLD").alias("s"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("st"), (F.col("o_custkey") % 10 - 1).alias("t"),
    )
    return x.select("o_orderkey", F.round(S.order_cost(F.col("i")), 6).alias("cost"), S.order_errors(F.col("st"), F.col("i"), F.lit("x"), F.col("s"), F.col("t")).alias("errors"))


_GRID = [(hold, stop, target) for hold in (3, 5, 7) for stop in (3, 5, 8) for target in (3, 5, 8)]
_PARAMS = "pm AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {h}, {s}, {t})" for k, (h, s, t) in enumerate(_GRID)) + ") v(p, hold, stop_pct, target_pct))"
_PULLBACK = f"""{_PARAMS}, ww AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS was FROM w),
    sg AS (SELECT symbol, date, close AS limit_close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM w), e AS (SELECT sg.symbol, sg.limit_close, x.date AS entry_date, x.open AS entry, x.i AS e FROM sg JOIN ww x ON x.symbol = sg.symbol AND x.was = sg.date WHERE day(sg.date) % 4 = 0),
    t AS (SELECT pm.*, e.*, least(coalesce(l.low, limit_close * 0.95), limit_close * (1 - stop_pct / 100.0::DOUBLE)) AS stop, limit_close * (1 + target_pct / 100.0::DOUBLE) AS target FROM e CROSS JOIN pm LEFT JOIN w l ON l.symbol = e.symbol AND l.date + 1 = e.entry_date WHERE (entry - limit_close) / limit_close * 100 BETWEEN -5 AND 1),
    b AS (SELECT t.*, y.i, CASE WHEN y.low <= t.stop THEN 'stop' WHEN y.high >= t.target THEN 'target' END AS how, CASE WHEN y.low <= t.stop THEN t.stop WHEN y.high >= t.target THEN t.target END AS price, y.close AS last FROM t JOIN ww y ON y.symbol = t.symbol AND y.i BETWEEN t.e AND t.e + t.hold),
    tr AS (SELECT p, symbol, entry_date, entry, e, coalesce(arg_min(how, i) FILTER (how IS NOT NULL), 'time') AS how, coalesce(min(i) FILTER (how IS NOT NULL), max(i)) - e AS held, (coalesce(arg_min(price, i) FILTER (how IS NOT NULL), arg_max(last, i)) - entry) / entry * 100 AS pnl_pct FROM b GROUP BY p, symbol, entry_date, entry, e)"""


def pullback(spark, sf_dir, grid):
    bars = weekly_bars(spark, sf_dir)
    signals_ = bars.filter(F.day("date") % 4 == 0).select("symbol", "date", F.col("close").alias("limit_close"))
    params = spark.createDataFrame([(k, h, float(s), float(t), -5.0, 1.0) for k, (h, s, t) in enumerate(grid)], "p int, hold int, stop_pct double, target_pct double, dip_min double, dip_max double")
    return S.pullback_trades(signals_, bars, params)


@query("q6_pullback_trades", f"WITH {W}, {_PULLBACK} SELECT symbol, entry_date, round(entry, 6) AS entry, how, CAST(held AS INTEGER) AS held, round(pnl_pct, 6) AS pnl_pct FROM tr WHERE p = 13")
def pullback_trades(spark, sf_dir):
    return rounded(pullback(spark, sf_dir, [_GRID[13]]).drop("p"), 6, "entry", "pnl_pct")


@query("q7_pullback_grid", f"WITH {W}, {_PULLBACK}, g AS (SELECT p, count(*) AS trades, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) * 100 AS win_rate, avg(pnl_pct) AS avg_pnl, min(pnl_pct) AS worst FROM tr GROUP BY p) SELECT p, trades, round(win_rate, 6) AS win_rate, round(avg_pnl, 6) AS avg_pnl, round(worst, 6) AS worst, round(win_rate * 0.5 + greatest(0, avg_pnl) * 0.3 - abs(worst) * 0.2, 6) AS score FROM g")
def pullback_grid(spark, sf_dir):
    return rounded(S.pullback_grid(pullback(spark, sf_dir, _GRID)), 6, "win_rate", "avg_pnl", "worst", "score")


@query(
    "r04_efficiency",
    f"WITH {SIGNALS}, e AS (SELECT strategy, count(*) FILTER (date < DATE '1996-01-01') AS n_is, count(*) FILTER (date >= DATE '1996-01-01') AS n_oos, avg(pnl_pct) FILTER (date < DATE '1996-01-01') AS a, avg(pnl_pct) FILTER (date >= DATE '1996-01-01') AS b FROM sg WHERE status = 'closed' OR o_custkey % 2 = 0 GROUP BY strategy), r AS (SELECT *, CASE WHEN n_is >= 3 AND n_oos >= 3 THEN b / greatest(abs(a), 1e-8) END AS ratio FROM e) SELECT strategy, n_is, n_oos, round(ratio, 6) AS ratio, CASE WHEN ratio IS NOT NULL THEN ratio < 0.5 AND a > 1e-8 END AS overfit FROM r",
)
def efficiency(spark, sf_dir):
    rows = signals(spark, sf_dir).filter((F.col("status") == "closed") | (F.col("o_custkey") % 2 == 0)).withColumnRenamed("pnl_pct", "pnl")
    return rounded(S.efficiency(rows, ["strategy"], "1996-01-01"), 6, "ratio")
