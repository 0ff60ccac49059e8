"""Queries on back-tests, fusion, risk and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import rotation as R
from ..operators import screening as S
from ..operators import trading as T
from .indicators import OVER, rolling
from .panels import W, rounded, table, weekly_bars
from .rotation import CORR, METRICS

_RUN = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def crossover_sql(fast: int, slow: int, tag: str = "") -> str:
    return f"""a{tag} AS (SELECT symbol, date, close, {rolling('avg({})', fast, 'close')} AS f, {rolling('avg({})', slow, 'close')} AS s, coalesce(close / lag(close) {OVER} - 1, 0) AS ret FROM w),
    g{tag} AS (SELECT *, CASE WHEN f > s THEN 1 ELSE 0 END AS signal FROM a{tag}), p{tag} AS (SELECT *, coalesce(lag(signal) {OVER}, 0) AS position FROM g{tag}),
    t{tag} AS (SELECT *, abs(position - coalesce(lag(position) {OVER}, 0)) AS turnover FROM p{tag}), n{tag} AS (SELECT *, position * ret - turnover * 10 / 10000.0 AS net FROM t{tag}),
    q{tag} AS (SELECT *, product(1 + net) {_RUN} AS equity FROM n{tag}), d{tag} AS (SELECT *, equity / max(equity) {_RUN} - 1 AS dd FROM q{tag})"""


@query("q1_ma_crossover", f"WITH {W}, {crossover_sql(5, 20)} SELECT symbol, date, position, turnover, round(net, 8) AS net, round(equity, 6) AS equity FROM q")
def ma_crossover(spark, sf_dir):
    out = T.ma_crossover(weekly_bars(spark, sf_dir)).select("symbol", "date", "position", "turnover", "net", "equity")
    return rounded(rounded(out, 8, "net"), 6, "equity")


_METRICS = "round(arg_max(equity, date) - 1, 6) AS total_return, round(avg(net) / stddev_samp(net) * sqrt(252), 6) AS sharpe, round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, sum(turnover)::BIGINT AS trades"


@query("q4_backtest_metrics", f"WITH {W}, {crossover_sql(5, 20)} SELECT symbol, {_METRICS} FROM d GROUP BY symbol")
def backtest_metrics(spark, sf_dir):
    return rounded(T.backtest_metrics(T.ma_crossover(weekly_bars(spark, sf_dir))), 6, "total_return", "sharpe", "max_drawdown", "win_rate")


_GRID = [(f, s) for f in (3, 5, 8) for s in (10, 20, 40)]


@query(
    "q5_parameter_grid",
    f"WITH {W}, " + ", ".join(crossover_sql(f, s, f"_{f}_{s}") for f, s in _GRID) + ", m AS (" + " UNION ALL ".join(f"SELECT {f} AS fast, {s} AS slow, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, arg_max(equity, date) - 1 AS tr FROM d_{f}_{s} GROUP BY symbol" for f, s in _GRID) + ") SELECT fast, slow, round(avg(sharpe), 6) AS sharpe, round(avg(tr), 6) AS total_return FROM m GROUP BY ALL",
)
def parameter_grid(spark, sf_dir):
    return rounded(T.parameter_grid(weekly_bars(spark, sf_dir), [3, 5, 8], [10, 20, 40]), 6, "sharpe", "total_return")


_RUNS = f"i AS (SELECT *, sum(nw) {_RUN} AS run FROM (SELECT *, CASE WHEN position <> coalesce(lag(position) {OVER}, 0) THEN 1 ELSE 0 END AS nw FROM q)), ru AS (SELECT symbol, min(date) AS entry, max(date) AS exit, count(*) AS bars, sum(net) AS gain FROM i WHERE position = 1 GROUP BY symbol, run)"


@query("q3_trade_runs", f'WITH {W}, {crossover_sql(5, 20)}, {_RUNS} SELECT symbol, entry, exit AS "exit", bars, round(gain, 6) AS gain FROM ru')
def trade_runs(spark, sf_dir):
    return rounded(T.trade_runs(T.ma_crossover(weekly_bars(spark, sf_dir))), 6, "gain")


@query(
    "e11_longest_streaks",
    f"WITH {W}, {crossover_sql(5, 20)}, {_RUNS}, k AS (SELECT *, CASE WHEN gain > 0 THEN 1 ELSE 0 END AS win FROM ru), l AS (SELECT symbol, win, row_number() OVER (PARTITION BY symbol ORDER BY entry) - row_number() OVER (PARTITION BY symbol, win ORDER BY entry) AS z FROM k), c AS (SELECT symbol, win, count(*) AS n FROM l GROUP BY symbol, win, z) SELECT symbol, coalesce(max(n) FILTER (win = 1), 0) AS wins, coalesce(max(n) FILTER (win = 0), 0) AS losses FROM c GROUP BY symbol",
)
def longest_streaks(spark, sf_dir):
    return T.longest_streaks(T.trade_runs(T.ma_crossover(weekly_bars(spark, sf_dir))))


@query(
    "e03_donchian",
    f"WITH {W} SELECT symbol, date, CASE WHEN count(high) OVER v = 20 AND close > max(high) OVER v THEN 'buy' WHEN count(high) OVER v = 20 AND close < min(low) OVER v THEN 'sell' ELSE 'hold' END AS signal FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
)
def donchian(spark, sf_dir):
    return T.donchian_signals(weekly_bars(spark, sf_dir))


_WEIGHTS = {"1-URGENT": 0.4, "2-HIGH": 0.3, "5-LOW": 0.05}
_CAND = "ca AS (SELECT o_custkey AS symbol, o_orderpriority AS strategy, round((o_totalprice - 150000) / 150000, 6) AS score, 0.5 + (o_orderkey % 50) / 100.0 AS confidence, CASE WHEN o_totalprice > 165000 THEN 'long' WHEN o_totalprice < 135000 THEN 'short' ELSE 'neutral' END AS direction FROM orders)"
_CAND_W = "x AS (SELECT *, CASE strategy WHEN '1-URGENT' THEN 0.4 WHEN '2-HIGH' THEN 0.3 WHEN '5-LOW' THEN 0.05 ELSE 0.1 END AS w FROM ca)"


def candidates(spark, sf_dir):
    x = F.col("o_totalprice")
    side = F.when(x > 165000, "long").when(x < 135000, "short").otherwise("neutral")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("strategy"), F.round((x - 150000) / 150000, 6).alias("score"), (0.5 + (F.col("o_orderkey") % 50) / 100.0).alias("confidence"), side.alias("direction"))


@query(
    "o6_fusion",
    f"""WITH {_CAND}, {_CAND_W},
    f AS (SELECT symbol, count(*) AS n, sum(score * confidence * w) / sum(w) AS fused, greatest(count(*) FILTER (direction = 'long'), count(*) FILTER (direction = 'short'), count(*) FILTER (direction = 'neutral')) / count(*) AS agreement,
          bool_or(direction = 'long' AND score >= 0.65) AND bool_or(direction = 'short' AND score <= -0.65) AS conflict FROM x GROUP BY symbol),
    r AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN agreement < 0.6 THEN 'low_agreement' WHEN abs(fused) < 0.2 THEN 'weak' ELSE 'fused' END AS rule FROM f)
    SELECT symbol, n, round(CASE WHEN rule IN ('conflict', 'low_agreement') THEN 0 ELSE fused END, 6) AS score, round(least(1, abs(fused)), 6) AS confidence, round(agreement, 6) AS agreement, rule,
           CASE WHEN rule <> 'fused' THEN 'neutral' WHEN fused > 0 THEN 'long' ELSE 'short' END AS direction FROM r""",
)
def fusion(spark, sf_dir):
    return rounded(T.fuse(candidates(spark, sf_dir), _WEIGHTS), 6, "score", "confidence", "agreement")


@query(
    "o7_contributions",
    f"WITH {_CAND}, {_CAND_W}, p AS (SELECT symbol, strategy, sum(abs(score) * confidence * w) AS p FROM x GROUP BY ALL) SELECT symbol, strategy, round(coalesce(p / nullif(sum(p) OVER (PARTITION BY symbol), 0), 0), 6) AS share FROM p",
)
def contributions(spark, sf_dir):
    return rounded(T.contributions(candidates(spark, sf_dir), _WEIGHTS), 6, "share")


@query(
    "p1_portfolio_risk",
    f"""WITH {W}, {CORR}, k AS (SELECT symbol, CAST(substr(symbol, 7) AS INTEGER) AS weight FROM (SELECT DISTINCT symbol FROM w)), h AS (SELECT date, sum(r * weight / (SELECT sum(weight) FROM k)) AS p, count(*) AS c FROM lr JOIN k USING (symbol) GROUP BY date HAVING count(*) = (SELECT count(*) FROM k)),
    v AS (SELECT *, product(1 + p) OVER (ORDER BY date) AS nav FROM h), dd AS (SELECT *, nav / greatest(1, max(nav) OVER (ORDER BY date)) - 1 AS dd FROM v)
    SELECT round(-quantile_cont(p, 0.05) * 100, 6) AS var_pct, round(min(dd), 6) AS max_drawdown, round(arg_max(dd, date), 6) AS drawdown, count(*) AS days FROM dd""",
)
def portfolio_risk(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    returns = R.log_returns(bars)
    weights = bars.select("symbol").distinct().withColumn("weight", F.substring("symbol", 7, 9).cast("double"))
    return rounded(T.portfolio_risk(returns, weights), 6, "var_pct", "max_drawdown", "drawdown")


@query("p2_kelly", "WITH s AS (SELECT o_orderpriority AS strategy, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0 END) AS wr, avg(o_totalprice) FILTER (o_totalprice > 150000) AS g, avg(300000 - o_totalprice) FILTER (o_totalprice <= 150000) AS l FROM orders GROUP BY ALL) SELECT strategy, round(least(0.25, greatest(0, wr - (1 - wr) / (g / l))), 6) AS kelly FROM s")
def kelly(spark, sf_dir):
    x = F.col("o_totalprice")
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.avg((x > 150000).cast("int")).alias("wr"), F.avg(F.when(x > 150000, x)).alias("g"), F.avg(F.when(x <= 150000, 300000 - x)).alias("l"))
    return out.select("strategy", F.round(T.kelly(F.col("wr"), F.col("g"), F.col("l")), 6).alias("kelly"))


@query("p4_position_size", "SELECT o_orderkey, CAST(floor(1e6 * CASE WHEN o_orderkey % 100 >= 80 THEN 0.3 WHEN o_orderkey % 100 >= 60 THEN 0.2 WHEN o_orderkey % 100 >= 40 THEN 0.1 ELSE 0 END * ((o_custkey % 100) / 100.0::DOUBLE) / (o_totalprice / 1000) / 100) * 100 AS BIGINT) AS shares FROM orders")
def position_size(spark, sf_dir):
    out = table(spark, sf_dir, "orders")
    strength, confidence = (F.col("o_orderkey") % 100) / 100.0, (F.col("o_custkey") % 100) / 100.0
    return out.select("o_orderkey", T.position_size(strength, confidence, F.lit(1e6), F.col("o_totalprice") / 1000).alias("shares"))


@query("p5_exit_reason", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN m <= -0.05 THEN 'stop_loss' WHEN m >= 0.05 THEN 'take_profit' WHEN m > 0 AND c <= pk * 0.97 THEN 'trailing' ELSE 'none' END AS reason FROM (SELECT *, c / 1000.0 - 1 AS m FROM (SELECT *, 900 + (l_partkey * 7 % 200)::DOUBLE AS c, 1000 + (l_suppkey % 90)::DOUBLE AS pk FROM lineitem))")
def exit_reason(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    current, peak = (900 + F.col("l_partkey") * 7 % 200).cast("double"), (1000 + F.col("l_suppkey") % 90).cast("double")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", T.exit_reason(F.lit(1000.0), current, peak, F.lit(True)).alias("reason"))


_FACTORS = {"momentum": 0.4, "volatility": 0.2, "liquidity": 0.3, "valuation": 0.1}
_FSQL = f"fm AS (SELECT symbol, m20 AS momentum, vol20 AS volatility, close AS valuation, v AS liquidity FROM bm JOIN (SELECT symbol, round(sum(amount), 2) AS v FROM w GROUP BY symbol) USING (symbol)), fs AS (SELECT symbol, " + " + ".join(f"(row_number() OVER (ORDER BY {k} {'DESC' if k in ('momentum', 'liquidity') else 'ASC'}, symbol) - 1) / (count(*) OVER () - 1) * {v}" for k, v in _FACTORS.items()) + " AS s FROM fm)"


@query("m1_four_factors", f"WITH {W}, {METRICS}, {_FSQL} SELECT symbol, round(s * 100, 2) AS score, row_number() OVER (ORDER BY round(s * 100, 10) DESC, symbol)::INTEGER AS rank FROM fs")
def four_factors(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    metrics = R.base_metrics(bars).select("symbol", F.col("m20").alias("momentum"), F.col("vol20").alias("volatility"), F.col("close").alias("valuation"))
    metrics = metrics.join(bars.groupBy("symbol").agg(F.round(F.sum("amount"), 2).alias("liquidity")), "symbol")
    return S.four_factors(metrics, _FACTORS).select("symbol", F.round("score", 2).alias("score"), "rank")


@query(
    "n1_market_regime",
    f"""WITH {W}, x AS (SELECT symbol, date, close, close / lag(close) {OVER} - 1 AS ret, close / lag(close, 20) {OVER} - 1 AS m20, close / lag(close, 60) {OVER} - 1 AS m60, row_number() {OVER} AS i, close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS mdd FROM w),
    y AS (SELECT *, {rolling('stddev_samp({})', 20, 'ret')} AS vol, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM x)
    SELECT symbol, date, round(vol, 6) AS vol, round(mdd, 6) AS mdd, round(m20, 6) AS m20, round(m60, 6) AS m60, CASE WHEN vol >= 0.3 AND mdd <= -0.08 THEN 'high_vol_risk' WHEN m20 >= 0.02 AND m60 >= 0.04 THEN 'bull' WHEN m20 <= -0.02 AND m60 <= -0.04 THEN 'bear' ELSE 'range' END AS regime,
    CASE WHEN vol >= 0.3 AND mdd <= -0.08 THEN 0.75 WHEN (m20 >= 0.02 AND m60 >= 0.04) OR (m20 <= -0.02 AND m60 <= -0.04) THEN 0.70 ELSE 0.55 END::DOUBLE AS confidence FROM y WHERE n = 1 AND i >= 70""",
)
def market_regime(spark, sf_dir):
    return rounded(S.market_regime(weekly_bars(spark, sf_dir), 1), 6, "vol", "mdd", "m20", "m60")


@query("e13_down_streak", f"WITH {W}, x AS (SELECT symbol, close < lag(close) {OVER} AS down, row_number() {OVER} AS i FROM w) SELECT symbol, max(i) - coalesce(max(i) FILTER (NOT coalesce(down, false)), 0) AS streak FROM x GROUP BY symbol")
def down_streak(spark, sf_dir):
    return S.down_streak(weekly_bars(spark, sf_dir))


@query("m2_tail_features", f"WITH {W}, x AS (SELECT symbol, date, close / ({rolling('avg({})', 5, 'close')}) - 1 AS a, volume / ({rolling('avg({})', 5, 'volume', 1)}) AS b, close / lag(close, 5) {OVER} - 1 AS c, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM w) SELECT symbol, date, round(a, 6) AS ma5_distance, round(b, 6) AS volume_ratio, round(c, 6) AS ret_5 FROM x WHERE n = 1")
def tail_features(spark, sf_dir):
    return rounded(S.tail_features(weekly_bars(spark, sf_dir)), 6, "ma5_distance", "volume_ratio", "ret_5")


@query("f5_capped_top", "WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_partkey, p_brand, p_retailprice FROM r WHERE n <= 2 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def capped_top(spark, sf_dir):
    return S.capped_top(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", "p_brand", "p_partkey", 20, 2)


@query("c10_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    """The five nearest of all vectors to each one whose id is divisible by 20."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asks = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return rounded(S.nearest_neighbours(points, asks, 5), 6, "distance")


def _rules(spark):
    return spark.createDataFrame([(1, "click", ">", 20.0, True), (2, "view", "<=", 1.0, True), (3, "error", ">=", 30.0, True), (4, "signup", "~", 1.0, True), (5, "purchase", "<", 2.0, False)], "rule_id int, symbol string, operator string, target double, enabled boolean")


_MATCH = "ma AS (SELECT r.rule_id, e.event_id, e.ts FROM (SELECT * FROM (VALUES (1, 'click', '>', 20.0), (2, 'view', '<=', 1.0), (3, 'error', '>=', 30.0)) t(rule_id, symbol, op, target)) r JOIN events e ON e.event_type = r.symbol AND CASE r.op WHEN '>' THEN value > target WHEN '<=' THEN value <= target WHEN '>=' THEN value >= target END)"


@query("b8_rule_matches", f"WITH {_MATCH} SELECT rule_id, event_id FROM ma")
def rule_matches(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", "ts", "value")
    return S.rule_matches(events, _rules(spark)).select("rule_id", "event_id")


@query(
    "i1_cooldown",
    f"""WITH RECURSIVE {_MATCH}, f AS (SELECT rule_id, min(ts) AS ts FROM ma GROUP BY rule_id UNION ALL SELECT f.rule_id, (SELECT min(m.ts) FROM ma m WHERE m.rule_id = f.rule_id AND m.ts >= f.ts + INTERVAL 6 HOURS) FROM f WHERE f.ts IS NOT NULL)
    SELECT m.rule_id, m.event_id, CASE WHEN f.ts IS NOT NULL THEN 'triggered' ELSE 'cooldown_skipped' END AS status FROM ma m LEFT JOIN (SELECT DISTINCT * FROM f) f ON f.rule_id = m.rule_id AND f.ts = m.ts""",
)
def cooldown(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", "ts", "value")
    return S.cooled(S.rule_matches(events, _rules(spark)), ["rule_id"], "ts", 6 * 3600)


@query(
    "b6_hard_gate",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '*ST' WHEN 1 THEN 'ST ' ELSE 'A' END || o_orderpriority AS name, o_custkey % 150 AS days, o_totalprice * 400 AS amount, (o_orderkey % 23 - 11)::DOUBLE AS pct FROM orders)
    SELECT o_orderkey, NOT regexp_matches(name, '^\\*?ST') AND days >= 60 AND amount >= 5e7 AND abs(pct) < 9.5 AS passed FROM x""",
)
def hard_gate(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 9 == 0, "*ST").when(key % 9 == 1, "ST ").otherwise("A"), "o_orderpriority")
    gate = S.hard_gate(name, F.col("o_custkey") % 150, F.col("o_totalprice") * 400, (key % 23 - 11).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("passed"))


@query("b9_units", "SELECT event_id, CASE WHEN value BETWEEN 5 AND 60 THEN 'price' WHEN value > 1000 AND value / 1000 BETWEEN 5 AND 60 THEN 'index_point' WHEN abs(value) < 0.1 THEN 'ratio' END AS unit FROM events")
def units(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.unit_of(F.col("value"), F.lit(5.0), F.lit(60.0)).alias("unit"))


@query("b12_clamp_range", f"WITH {W} SELECT symbol, date, round(least(low * 1.01, close), 6) AS lower, round(greatest(high * 0.99, close), 6) AS upper FROM w")
def clamp_range(spark, sf_dir):
    lower, upper = S.clamp_range(F.col("close"), F.col("low") * 1.01, F.col("high") * 0.99)
    return weekly_bars(spark, sf_dir).select("symbol", "date", F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"))
