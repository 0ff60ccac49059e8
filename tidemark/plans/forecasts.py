"""Queries on fitted forecasts, over weekly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import forecasts as P
from .indicators import OVER, rolling
from .panels import W, rounded, weekly_bars

#: The date from which bars are test bars.
SPLIT = "1997-01-01"
_RETURNS = ", ".join(f"close / nullif(lag(close, {k}) {OVER}, 0) - 1 AS ret{k}" for k in (1, 3, 5, 10, 20))
_FEATURES = f"""fa AS (SELECT symbol, date, open, close, volume, {_RETURNS}, {rolling('avg({})', 5, 'volume')} AS v5 FROM w),
    fb AS (SELECT *, volume / nullif(v5, 0) AS vol_ratio_1d_5d, {rolling('stddev_samp({})', 5, 'ret1')} AS volatility_5d, {rolling('stddev_samp({})', 20, 'ret1')} AS volatility_20d, ret5 - ret20 AS mom_gap_5_20, ret5 - ret10 AS ret_accel,
           CASE WHEN lead(close) {OVER} > close THEN 1.0 WHEN lead(close) {OVER} IS NOT NULL THEN 0.0 END AS label, lead(date) {OVER} AS known_at FROM fa)"""
_SCALED = ", ".join(f"round((f.{c} - m_{c}) / CASE WHEN b_{c} > a_{c} THEN s_{c} ELSE 1 END, 6) AS {c}" for c in P.FEATURES)
_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS a_{c}, max({c}) AS b_{c}" for c in P.FEATURES)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*P.FEATURES, "label"))


@query(
    "s3_scaled_features",
    f"""WITH {W}, {_FEATURES}, st AS (SELECT symbol, {_STATS} FROM fb WHERE known_at < DATE '{SPLIT}' AND {_COMPLETE} GROUP BY symbol HAVING count(*) >= 80)
    SELECT f.symbol, f.date, CASE WHEN known_at < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS part, label, {_SCALED} FROM fb f JOIN st USING (symbol) WHERE {_COMPLETE}""",
)
def scaled_features(spark, sf_dir):
    """The predictor's features, scaled by what the training bars alone say."""
    rows = P.return_features(weekly_bars(spark, sf_dir)).withColumn("part", F.when(F.col("known_at") < F.lit(SPLIT).cast("date"), "train").otherwise("test")).dropna(subset=[*P.FEATURES, "label"])
    train = rows.filter("part = 'train'").groupBy("symbol").agg(F.count("*").alias("n"), *[f(c).alias(f"{a}_{c}") for c in P.FEATURES for a, f in (("m", F.avg), ("s", F.stddev_pop), ("a", F.min), ("b", F.max))]).filter("n >= 80")
    scaled = [F.round((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"b_{c}") > F.col(f"a_{c}"), F.col(f"s_{c}")).otherwise(1.0), 6).alias(c) for c in P.FEATURES]
    return rows.join(train, "symbol").select("symbol", "date", "part", "label", *scaled)


@query("s3_logistic")
def logistic(spark, sf_dir):
    """Probabilities of a rise, by a model per symbol that has seen no bar of the test period."""
    out = P.logistic_forecast(weekly_bars(spark, sf_dir), F.lit(SPLIT).cast("date"))
    return rounded(out, 6, "probability_up", "score")


_GRID = ", ".join(f"({j}, {a})" for j, a in enumerate(P.ALPHAS))
_NEXT = f"""na AS (SELECT symbol, date, (close / nullif(lag(close) {OVER}, 0) - 1) * 100 AS m, CASE WHEN lead(open) {OVER} >= close THEN 1 WHEN lead(open) {OVER} IS NOT NULL THEN 0 END AS label, date_diff('day', date, lead(date) {OVER}) AS gap FROM w),
    nx AS MATERIALIZED (SELECT *, avg(m) OVER (PARTITION BY date) AS i FROM na),
    np AS (SELECT a.symbol, a.date, b.date AS other, round((a.m * b.m + a.i * b.i) / (sqrt(a.m * a.m + a.i * a.i) * sqrt(b.m * b.m + b.i * b.i)), 12) AS sim FROM nx a JOIN nx b ON a.symbol = b.symbol AND b.date < a.date WHERE a.m * a.m + a.i * a.i > 0 AND b.m * b.m + b.i * b.i > 0),
    nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY sim DESC, other DESC) AS place FROM np QUALIFY place <= 20),
    nv AS (SELECT nn.symbol, nn.date, sum(CASE WHEN o.gap > 7 THEN 0.7 ELSE 1 END * o.label) / sum(CASE WHEN o.gap > 7 THEN 0.7 ELSE 1 END) AS p_up FROM nn JOIN nx o ON o.symbol = nn.symbol AND o.date = nn.other AND o.label IS NOT NULL GROUP BY nn.symbol, nn.date),
    nm AS (SELECT a.symbol, a.date, CASE WHEN count(*) >= 5 THEN least(1, greatest(-1, (avg(CASE WHEN b.m <= a.m THEN 1.0 ELSE 0 END) * 100 - 50) / 50)) END AS momentum FROM nx a JOIN nx b ON a.symbol = b.symbol AND b.date < a.date AND b.m IS NOT NULL WHERE a.m IS NOT NULL GROUP BY a.symbol, a.date, a.m),
    ns AS MATERIALIZED (SELECT nx.symbol, nx.date, nx.label, coalesce(nm.momentum, 0) AS momentum, nv.p_up, 0.5 * coalesce(nm.momentum, 0) + 0.3 * coalesce(2 * nv.p_up - 1, 0) AS s FROM nx LEFT JOIN nm USING (symbol, date) LEFT JOIN nv USING (symbol, date))"""


@query("s4_neighbours", f"WITH {W}, {_NEXT} SELECT symbol, date, other AS other_date, round(sim, 8) AS similarity, place FROM nn")
def neighbours(spark, sf_dir):
    """The 20 most similar earlier weeks of each week, by its return and the market's."""
    return rounded(P.earlier_neighbours(P.next_open_rows(weekly_bars(spark, sf_dir)), "symbol", "date", ["m", "i"], 20), 8, "similarity")


@query(
    "s4_next_open",
    f"""WITH {W}, {_NEXT}, ag AS (SELECT * FROM (VALUES {_GRID}) t(j, alpha)),
    ab AS (SELECT symbol, date, j, alpha, count((1 / (1 + exp(-alpha * s)) - label) ** 2) OVER wd AS n, avg((1 / (1 + exp(-alpha * s)) - label) ** 2) OVER wd AS b FROM ns CROSS JOIN ag WINDOW wd AS (PARTITION BY symbol, j ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    ac AS (SELECT symbol, date, arg_min(alpha, row(round(b, 12), j)) AS alpha, min(b) AS brier FROM ab WHERE n >= 20 GROUP BY symbol, date)
    SELECT ns.symbol, ns.date, ns.label, round(momentum, 8) AS momentum, round(p_up, 8) AS p_up, round(s, 8) AS s, coalesce(ac.alpha, 1)::DOUBLE AS alpha, round(ac.brier, 8) AS brier, round(1 / (1 + exp(-coalesce(ac.alpha, 1) * s)), 8) AS p_up_rule FROM ns LEFT JOIN ac USING (symbol, date)""",
)
def next_open(spark, sf_dir):
    """The chance that the next open is no lower than the close: momentum, the vote of earlier neighbours, and a weight calibrated on the 60 weeks before."""
    out = P.calibrated(P.next_open_scores(P.next_open_rows(weekly_bars(spark, sf_dir)), long_gap=7))
    return rounded(out.drop("m", "i", "gap"), 8, "momentum", "p_up", "s", "brier", "p_up_rule")


@query("k13_garch")
def garch(spark, sf_dir):
    """GARCH(1, 1) of each brand's weekly returns, and the range of the next week."""
    return P.garch_forecast(weekly_bars(spark, sf_dir))


@query("n7_arima_orders")
def arima_orders(spark, sf_dir):
    return P.arima_fits(weekly_bars(spark, sf_dir))


@query("n7_arima_trend")
def arima_trend(spark, sf_dir):
    """Each brand's best ARIMA order, and the trend that it forecasts."""
    return P.arima_trend(weekly_bars(spark, sf_dir))
