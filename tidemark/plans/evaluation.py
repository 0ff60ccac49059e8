"""Queries on evaluation. Orders stand for signals: the priority is the strategy, status F is closed, the price gives the profit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import evaluation as X
from ..operators.bars import keep_last
from .panels import W, rounded, table, weekly_bars

SIGNALS = "sg AS (SELECT o_orderkey AS signal_id, o_orderpriority AS strategy, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, (o_totalprice - 150000) / 10000 AS pnl_pct, CAST(o_orderdate AS DATE) AS date, o_custkey FROM orders)"
PERF = """pf AS (SELECT strategy, count(*) AS total, count(*) FILTER (status = 'closed') AS closed, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) FILTER (status = 'closed') AS win_rate, avg(pnl_pct) FILTER (status = 'closed') AS gross_avg,
    avg(pnl_pct - 0.16) FILTER (status = 'closed') AS net_avg, max(pnl_pct) FILTER (status = 'closed') AS best, min(pnl_pct) FILTER (status = 'closed') AS worst FROM sg GROUP BY strategy)"""
SCORE = "so AS (SELECT *, abs(least(0, net_avg * 0.5)) AS drawdown_proxy, CASE WHEN closed < 10 THEN 50 ELSE 40 * win_rate + 40 * least(1, greatest(0, (net_avg + 5) / 10)) + 20 * (1 - least(1, greatest(0, abs(least(0, net_avg * 0.5)) / 10))) END AS score FROM pf)"


def signals(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal_id"), F.col("o_orderpriority").alias("strategy"), status.alias("status"), ((F.col("o_totalprice") - 150000) / 10000).alias("pnl_pct"), F.col("o_orderdate").cast("date").alias("date"), "o_custkey")


@query("d01_performance", f"WITH {SIGNALS}, {PERF} SELECT strategy, total, closed, round(win_rate, 6) AS win_rate, round(gross_avg, 6) AS gross_avg, round(net_avg, 6) AS net_avg, round(best, 6) AS best, round(worst, 6) AS worst FROM pf")
def performance(spark, sf_dir):
    return rounded(X.performance(signals(spark, sf_dir), ["strategy"]), 6, "win_rate", "gross_avg", "net_avg", "best", "worst")


@query("r03_strategy_score", f"WITH {SIGNALS}, {PERF}, {SCORE} SELECT strategy, closed, round(drawdown_proxy, 6) AS drawdown_proxy, round(score, 6) AS score FROM so")
def strategy_score(spark, sf_dir):
    return rounded(X.strategy_score(X.performance(signals(spark, sf_dir), ["strategy"])).select("strategy", "closed", "drawdown_proxy", "score"), 6, "drawdown_proxy", "score")


@query(
    "r05_adjusted_weights",
    f"""WITH {SIGNALS}, {PERF}, {SCORE}, t AS (SELECT strategy, 0.2 AS weight, least(0.6, greatest(0.1, 0.2 + least(0.1, greatest(-0.1, score / sum(score) OVER () - 0.2)))) AS w FROM so) SELECT strategy, round(w / sum(w) OVER (), 6) AS new_weight FROM t""",
)
def adjusted_weights(spark, sf_dir):
    scores = X.strategy_score(X.performance(signals(spark, sf_dir), ["strategy"])).withColumn("weight", F.lit(0.2))
    return rounded(X.adjusted_weights(scores).select("strategy", "new_weight"), 6, "new_weight")


@query(
    "c2_left_join_regime",
    f"""WITH {SIGNALS}, l AS (SELECT c_custkey, c_mktsegment AS regime FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT coalesce(regime, 'unlabeled') AS regime, count(*) AS total, count(*) FILTER (status = 'closed') AS closed, round(avg(pnl_pct) FILTER (status = 'closed'), 6) AS gross_avg FROM sg LEFT JOIN l ON o_custkey = c_custkey GROUP BY ALL""",
)
def left_join_regime(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("regime"))
    out = signals(spark, sf_dir).join(labels, "o_custkey", "left").withColumn("regime", F.coalesce("regime", F.lit("unlabeled")))
    return rounded(X.performance(out, ["regime"]).select("regime", "total", "closed", "gross_avg"), 6, "gross_avg")


@query("d15_latest_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return X.latest(rows, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("g2_union_keep_last", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def union_keep_last(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    both = orders.filter("o_orderkey % 2 = 0").unionByName(orders.filter("o_orderkey % 2 <> 0"))
    return rounded(keep_last(both, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate"), 2, "o_totalprice")


@query(
    "r01_upsert",
    "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN round(c_acctbal * 2, 2) END, round(c_acctbal, 2)) AS bal, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer",
)
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("bal"), F.col("c_mktsegment").alias("segment"))
    raw = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0")
    new = raw.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.round(F.col("c_acctbal") * 2, 2)).alias("bal"), F.lit("new").alias("segment"))
    return X.upsert(old, new, ["c_custkey"])


PRED = f"pr AS (SELECT symbol, date, ma - 2 * sd AS lower, ma + 2 * sd AS upper, high, low FROM (SELECT *, avg(close) OVER v AS ma, stddev_samp(close) OVER v AS sd, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE n = 10)"


def predictions(spark, sf_dir):
    """Ranges predicted as the mean of the ten bars before and two deviations."""
    from ..functions.windows import back, series

    frame = back(series("symbol"), 10, 1)
    out = weekly_bars(spark, sf_dir).select("symbol", "date", F.avg("close").over(frame).alias("m"), F.stddev_samp("close").over(frame).alias("s"), F.count("close").over(frame).alias("n")).filter("n = 10")
    return out.select("symbol", "date", (F.col("m") - 2 * F.col("s")).alias("lower"), (F.col("m") + 2 * F.col("s")).alias("upper"))


@query(
    "t1_range_verification",
    f"WITH {W}, {PRED} SELECT symbol, date, high <= upper AND low >= lower AS hit, round(CASE WHEN high > low THEN greatest(0, least(high, upper) - greatest(low, lower)) / (high - low) ELSE CASE WHEN high <= upper AND low >= lower THEN 1 ELSE 0 END END, 6) AS coverage FROM pr",
)
def range_verification(spark, sf_dir):
    out = X.range_verification(predictions(spark, sf_dir), weekly_bars(spark, sf_dir))
    return out.select("symbol", "date", "hit", F.round("coverage", 6).alias("coverage"))


@query("d06_hit_rate", f"WITH {W}, {PRED} SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN high <= upper AND low >= lower THEN 1.0 ELSE 0 END), 6) END AS hit_rate, round(avg(upper - lower), 6) AS mean_width, round(min(upper - lower), 6) AS min_width, round(max(upper - lower), 6) AS max_width, round(stddev_pop(upper - lower), 6) AS width_std FROM pr GROUP BY symbol")
def hit_rate(spark, sf_dir):
    rows = X.range_verification(predictions(spark, sf_dir), weekly_bars(spark, sf_dir)).withColumn("width", F.col("upper") - F.col("lower"))
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.when(F.count("*") >= 10, F.avg(F.col("hit").cast("int"))).alias("hit_rate"), F.avg("width").alias("mean_width"), F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.stddev_pop("width").alias("width_std"))
    return rounded(out, 6, "hit_rate", "mean_width", "min_width", "max_width", "width_std")


PY = "py AS (SELECT event_type, user_id, least(value / 100, 0.999) AS p, CASE WHEN event_id % 100 < value THEN 1.0 ELSE 0.0 END AS y FROM events)"


def probabilities(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "user_id", F.least(F.col("value") / 100, F.lit(0.999)).alias("p"), F.when(F.col("event_id") % 100 < F.col("value"), 1.0).otherwise(0.0).alias("y"))


@query("d12_calibration_error", f"WITH {PY}, b AS (SELECT event_type, least(floor(p * 5), 4) AS bin, count(*) AS k, avg(p) AS mp, avg(y) AS my FROM py GROUP BY ALL) SELECT event_type, round(sum(abs(mp - my) * k) / sum(k), 6) AS ece FROM b GROUP BY event_type")
def calibration_error(spark, sf_dir):
    return rounded(X.calibration_error(probabilities(spark, sf_dir), ["event_type"]), 6, "ece")


@query("d12_calibration_error_compat", f"WITH {PY}, n AS (SELECT event_type, count(*) AS n FROM py GROUP BY ALL), b AS (SELECT event_type, bin, count(*) AS k, avg(p) AS mp, avg(y) AS my FROM (SELECT *, least(floor(p * 5), 4) AS bin FROM py WHERE p < 0.8 UNION ALL SELECT *, 4 FROM py) GROUP BY ALL) SELECT event_type, round(sum(abs(mp - my) * k / n), 6) AS ece FROM b JOIN n USING (event_type) GROUP BY event_type")
def calibration_error_compat(spark, sf_dir):
    return rounded(X.calibration_error(probabilities(spark, sf_dir), ["event_type"], corrected=False), 6, "ece")


@query("d11_brier", f"WITH {PY} SELECT event_type, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier FROM py GROUP BY event_type")
def brier(spark, sf_dir):
    rows = probabilities(spark, sf_dir).withColumn("outcome", F.when(F.col("y") == 1, "up").otherwise("down"))
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(X.brier(F.col("p"), F.col("outcome"))).alias("brier")), 6, "brier")


@query("d13_weighted_quantile", "WITH r AS (SELECT o_orderpriority, o_totalprice AS x, sum(o_shippriority) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS run, sum(o_shippriority) OVER (PARTITION BY o_orderpriority) AS total FROM (SELECT o_orderpriority, o_totalprice, 1 + o_orderkey % 5 AS o_shippriority FROM orders)) SELECT o_orderpriority, round(min(x), 2) AS value FROM r WHERE run >= 0.8 * total - 1e-12 GROUP BY ALL")
def weighted_quantile(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", (1 + F.col("o_orderkey") % 5).alias("k"))
    return rounded(X.weighted_quantile(rows, ["o_orderpriority"], "o_totalprice", "k", 0.8), 2, "value")


@query(
    "d14_outlier_fusion",
    f"""WITH {W}, {PRED}, m AS (SELECT *, (lower + upper) / 2 AS m, 1.0 + isodow(date) % 3 + length(symbol) % 2 AS wt FROM pr),
    z AS (SELECT *, count(*) OVER p AS n, avg(m) OVER p AS mean, stddev_samp(m) OVER p AS dev FROM m WINDOW p AS (PARTITION BY date)),
    k AS (SELECT *, sum(wt) OVER (PARTITION BY date) AS total, sum(wt) OVER (PARTITION BY date ORDER BY lower) AS lo, sum(wt) OVER (PARTITION BY date ORDER BY upper) AS hi FROM z WHERE n < 3 OR coalesce(dev <= 1e-12, true) OR abs(m - mean) <= 2 * dev),
    q AS (SELECT date, min(lower) FILTER (lo >= 0.2 * total) AS a, min(upper) FILTER (hi >= 0.8 * total) AS b, count(*) AS kept FROM k GROUP BY date)
    SELECT date, round(least(a, b), 6) AS lower, round(greatest(a, b), 6) AS upper, kept FROM q""",
)
def outlier_fusion(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("wt", 1.0 + (F.weekday("date") + 1) % 3 + F.length("symbol") % 2)
    return rounded(X.outlier_fusion(rows, ["date"], "wt"), 6, "lower", "upper")


@query(
    "d16_tercile_spread",
    f"WITH {SIGNALS}, r AS (SELECT strategy, pnl_pct, row_number() OVER (PARTITION BY strategy ORDER BY o_custkey DESC, signal_id) AS r, count(*) OVER (PARTITION BY strategy) AS n FROM sg) SELECT strategy, round(avg(pnl_pct) FILTER (r <= greatest(1, n // 3)), 6) AS top, round(avg(pnl_pct) FILTER (r > n - greatest(1, n // 3)), 6) AS bottom, round(avg(pnl_pct) FILTER (r <= greatest(1, n // 3)) - avg(pnl_pct) FILTER (r > n - greatest(1, n // 3)), 6) AS spread FROM r GROUP BY strategy",
)
def tercile_spread(spark, sf_dir):
    return rounded(X.tercile_spread(signals(spark, sf_dir), ["strategy"], "o_custkey", "pnl_pct", "signal_id"), 6, "top", "bottom", "spread")


@query("d18_concentration", "WITH p AS (SELECT s_nationkey, s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey) AS s FROM supplier WHERE s_acctbal > 0) SELECT s_nationkey, round(sum(s * s), 6) AS hhi FROM p GROUP BY s_nationkey")
def concentration(spark, sf_dir):
    return rounded(X.concentration(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal"), 6, "hhi")


@query("d20_histogram", "SELECT CAST(round(l_quantity) AS BIGINT) AS days, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.round("l_quantity").cast("long").alias("days")).agg(F.count("*").alias("n"))


@query("d21_daily_counts", "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"))


@query("d22_breadth", f"WITH {W}, r AS (SELECT date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM w) SELECT date, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, round(CASE WHEN count(*) FILTER (d > 0) + count(*) FILTER (d < 0) > 0 THEN count(*) FILTER (d > 0) / (count(*) FILTER (d > 0) + count(*) FILTER (d < 0)) END, 6) AS ratio FROM r WHERE d IS NOT NULL GROUP BY date")
def breadth(spark, sf_dir):
    from ..functions.windows import series

    rows = weekly_bars(spark, sf_dir).select("date", (F.col("close") - F.lag("close").over(series("symbol"))).alias("d")).filter("d IS NOT NULL")
    out = rows.groupBy("date").agg(F.sum((F.col("d") > 0).cast("long")).alias("up"), F.sum((F.col("d") < 0).cast("long")).alias("down"))
    return out.withColumn("ratio", F.round(F.when(F.col("up") + F.col("down") > 0, F.col("up") / (F.col("up") + F.col("down"))), 6))


@query("d23_status_fold", "SELECT user_id, ['ok', 'degraded', 'error'][1 + max(CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 ELSE 1 END)] AS status FROM events GROUP BY user_id")
def status_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type")).alias("s"))
    return X.fold_status(rows, ["user_id"], "s")


@query("d24_execution_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def execution_stats(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))
    return rounded(out, 6, "mean", "p50", "p95")


@query("d17_tag_attribution", "SELECT tag, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT unnest(string_split(p_type, ' ')) AS tag, p_retailprice AS v FROM part) GROUP BY tag")
def tag_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("tag"), F.col("p_retailprice").alias("v"))
    return rounded(rows.groupBy("tag").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), 6, "mean")


@query("t2_direction_verification", f"WITH {W}, p AS (SELECT symbol, date AS base, lead(date, 4) OVER (PARTITION BY symbol ORDER BY date) AS target, CASE WHEN close > lag(close) OVER (PARTITION BY symbol ORDER BY date) THEN 'up' ELSE 'down' END AS direction, close AS c0, lead(close, 4) OVER (PARTITION BY symbol ORDER BY date) AS c1 FROM w) SELECT symbol, base, target, direction, round((c1 - c0) / c0, 8) AS move, sign((c1 - c0) / c0) = CASE WHEN direction = 'up' THEN 1 ELSE -1 END AS correct FROM p WHERE target IS NOT NULL")
def direction_verification(spark, sf_dir):
    from ..functions.windows import series

    bars, w = weekly_bars(spark, sf_dir), series("symbol")
    asks = bars.select("symbol", F.col("date").alias("base"), F.lead("date", 4).over(w).alias("target"), F.when(F.col("close") > F.lag("close").over(w), "up").otherwise("down").alias("direction")).filter("target IS NOT NULL")
    return rounded(X.direction_verification(asks, bars).select("symbol", "base", "target", "direction", "move", "correct"), 8, "move")
