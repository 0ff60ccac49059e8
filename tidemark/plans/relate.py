"""Queries on joins in time, sets, fills and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import relate as J
from .evaluation import PRED, predictions
from .panels import W, rounded, table, weekly_bars


@query("c5_next_session", f"WITH {W}, n AS (SELECT symbol, date, close, lead(date) OVER v AS next_date, lead(open) OVER v AS next_open, lead(low) OVER v AS next_low FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, date, round(close, 6) AS close, next_date, round(next_open, 6) AS next_open, round(next_low, 6) AS next_low FROM n WHERE next_date IS NOT NULL")
def next_session(spark, sf_dir):
    out = J.with_next(weekly_bars(spark, sf_dir), "open", "low").select("symbol", "date", "close", "next_date", "next_open", "next_low")
    return rounded(out, 6, "close", "next_open", "next_low")


@query("e14_lead_label", f"WITH {W} SELECT symbol, date, CASE WHEN lead(open) OVER v >= close THEN 1 WHEN lead(open) OVER v < close THEN 0 END AS label FROM w WINDOW v AS (PARTITION BY symbol ORDER BY date)")
def lead_label(spark, sf_dir):
    from ..functions.windows import series

    then = F.lead("open").over(series("symbol"))
    return weekly_bars(spark, sf_dir).select("symbol", "date", F.when(then >= F.col("close"), 1).when(then < F.col("close"), 0).alias("label"))


@query(
    "c8_nearest_in_time",
    "SELECT event_type, CAST(ts AS DATE) AS date, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY abs(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) - 54000), ts, event_id) = 1",
)
def nearest_in_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("date"), "ts", "event_id", "value")
    return J.nearest_in_time(rows, ["event_type", "date"], "ts", 900, ["ts", "event_id"]).select("event_type", "date", "event_id", "value")


@query(
    "c9_recent_events",
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT a.event_id, count(e.event_id) AS n, arg_max(e.value, row(e.ts, e.event_id)) AS last
    FROM a LEFT JOIN events e ON e.user_id = a.user_id AND e.event_type <> 'purchase' AND e.ts <= a.ts AND e.ts > a.ts - INTERVAL 120 MINUTES GROUP BY a.event_id""",
)
def recent_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    asks = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return J.recent(asks, events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts", "value"), "user_id", "ts", 120, "event_id", "value").select("event_id", "n", "last")


@query("e15_min_max", f"WITH {W} SELECT symbol, date, round(CASE WHEN max(close) OVER v > min(close) OVER v THEN (close - min(close) OVER v) / (max(close) OVER v - min(close) OVER v) ELSE 0.5 END, 6) AS share FROM w WINDOW v AS (PARTITION BY date)")
def min_max(spark, sf_dir):
    return weekly_bars(spark, sf_dir).select("symbol", "date", F.round(J.min_max("close", ["date"]), 6).alias("share"))


@query("e17_last_summary", f"WITH {W}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM w), s AS (SELECT symbol, count(*) AS rows, arg_max(close, n) AS first, arg_min(close, n) AS last FROM l WHERE n <= 20 GROUP BY symbol) SELECT symbol, rows, round(first, 6) AS first, round(last, 6) AS last, round((last - first) / first * 100, 6) AS change FROM s")
def last_summary(spark, sf_dir):
    return rounded(J.last_summary(weekly_bars(spark, sf_dir), 20), 6, "first", "last", "change")


_GAPPED = "g AS (SELECT symbol, date, CASE WHEN (day(date) + length(symbol)) % 9 < 6 AND month(date) % 3 = 0 THEN NULL ELSE close END AS close FROM w)"


@query(
    "e18_fill_gaps",
    f"WITH {W}, {_GAPPED}, f AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM g) SELECT symbol, date, round(first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS close FROM f",
)
def fill_gaps(spark, sf_dir):
    gone = ((F.day("date") + F.length("symbol")) % 9 < 6) & (F.month("date") % 3 == 0)
    bars = weekly_bars(spark, sf_dir).select("symbol", "date", F.when(~gone, F.col("close")).alias("close"))
    return rounded(J.fill_gaps(bars, "close", 2), 6, "close")


@query(
    "e19_divergence",
    f"""WITH {W}, v AS (SELECT symbol, date, close, volume, count(*) OVER p AS n, min(close) OVER p AS lo, max(close) OVER p AS hi, arg_min(volume, row(close, date)) OVER p AS a, arg_max(volume, row(close, date)) OVER p AS b FROM w WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING))
    SELECT symbol, date, CASE WHEN n = 9 AND close <= lo AND volume >= a + 5 THEN 'bottom' WHEN n = 9 AND close >= hi AND volume <= b - 5 THEN 'top' ELSE 'none' END AS divergence FROM v""",
)
def divergence(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("symbol", "date", "close", "volume")
    return J.extreme_divergence(bars, "close", "volume", 10, 5.0).select("symbol", "date", "divergence")


@query("f2_multi_sort", "SELECT symbol, place, strategy FROM (SELECT o_custkey AS symbol, o_orderpriority AS strategy, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def multi_sort(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus").desc(), F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).filter("place <= 3").select(F.col("o_custkey").alias("symbol"), "place", F.col("o_orderpriority").alias("strategy"))


@query("f3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    """The limit is the feature; Spark keeps the best rows of each task and merges these."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("g1_union_all", "SELECT 'order' AS source, o_custkey AS key, o_totalprice AS amount FROM orders UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer")
def union_all(spark, sf_dir):
    part = lambda name, source, key, amount: table(spark, sf_dir, name).select(F.lit(source).alias("source"), F.col(key).alias("key"), F.col(amount).alias("amount"))
    return part("orders", "order", "o_custkey", "o_totalprice").unionByName(part("supplier", "supplier", "s_suppkey", "s_acctbal")).unionByName(part("customer", "customer", "c_custkey", "c_acctbal"))


_SETS = "t AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS r FROM w), s AS (SELECT date, list(symbol ORDER BY r) FILTER (r <= 5) AS items FROM t GROUP BY date)"


@query(
    "l14_turnover",
    f"""WITH {W}, {_SETS}, p AS (SELECT date, items, lag(items) OVER (ORDER BY date) AS was FROM s), k AS (SELECT date, items, was, len(list_intersect(items, coalesce(was, []))) AS kept FROM p)
    SELECT date, array_to_string(items, ',') AS items, CAST(kept AS INTEGER) AS kept, round(CASE WHEN was IS NULL THEN 0 ELSE 1 - kept / 5.0 END, 6) AS turnover, CASE WHEN was IS NULL OR 1 - kept / 5.0 < 0.3 - 1e-12 THEN 'stable' WHEN 1 - kept / 5.0 < 0.6 - 1e-12 THEN 'normal' ELSE 'fast' END AS label FROM k""",
)
def top_turnover(spark, sf_dir):
    """One set a week, so that the window over all weeks is small."""
    out = J.turnover(J.top_sets(weekly_bars(spark, sf_dir), ["date"], "close", "symbol", 5), [], "date", 5)
    return rounded(out.withColumn("items", F.array_join("items", ",")), 6, "turnover")


@query("g3_key_sets", "SELECT coalesce(a.k, b.k) AS user_id, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase') a FULL JOIN (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click') b ON a.k = b.k")
def key_sets(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    return J.key_sets(events.filter("event_type = 'purchase'"), events.filter("event_type = 'click'"), "user_id")


@query("g4_first_distinct", "WITH f AS (SELECT user_id, event_type, min(row(ts, event_id)) AS seen FROM events GROUP BY ALL) SELECT user_id, CAST(place AS INTEGER) AS place, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS place FROM f) WHERE place <= 3")
def first_distinct(spark, sf_dir):
    return J.first_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"], 3)


_METHODS = f"{PRED}, m AS (SELECT p.*, w.close AS base, 0.5 + (day(p.date) % 5) / 10.0 AS confidence, p.high <= p.upper AND p.low >= p.lower AS hit, (p.high - p.low) / w.close * 100 AS real, CASE WHEN month(p.date) % 2 = 0 THEN 'band' ELSE 'mean' END AS method, day(p.date) % 3 = 0 AS calibrated FROM pr p JOIN w USING (symbol, date))"
_PERF = "count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(x), 6) AS mean_width, round(min(x), 6) AS min_width, round(max(x), 6) AS max_width, round(stddev_pop(x), 6) AS width_dev, round(avg(confidence), 6) AS confidence, round(1 - least(1, abs(avg(x) / avg(real) - 1)), 6) AS calibration"


def method_rows(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("symbol", "date", "high", "low", F.col("close").alias("base"))
    rows = predictions(spark, sf_dir).join(bars, ["symbol", "date"])
    return rows.select(
        "symbol", "lower", "upper", "base", (0.5 + F.day("date") % 5 / 10.0).alias("confidence"), ((F.col("high") <= F.col("upper")) & (F.col("low") >= F.col("lower"))).alias("hit"),
        ((F.col("high") - F.col("low")) / F.col("base") * 100).alias("real"), F.when(F.month("date") % 2 == 0, "band").otherwise("mean").alias("method"), (F.day("date") % 3 == 0).alias("calibrated"),
    )


_MEASURES = ("hit_rate", "mean_width", "min_width", "max_width", "width_dev", "confidence", "calibration")


@query("d03_method_performance", f"WITH {W}, {_METHODS} SELECT method, {_PERF} FROM (SELECT *, (upper - lower) / base * 100 AS x FROM m) GROUP BY method")
def method_performance(spark, sf_dir):
    return rounded(J.method_performance(method_rows(spark, sf_dir), ["method"]), 6, *_MEASURES)


@query("d07_width_stats", f"WITH {W}, {_METHODS} SELECT symbol, {_PERF} FROM (SELECT *, (upper - lower) / base * 100 AS x FROM m) GROUP BY symbol")
def width_stats(spark, sf_dir):
    """Also D8: how near the mean width is to the real one."""
    return rounded(J.method_performance(method_rows(spark, sf_dir), ["symbol"]), 6, *_MEASURES)


@query("d09_calibrated_or_not", f"WITH {W}, {_METHODS} SELECT method, calibrated, {_PERF} FROM (SELECT *, (upper - lower) / base * 100 AS x FROM m) GROUP BY method, calibrated")
def calibrated_or_not(spark, sf_dir):
    return rounded(J.method_performance(method_rows(spark, sf_dir), ["method", "calibrated"]), 6, *_MEASURES)


@query(
    "d04_sum_of_parts",
    """WITH p AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS market, CASE WHEN l_returnflag = 'N' AND day(l_shipdate) % 2 = 0 THEN NULL ELSE l_extendedprice END AS x FROM lineitem WHERE l_returnflag <> 'A'),
    d AS (SELECT date, sum(x) AS total, count(DISTINCT market) AS markets FROM p GROUP BY date), c AS (SELECT *, lag(total) OVER (ORDER BY date) AS was FROM d)
    SELECT date, markets, round(total, 2) AS total, round(CASE WHEN was <> 0 THEN (total - was) / was END, 6) AS change, CASE WHEN was <> 0 AND total IS NOT NULL THEN round(greatest(-0.3, least(0.3, (total - was) / was * 10)), 6) END AS proxy FROM c""",
)
def sum_of_parts(spark, sf_dir):
    """Markets summed by day (null if all are), the change since the day before and its held multiple. A day is one row, so the window is small."""
    from pyspark.sql import Window

    from ..functions.scalars import clamp, safe_ratio

    x = F.when(~((F.col("l_returnflag") == "N") & (F.day("l_shipdate") % 2 == 0)), F.col("l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'A'").select(F.to_date("l_shipdate").alias("date"), "l_returnflag", x.alias("x"))
    out = rows.groupBy("date").agg(F.sum("x").alias("total"), F.count_distinct("l_returnflag").alias("markets"))
    was = F.lag("total").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    out = out.withColumn("change", safe_ratio(F.col("total") - was, was))
    return rounded(rounded(out.withColumn("proxy", clamp(F.col("change") * 10, -0.3, 0.3)), 2, "total"), 6, "change", "proxy").select("date", "markets", "total", "change", "proxy")


@query(
    "d05_daily_fields",
    "SELECT event_type, CAST(ts AS DATE) AS date, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, arg_min(value, row(abs(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) - 54000), ts, event_id)) AS close, arg_max(value, row(ts, event_id)) AS last FROM events GROUP BY ALL",
)
def daily_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("date"), "ts", "event_id", "value")
    return rounded(J.daily_fields(rows, ["event_type", "date"], "value", "ts", "event_id"), 6, "mean", "median")


@query("d10_direction_totals", "SELECT event_type, count(*) AS total FROM events GROUP BY ALL")
def direction_totals(spark, sf_dir):
    """What the rule gives: totals only."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"))


@query("d19_weighted_confidence", "SELECT o_custkey, round(sum(CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 50) / 100.0 * o_totalprice / 500000 ELSE 0 END), 6) AS confidence FROM orders GROUP BY o_custkey")
def weighted_confidence(spark, sf_dir):
    """A missing confidence adds nothing, and the weights are not taken anew."""
    conf = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 50 / 100.0)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum(F.coalesce(conf, F.lit(0.0)) * F.col("o_totalprice") / 500000), 6).alias("confidence"))
