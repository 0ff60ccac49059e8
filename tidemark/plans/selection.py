"""Queries on selections from end to end: rotation over weekly bars, screening over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import rotation as R
from ..operators import selection as X
from .panels import W, rounded, table, weekly_bars
from .rotation import CORR, METRICS
from ..operators.scoring import trend_label
from .scoring import _LABEL as LABEL
from .scoring import _PARADIGMS, overnight_impact, paradigms, trends
from .scoring import _TREND as TREND

RULES = X.RotationRules(ma="soft", ma_penalty=0.8, volatility="soft", volatility_range=(0.0, 12.0), drawdown="hard", drawdown_least=-0.97, crowding_soft=0.9, crowding_hard=0.995, correlation="filter", mean_most=0.14)
_RANKS = ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY pool) > 1 THEN (row_number() OVER (PARTITION BY pool ORDER BY {k} {'ASC' if k in R.ASCENDING else 'DESC'} NULLS LAST, symbol) - 1) / (count(*) OVER (PARTITION BY pool) - 1) ELSE 1 END * {v} AS s_{k}" for k, v in R.WEIGHTS.items()
)
_JUDGED = f"""jp AS (SELECT bm.*, coalesce(mean_corr, 0) AS mean_corr, CASE CAST(substr(symbol, 7) AS INTEGER) % 2 WHEN 0 THEN 'industry' ELSE 'concept' END AS pool FROM bm LEFT JOIN mc USING (symbol)),
    jg AS (SELECT *, CASE WHEN crowding >= 0.995 THEN 'crowding' WHEN mean_corr > 0.14 THEN 'high_mean_corr' WHEN mdd60 < -0.97 THEN 'drawdown' WHEN m60 IS NULL THEN 'short_history' END AS reason,
           CASE WHEN NOT above_ma THEN 0.8 ELSE 1 END * CASE WHEN vol20 < 0 OR vol20 > 12 THEN 0.9 ELSE 1 END * CASE WHEN crowding >= 0.9 THEN 0.95 ELSE 1 END AS penalty FROM jp),
    jr AS (SELECT *, {_RANKS} FROM jg WHERE reason IS NULL), js AS (SELECT symbol, pool, ({' + '.join(f's_{k}' for k in R.WEIGHTS)}) * penalty AS score FROM jr),
    jt AS (SELECT *, row_number() OVER (ORDER BY round(score, 10) DESC, symbol) AS rank, row_number() OVER (PARTITION BY pool ORDER BY round(score, 10) DESC, symbol) AS pool_rank FROM js)"""


def _pools(bars):
    return bars.select("symbol").distinct().withColumn("pool", F.when(F.substring("symbol", 7, 9).cast("int") % 2 == 0, "industry").otherwise("concept"))


def _rotation(spark, sf_dir, rules):
    bars = weekly_bars(spark, sf_dir)
    pools = _pools(bars)
    return pools, X.rotation(bars, pools, rules)


@query("l15_rotation", f"WITH {W}, {METRICS}, {CORR}, {_JUDGED} SELECT jg.symbol, jg.pool, rank, pool_rank, round(score, 6) AS score, round(penalty, 6)::DOUBLE AS penalty, reason FROM jg LEFT JOIN jt USING (symbol)")
def rotation(spark, sf_dir):
    """The rotation ranking from bars to ranks, with hard and soft rules and the filter on mean correlation."""
    return rounded(_rotation(spark, sf_dir, RULES)[1], 6, "score", "penalty")


@query("l15_readiness", f"WITH {W}, {METRICS}, {CORR}, {_JUDGED} SELECT jg.pool, count(*) AS total, count(rank) AS available, count(rank) < 5 AS degraded FROM jg LEFT JOIN jt USING (symbol) GROUP BY jg.pool")
def readiness(spark, sf_dir):
    pools, ranking = _rotation(spark, sf_dir, RULES)
    return X.rotation_readiness(pools, ranking)


@query("l15_rotation_greedy")
def rotation_greedy(spark, sf_dir):
    """The same with symbols dropped that move with a better one."""
    return rounded(_rotation(spark, sf_dir, X.RotationRules(correlation="filter_greedy", pair_most=0.25, drawdown="off"))[1], 6, "score", "penalty")


_ENTRY = {"fund_flow": 72.0, "tail_grab": 62.0, "oversold": 65.0}
_SCORED = f"""{_PARADIGMS}, pl AS (SELECT symbol, amount, symbol % 7 AS class, name AS paradigm, score FROM pd UNPIVOT (score FOR name IN (fund_flow, tail_grab, oversold))),
    px AS (SELECT *, score * 0.95 AS s FROM pl), pe AS (SELECT *, s >= CASE paradigm WHEN 'fund_flow' THEN 72 WHEN 'tail_grab' THEN 62 ELSE 65 END - CASE WHEN symbol % 11 = 0 THEN 8 ELSE 0 END AS ok FROM px),
    pf AS (SELECT *, max(ok::INT) OVER (PARTITION BY paradigm) = 0 AS fallback FROM pe),
    po AS (SELECT paradigm, symbol, class, amount, s AS score, fallback, row_number() OVER (PARTITION BY paradigm ORDER BY round(s, 10) DESC, symbol) AS place FROM pf WHERE ok OR fallback QUALIFY place <= 10)"""


def _pooled(spark, sf_dir):
    rows = paradigms(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("paradigm"), F.col(k).alias("score")) for k in _ENTRY]))
    long = rows.select("symbol", "amount", (F.col("symbol") % 7).alias("class"), each.alias("x")).select("symbol", "amount", "class", "x.*")
    return X.pooled(long, _ENTRY, F.lit(0.95), F.col("symbol") % 11 == 0)


@query("m4_entry_pools", f"WITH {_SCORED} SELECT paradigm, symbol, class, amount, round(score, 6) AS score, place, fallback FROM po")
def entry_pools(spark, sf_dir):
    """Each paradigm's ten best under the market's multiplier, with relief for degraded rows and a fall-back."""
    return rounded(_pooled(spark, sf_dir), 6, "score")


_MERGED = """pb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 10) DESC, paradigm) AS n FROM po),
    pm AS (SELECT symbol, any_value(class) FILTER (n = 1) AS class, any_value(paradigm) FILTER (n = 1) AS "primary", any_value(score) FILTER (n = 1) + least(12, (count(*) - 1) * 4) + least(2, any_value(amount) FILTER (n = 1) / 5e8 * 2) AS score, array_to_string(list_sort(list(paradigm)), ',') AS paradigms, max((place = 1)::INT) AS first FROM pb GROUP BY symbol),
    pc AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(score, 10) DESC, symbol) <= 2 AS ok FROM pm),
    pp AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY round(score, 10) DESC, symbol) END AS p FROM pc)"""


@query("m10_tail_screening", f"WITH {_SCORED}, {_MERGED} SELECT symbol, class, \"primary\", round(score, 6) AS score, paradigms, CASE WHEN p <= 5 THEN p END AS place, concat_ws(',', CASE WHEN p <= 5 THEN 'top' END, CASE WHEN first = 1 THEN 'first' END) AS tags FROM pp WHERE p <= 5 OR first = 1")
def tail_screening(spark, sf_dir):
    """From scores to the list: pools, confluence, caps by class, pool firsts."""
    out = X.merged_pools(_pooled(spark, sf_dir))
    return rounded(out.withColumns({"paradigms": F.array_join("paradigms", ","), "tags": F.array_join("tags", ",")}), 6, "score")


@query(
    "m7_weekly_limit",
    """WITH RECURSIVE pk AS (SELECT DISTINCT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders WHERE year(o_orderdate) < 1997), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM pk),
    f AS (SELECT symbol, date, i, true AS allowed, [date] AS kept FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.date, n.i, len(list_filter(f.kept, lambda x: n.date - x < 7)) < 1, CASE WHEN len(list_filter(f.kept, lambda x: n.date - x < 7)) < 1 THEN list_append(f.kept, n.date) ELSE f.kept END FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)
    SELECT symbol, date, allowed FROM f""",
)
def weekly_limit(spark, sf_dir):
    """Of a customer's order days those that count when one a week may."""
    days = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") < 1997).select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date")).distinct()
    return X.weekly_limited(days, 1)


@query("m9_watchlist", "WITH o AS (SELECT o_custkey AS symbol, o_totalprice AS score, CAST(o_orderdate AS DATE) AS date FROM orders), h AS (SELECT symbol, arg_max(score, row(date, score)) AS score, min(date) AS added, max(date) AS updated FROM o WHERE date < DATE '1998-01-01' GROUP BY symbol), a AS (SELECT * FROM h UNION ALL SELECT symbol, score, date, date FROM o WHERE date >= DATE '1998-01-01' AND score >= 50000) SELECT 'c' || symbol AS symbol, arg_max(score, row(updated, score)) AS score, min(added) AS added, max(updated) AS updated FROM a GROUP BY symbol")
def watchlist(spark, sf_dir):
    """A stored list of customers, and later orders that update it."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("symbol"), F.col("o_totalprice").alias("score"), F.to_date("o_orderdate").alias("date"))
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    none = spark.createDataFrame([], "symbol string, score double, added date, updated date")
    return X.watchlist(X.watchlist(none, o.filter(early)), o.filter(~early), 50000.0)


@query("m9_quality_gate", "WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey % 40 AS pool, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS score, CASE WHEN o_orderkey % 5 > 1 THEN o_totalprice END AS amount FROM orders), g AS (SELECT month, pool, count(score) AS n, avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0 END) AS m FROM o GROUP BY ALL) SELECT month, pool, n, round(m, 6) AS missing_share, CASE WHEN n = 0 THEN 'failed' WHEN n < 3 OR m > 0.4 THEN 'degraded' ELSE 'ok' END AS quality, concat_ws(',', CASE WHEN n = 0 THEN 'empty' WHEN n < 3 THEN 'few_candidates' END, CASE WHEN m > 0.4 THEN 'missing_amounts' END) AS reason FROM g")
def quality_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.trunc("o_orderdate", "month").alias("month"), (F.col("o_custkey") % 40).alias("pool"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("score"), F.when(F.col("o_orderkey") % 5 > 1, F.col("o_totalprice")).alias("amount"))
    return rounded(X.screening_gate(rows, ["month", "pool"]), 6, "missing_share")


@query("b14_universe", "WITH s AS (SELECT 0 AS source, c_custkey AS position, 's' || c_nationkey * 40 + c_custkey % 37 AS symbol FROM customer UNION ALL SELECT 1, s_suppkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 2, p_partkey, 's' || p_size * 7 FROM part), f AS (SELECT symbol, min(row(source, position)) AS x FROM s GROUP BY symbol) SELECT symbol, x[1] AS source, row_number() OVER (ORDER BY x, symbol) AS place FROM f QUALIFY place <= 300")
def universe(spark, sf_dir):
    """Three ordered lists as one, the first of equal symbols stays."""
    lists = [
        table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_nationkey") * 40 + F.col("c_custkey") % 37).alias("symbol"), F.col("c_custkey").alias("position")),
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.col("s_suppkey").alias("position")),
        table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_size") * 7).alias("symbol"), F.col("p_partkey").alias("position")),
    ]
    return X.universe(lists, 300)


@query("c13_enriched", "WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE ' ' END AS name FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 5 > 0) SELECT p_partkey AS k, coalesce(nullif(trim(a.name), ''), nullif(trim(b.name), '')) AS name FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey")
def enriched(spark, sf_dir):
    """Names of parts' numbers from the first of two lookups that knows one."""
    a = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).otherwise(" ").alias("name"))
    b = table(spark, sf_dir, "customer").filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return X.enriched(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k", [a, b], ["name"])


@query(
    "n5_market_report",
    f"""WITH {W}, {TREND}, t AS (SELECT symbol, date, {LABEL.format('round(score, 6)')} AS trend FROM it WHERE score IS NOT NULL), d AS (SELECT date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM w), r AS (SELECT date, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END) AS rising FROM d WHERE d IS NOT NULL GROUP BY date),
    o AS (SELECT a.date, a.trend AS first_trend, b.trend AS second_trend, up, down, round(CASE a.trend WHEN 'strong' THEN 1 WHEN 'weak' THEN 0 ELSE 0.5 END * 0.4 + CASE b.trend WHEN 'strong' THEN 1 WHEN 'weak' THEN 0 ELSE 0.5 END * 0.4 + rising * 0.2, 6)::DOUBLE AS score FROM t a JOIN t b ON a.date = b.date AND a.symbol = 'Brand#11' AND b.symbol = 'Brand#22' JOIN r ON r.date = a.date),
    c AS (SELECT symbol, date, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS c FROM w), n AS (SELECT x.date, round(greatest(-1, least(1, (x.c - y.c) / 3)), 4) AS impact FROM c x JOIN c y ON x.date = y.date AND x.symbol = 'Brand#11' AND y.symbol = 'Brand#22' WHERE x.c IS NOT NULL AND y.c IS NOT NULL)
    SELECT o.date, first_trend, second_trend, up, down, score, round(up / nullif(up + down, 0), 6) AS ratio, {LABEL.format('score')} AS trend, impact, {LABEL.format('round(score + coalesce(impact, 0) * 0.1, 6)')} AS outlook FROM o LEFT JOIN n ON n.date = o.date""",
)
def market_report(spark, sf_dir):
    """Each week after its close, with the outlook before the next one."""
    labelled = trends(spark, sf_dir).select("symbol", "date", trend_label(F.col("score"))["trend"].alias("trend"))
    return rounded(X.market_report(labelled, weekly_bars(spark, sf_dir), "Brand#11", "Brand#22", overnight_impact(spark, sf_dir)), 6, "ratio")
