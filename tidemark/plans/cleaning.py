"""Queries on calendars, sessions, units, names, labels and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.scalars import clamp, finite, sigmoid, squash
from ..operators import cleaning as C
from .panels import W, table, weekly_bars


@query(
    "b5_bar_dates",
    """WITH c AS (SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2018-12-01', DATE '2026-01-31', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6), e AS (SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events)
    SELECT event_id, CASE WHEN isodow(day) < 6 AND hour(ts) * 60 + minute(ts) < 900 THEN (SELECT max(d) FROM c WHERE d < day) ELSE (SELECT max(d) FROM c WHERE d <= day) END AS expected, (SELECT min(d) FROM c WHERE d > day) AS next_open FROM e""",
)
def bar_dates(spark, sf_dir):
    days = C.calendar(spark, "2018-12-01", "2026-01-31")
    return C.bar_dates(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", days).select("event_id", "expected", "next_open")


@query("b7_keywords", "SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%small%' OR lower(p_type) LIKE '%tin%'")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(C.has_keyword(F.col("p_type"), "BRASS, small，Tin")).select("p_partkey")


@query("b10_volatility_share", "SELECT event_id, round(CASE WHEN value > 1.5 THEN value / 100 ELSE value END, 6) AS iv FROM events")
def volatility_share(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(C.volatility_share(F.col("value")), 6).alias("iv"))


@query(
    "b11_sane_change",
    f"""WITH {W}, x AS (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM w), c AS (SELECT *, (close - before) / before * 100 AS real FROM x),
    r AS (SELECT *, CASE day(date) % 5 WHEN 0 THEN real WHEN 1 THEN real / 100 WHEN 2 THEN close - before WHEN 3 THEN NULL ELSE real + 4 END AS raw FROM c)
    SELECT symbol, date, round(CASE WHEN before IS NULL THEN raw WHEN raw IS NULL THEN real WHEN abs(raw - real) <= 0.1 THEN raw
      WHEN abs(raw) <= 1 AND abs(real) >= 0.8 AND (abs(raw * 100 - real) <= greatest(0.15, 0.05 * abs(real)) OR abs(raw * 100 - real) < abs(raw - real)) THEN raw * 100
      WHEN abs(real) <= 18 AND abs(raw) > greatest(5.5, 2.5 * greatest(abs(real), 0.35)) THEN real WHEN abs(real) <= 22.5 AND abs(raw - real) > greatest(2.0, 0.4 * abs(raw)) THEN real ELSE raw END, 6) AS change FROM r""",
)
def sane_change(spark, sf_dir):
    from ..functions.windows import series

    bars = weekly_bars(spark, sf_dir).select("symbol", "date", "close", F.lag("close").over(series("symbol")).alias("before"))
    real = (F.col("close") - F.col("before")) / F.col("before") * 100
    k = F.day("date") % 5
    raw = F.when(k == 0, real).when(k == 1, real / 100).when(k == 2, F.col("close") - F.col("before")).when(k == 4, real + 4)
    return bars.select("symbol", "date", F.round(C.sane_change(raw, F.col("close"), F.col("before")), 6).alias("change"))


@query(
    "b13_resolve",
    """WITH a AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, 3) ELSE CAST(n_nationkey AS VARCHAR) END AS ask FROM part JOIN nation ON n_nationkey = p_partkey % 25),
    f AS (SELECT ask, CAST(n_nationkey AS VARCHAR) AS code, CASE WHEN ask = CAST(n_nationkey AS VARCHAR) THEN 0 WHEN ask = n_name THEN 1 WHEN length(ask) >= 2 AND contains(n_name, ask) THEN 2 END AS level FROM a, nation),
    g AS (SELECT ask, level, count(DISTINCT code) AS n, min(code) AS code FROM f WHERE level IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ask ORDER BY level) = 1)
    SELECT a.ask, CASE WHEN n = 1 THEN code END AS code, coalesce(n, 0) AS n FROM a LEFT JOIN b USING (ask)""",
)
def resolve(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), "n_nationkey")
    rows = table(spark, sf_dir, "part").join(F.broadcast(nation), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    k = F.col("p_partkey") % 3
    return C.resolve(rows.select(F.when(k == 0, F.col("name")).when(k == 1, F.substring("name", 1, 3)).otherwise(F.col("code")).alias("ask")), nation)


@query(
    "h10_minutes_left",
    "SELECT event_id, CASE WHEN m < 570 THEN 240 WHEN m <= 690 THEN 690 - m + 120 WHEN m < 780 THEN 120 WHEN m <= 900 THEN 900 - m ELSE 0 END AS minutes FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events)",
)
def minutes_left(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.minutes_left(F.col("ts")).alias("minutes"))


@query(
    "i10_session_phase",
    "SELECT event_id, CASE WHEN isodow(ts) > 5 THEN 'closed' WHEN m < 555 THEN 'before_open' WHEN m < 570 THEN 'auction' WHEN m <= 690 THEN 'morning' WHEN m < 780 THEN 'lunch' WHEN m <= 900 THEN 'afternoon' ELSE 'after_close' END AS phase FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)",
)
def session_phase(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.session_phase(F.col("ts")).alias("phase"))


@query(
    "h1_squash",
    "SELECT o_orderkey, round(1 / (1 + exp(-s)), 6) AS sigmoid, round((exp(2 * s / 1.5) - 1) / (exp(2 * s / 1.5) + 1), 6) AS tanh, round(greatest(-1, least(1, s)), 6) AS clamped FROM (SELECT o_orderkey, (o_totalprice - 150000) / 50000 AS s FROM orders)",
)
def squashed(spark, sf_dir):
    s = (F.col("o_totalprice") - 150000) / 50000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(sigmoid(s), 6).alias("sigmoid"), F.round(squash(s, 1.5), 6).alias("tanh"), F.round(clamp(s, -1.0, 1.0), 6).alias("clamped"))


@query(
    "h2_probability",
    """WITH x AS (SELECT o_orderkey, (o_totalprice - 150000) / 300000 AS s, o_orderkey % 6 = 0 AS bad FROM orders)
    SELECT o_orderkey, round(greatest(35, least(80, 50 + s * 100)), 6) AS probability, CASE WHEN bad THEN 'low' WHEN abs(s) >= 0.35 THEN 'high' WHEN abs(s) >= 0.15 THEN 'medium' ELSE 'low' END AS band FROM x""",
)
def probability(spark, sf_dir):
    s = (F.col("o_totalprice") - 150000) / 300000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(C.probability(s), 6).alias("probability"), C.confidence_band(s, F.col("o_orderkey") % 6 == 0).alias("band"))


@query(
    "h4_robust_score",
    f"""WITH {W}, x AS (SELECT symbol, date, close, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS v FROM w), y AS (SELECT symbol, date, close, list_sort(coalesce(v, [])) AS s, len(coalesce(v, [])) AS n FROM x),
    z AS (SELECT *, CASE WHEN n % 2 = 1 THEN s[n // 2 + 1] ELSE (s[n // 2] + s[n // 2 + 1]) / 2 END AS med, s[CAST(floor(0.75 * (n - 1)) AS INT) + 1] - s[CAST(floor(0.25 * (n - 1)) AS INT) + 1] AS iqr FROM y)
    SELECT symbol, date, round(CASE WHEN n < 8 THEN NULL WHEN iqr <= 1e-9 THEN greatest(-1, least(1, (len(list_filter(s, lambda q: q <= close)) / n * 100 - 50) / 50))
      ELSE 0.85 * (exp(2 * greatest(-300, least(300, (close - med) / iqr))) - 1) / (exp(2 * greatest(-300, least(300, (close - med) / iqr))) + 1) END, 6) AS score FROM z""",
)
def robust_score(spark, sf_dir):
    from ..functions.windows import series

    bars = weekly_bars(spark, sf_dir)
    rows = bars.select("symbol", "date", "close", F.collect_list("close").over(series("symbol").rowsBetween(-60, -1)).alias("v"))
    return rows.select("symbol", "date", F.round(C.robust_score(F.col("v"), F.col("close")), 6).alias("score"))


@query(
    "h8_rounding",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CAST(l_quantity AS DECIMAL(18, 4)) / 4, 0)::DOUBLE AS half_up, round_even(l_quantity / 4, 0) AS half_even FROM lineitem",
)
def rounding(spark, sf_dir):
    x = F.col("l_quantity") / 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(x, 0).alias("half_up"), F.bround(x, 0).alias("half_even"))


@query(
    "h9_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS later, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month FROM orders""",
)
def dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(d, "yyyyMMdd").alias("compact"), F.weekday(d).alias("weekday"), F.date_diff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.date_add(d, 30).alias("later"), F.date_format(d, "yyyy-MM").alias("month")
    )


@query(
    "h11_parsed_time",
    """WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate AS d FROM orders)
    SELECT o_orderkey, CASE k WHEN 4 THEN NULL WHEN 0 THEN strftime(d, '%Y-%m-%d %H:%M:%S') ELSE strftime(d, '%Y-%m-%d 00:00:00') END AS parsed FROM x""",
)
def parsed_time(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, F.date_format(d, "yyyyMMdd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(C.parsed_time(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("h13_nested_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "h14_merged_map",
    "SELECT o_orderkey, 0.5 AS s1, CASE WHEN o_orderkey % 3 = 0 THEN 0.8 ELSE 0.5 END AS s2, CASE WHEN o_orderkey % 2 = 0 THEN 0.1 END AS s3 FROM orders",
)
def merged_map(spark, sf_dir):
    base = F.create_map(F.lit("s1"), F.lit(0.5), F.lit("s2"), F.lit(0.5))
    key = F.col("o_orderkey")
    over = F.create_map(F.lit("s2"), F.when(key % 3 == 0, 0.8), F.lit("s3"), F.when(key % 2 == 0, 0.1))
    m = C.merged_map(base, over)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("s1", "s2", "s3")])


@query("h15_input_hash", "SELECT o_orderkey, substr(sha256(o_orderkey || '|' || o_orderpriority || '|' || coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END, '')), 1, 16) AS inputs_hash FROM orders")
def input_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.input_hash(F.col("o_orderkey"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus"))).alias("inputs_hash"))


@query(
    "h16_status_labels",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['slow source'] WHEN 2 THEN ['slow source', ' Runtime_Failed: timeout'] ELSE ['snapshot_missing'] END AS r FROM orders)
    SELECT o_orderkey, CASE WHEN len(r) = 0 THEN 'info' WHEN len(list_filter(r, lambda q: regexp_matches(lower(q), 'runtime_failed|snapshot_missing'))) > 0 THEN 'failed' ELSE 'degraded' END AS status, printf('%d reasons: %s', len(r), array_to_string(r, '; ')) AS narrative FROM x""",
)
def status_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    texts = lambda *x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
    r = F.when(k == 0, texts()).when(k == 1, texts("slow source")).when(k == 2, texts("slow source", " Runtime_Failed: timeout")).otherwise(texts("snapshot_missing"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.quality_status(r).alias("status"), F.format_string("%d reasons: %s", F.size(r), F.array_join(r, "; ")).alias("narrative"))


@query("b15_finite", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE value END AS value FROM events")
def finite_values(spark, sf_dir):
    k = F.col("event_id") % 4
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", finite(x).alias("value"))
