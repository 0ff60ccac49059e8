"""Queries on technical indicators, over weekly bars."""

from __future__ import annotations

from ..catalog import query
from ..operators import indicators as I  # noqa: E741
from .panels import W, rounded, weekly_bars

OVER = "OVER (PARTITION BY symbol ORDER BY date)"


def rolling(stat: str, n: int, of: str, skip: int = 0) -> str:
    """SQL of a statistic over n full rows."""
    frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"
    return f"CASE WHEN count({of}) {frame} = {n} THEN {stat.format(of)} {frame} END"


def crossing(fast: str, slow: str) -> str:
    was = f"lag({fast}) {OVER} {{}} lag({slow}) {OVER}"
    return f"CASE WHEN {was.format('<=')} AND {fast} > {slow} THEN 'golden' WHEN {was.format('>=')} AND {fast} < {slow} THEN 'death' ELSE 'none' END"


def averaged(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """SQL of recursive averages in closed form: weights alpha * (1 - alpha)^age, and (1 - alpha)^age for the first value."""
    sums = ", ".join(f"sum(y.{c} * pow(1 - {a!r}, x.i - y.i) * CASE WHEN y.i = f.i_{k} THEN 1 ELSE {a!r} END) FILTER (y.i >= f.i_{k}) AS {k}" for k, (c, a) in columns.items())
    firsts = ", ".join(f"min(i) FILTER ({c} IS NOT NULL) AS i_{k}" for k, (c, _) in columns.items())
    return f"""{name}_i AS (SELECT *, row_number() {OVER} AS i FROM {source}), {name}_f AS (SELECT symbol, {firsts} FROM {name}_i GROUP BY symbol),
    {name}_s AS (SELECT x.symbol, x.i, {sums} FROM {name}_i x JOIN {name}_i y ON x.symbol = y.symbol AND y.i <= x.i JOIN {name}_f f ON f.symbol = x.symbol GROUP BY x.symbol, x.i),
    {name} AS (SELECT x.*, s.* EXCLUDE (symbol, i) FROM {name}_i x JOIN {name}_s s USING (symbol, i))"""


MOVES = f"m AS (SELECT *, close - lag(close) {OVER} AS move FROM w), g AS (SELECT *, CASE WHEN move IS NOT NULL THEN greatest(move, 0) END AS gain, CASE WHEN move IS NOT NULL THEN greatest(-move, 0) END AS loss FROM m)"
TR = f"t AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) {OVER}), 0), coalesce(abs(low - lag(close) {OVER}), 0)) AS tr FROM w)"


@query(
    "j01_moving_averages",
    f"""WITH {W}, a AS (SELECT symbol, date, {rolling('avg({})', 5, 'close')} AS ma5, {rolling('avg({})', 10, 'close')} AS ma10, {rolling('avg({})', 20, 'close')} AS ma20, {rolling('avg({})', 5, 'volume')} AS volume_ma FROM w)
    SELECT symbol, date, round(ma5, 6) AS ma5, round(ma10, 6) AS ma10, round(ma20, 6) AS ma20, round(volume_ma, 4) AS volume_ma,
    CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN 'bull' WHEN ma5 < ma10 AND ma10 < ma20 THEN 'bear' WHEN ma20 IS NOT NULL THEN 'mixed' END AS arrangement, {crossing('ma5', 'ma10')} AS "cross" FROM a""",
)
def moving_averages(spark, sf_dir):
    out = I.moving_averages(weekly_bars(spark, sf_dir), [5, 10, 20]).drop("close", "volume")
    return rounded(rounded(out, 6, "ma5", "ma10", "ma20"), 4, "volume_ma")


_MACD = f"""WITH {W}, {averaged('e', 'w', {'ef': ('close', 2 / 13), 'es': ('close', 2 / 27)})}, dd AS (SELECT symbol, date, ef - es AS dif FROM e), {averaged('s', 'dd', {'dea': ('dif', 0.2)})}
    SELECT symbol, date, round(dif, 6) AS dif, round(dea, 6) AS dea, round({{}} * (dif - dea), 6) AS hist, {crossing('dif', 'dea')} AS "cross" FROM s"""


@query("j03_macd", _MACD.format(1))
def macd(spark, sf_dir):
    return rounded(I.macd(weekly_bars(spark, sf_dir)), 6, "dif", "dea", "hist")


@query("j03_macd_legacy", _MACD.format(2))
def macd_legacy(spark, sf_dir):
    return rounded(I.macd(weekly_bars(spark, sf_dir), factor=2.0), 6, "dif", "dea", "hist")


@query(
    "j04_rsi_simple",
    f"""WITH {W}, {MOVES}, a AS (SELECT symbol, date, {rolling('avg({})', 14, 'gain')} AS up, {rolling('avg({})', 14, 'loss')} AS down FROM g)
    SELECT symbol, date, round(CASE WHEN up IS NULL THEN NULL WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi FROM a""",
)
def rsi_simple(spark, sf_dir):
    return rounded(I.rsi_simple(weekly_bars(spark, sf_dir)), 6, "rsi")


@query(
    "j04_rsi_wilder",
    f"""WITH {W}, {MOVES}, {averaged('e', 'g', {'up': ('gain', 1 / 14), 'down': ('loss', 1 / 14)})}
    SELECT symbol, date, round(CASE WHEN i > 14 THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END, 6) AS rsi FROM e""",
)
def rsi_wilder(spark, sf_dir):
    return rounded(I.rsi_wilder(weekly_bars(spark, sf_dir)), 6, "rsi")


def _bollinger_sql(deviation: str) -> str:
    return f"""WITH {W}, a AS (SELECT symbol, date, close, {rolling('avg({})', 20, 'close')} AS middle, {rolling(deviation + '({})', 20, 'close')} AS dv FROM w)
    SELECT symbol, date, round(middle, 6) AS middle, round(middle + 2 * dv, 6) AS upper, round(middle - 2 * dv, 6) AS lower, round(4 * dv / middle * 100, 6) AS bandwidth,
    round(CASE WHEN middle IS NOT NULL THEN CASE WHEN dv = 0 THEN 0.5 ELSE (close - middle + 2 * dv) / (4 * dv) END END, 6) AS percent_b FROM a"""


@query("j05_bollinger", _bollinger_sql("stddev_pop"))
def bollinger(spark, sf_dir):
    return rounded(I.bollinger(weekly_bars(spark, sf_dir)), 6, "middle", "upper", "lower", "bandwidth", "percent_b")


@query("j05_bollinger_sample", _bollinger_sql("stddev_samp"))
def bollinger_sample(spark, sf_dir):
    return rounded(I.bollinger(weekly_bars(spark, sf_dir), sample=True), 6, "middle", "upper", "lower", "bandwidth", "percent_b")


@query("j06_atr", f"WITH {W}, {TR}, a AS (SELECT *, {rolling('avg({})', 14, 'tr')} AS atr FROM t) SELECT symbol, date, round(atr, 6) AS atr, round(atr / close * 100, 6) AS natr FROM a")
def atr(spark, sf_dir):
    return rounded(I.atr(weekly_bars(spark, sf_dir)), 6, "atr", "natr")


@query(
    "j07_kdj",
    f"""WITH {W}, a AS (SELECT symbol, date, close, {rolling('min({})', 9, 'low')} AS lo, {rolling('max({})', 9, 'high')} AS hi FROM w),
    r AS (SELECT symbol, date, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 WHEN hi IS NOT NULL THEN 50 END AS rsv FROM a), {averaged('e', 'r', {'k': ('rsv', 1 / 3)})}, kk AS (SELECT symbol, date, k FROM e), {averaged('f', 'kk', {'d': ('k', 1 / 3)})}
    SELECT symbol, date, round(k, 6) AS k, round(d, 6) AS d, round(3 * k - 2 * d, 6) AS j FROM f""",
)
def kdj(spark, sf_dir):
    return rounded(I.kdj(weekly_bars(spark, sf_dir)), 6, "k", "d", "j")


@query(
    "j08_cci",
    f"""WITH {W}, p AS (SELECT symbol, date, row_number() {OVER} AS i, (high + low + close) / 3 AS tp FROM w),
    a AS (SELECT x.symbol, x.date, x.tp, x.i, avg(y.tp) AS mean FROM p x JOIN p y ON x.symbol = y.symbol AND y.i BETWEEN x.i - 19 AND x.i GROUP BY ALL),
    m AS (SELECT a.symbol, a.date, a.tp, a.i, a.mean, sum(abs(y.tp - a.mean)) / 20 AS md FROM a JOIN p y ON a.symbol = y.symbol AND y.i BETWEEN a.i - 19 AND a.i GROUP BY ALL)
    SELECT symbol, date, round(CASE WHEN i >= 20 AND md > 0 THEN (tp - mean) / (0.015 * md) END, 6) AS cci FROM m""",
)
def cci(spark, sf_dir):
    return rounded(I.cci(weekly_bars(spark, sf_dir)), 6, "cci")


@query(
    "j09_adx",
    f"""WITH {W}, {TR}, u AS (SELECT symbol, date, tr, high - lag(high) {OVER} AS up, lag(low) {OVER} - low AS dn FROM t),
    v AS (SELECT symbol, date, CASE WHEN up IS NOT NULL THEN tr END AS tr, CASE WHEN up IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN up IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM u),
    {averaged('e', 'v', {'a': ('tr', 1 / 14), 'p': ('pdm', 1 / 14), 'm': ('mdm', 1 / 14)})},
    d AS (SELECT symbol, date, CASE WHEN a > 0 THEN 100 * p / a END AS plus_di, CASE WHEN a > 0 THEN 100 * m / a END AS minus_di FROM e),
    x AS (SELECT *, CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) WHEN plus_di + minus_di = 0 THEN 0 END AS dx FROM d), {averaged('f', 'x', {'adx': ('dx', 1 / 14)})}
    SELECT symbol, date, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di, round(adx, 6) AS adx, CASE WHEN adx > 25 THEN 'strong' WHEN adx < 20 THEN 'weak' WHEN adx IS NOT NULL THEN 'medium' END AS strength FROM f""",
)
def adx(spark, sf_dir):
    return rounded(I.adx(weekly_bars(spark, sf_dir)), 6, "plus_di", "minus_di", "adx")


@query("j12_key_levels")
def key_levels(spark, sf_dir):
    return I.key_levels(weekly_bars(spark, sf_dir))


@query("j13_divergence")
def divergence(spark, sf_dir):
    return I.divergence(weekly_bars(spark, sf_dir))


@query(
    "j10_indicator_table",
    f"""WITH {W}, {MOVES}, {TR}, a AS (SELECT symbol, date, close, {rolling('avg({})', 5, 'close')} AS ma5, {rolling('avg({})', 20, 'close')} AS ma20, {rolling('stddev_pop({})', 20, 'close')} AS dv FROM w),
    {averaged('e', 'w', {'ef': ('close', 2 / 13), 'es': ('close', 2 / 27)})}, dd AS (SELECT symbol, date, ef - es AS dif FROM e), {averaged('s', 'dd', {'dea': ('dif', 0.2)})}, {averaged('r', 'g', {'up': ('gain', 1 / 14), 'down': ('loss', 1 / 14)})},
    tt AS (SELECT symbol, date, {rolling('avg({})', 14, 'tr')} AS atr FROM t)
    SELECT a.symbol, a.date, round(ma5, 6) AS ma5, round(ma20, 6) AS ma20, round(ma20 + 2 * dv, 6) AS upper20, round(s.dif, 6) AS dif, round(s.dea, 6) AS dea, round(CASE WHEN r.i > 14 THEN CASE WHEN r.down = 0 THEN 100 ELSE 100 - 100 / (1 + r.up / r.down) END END, 6) AS rsi14, round(tt.atr, 6) AS atr14
    FROM a JOIN s USING (symbol, date) JOIN r USING (symbol, date) JOIN tt USING (symbol, date)""",
)
def indicator_table(spark, sf_dir):
    """Any set of indicators by one SQL call."""
    from ..functions import indicator_table as T

    T.register(spark)
    weekly_bars(spark, sf_dir).select("symbol", "date", "high", "low", "close").createOrReplaceTempView("weekly_bars_of_brands")
    out = spark.sql("SELECT * FROM indicators(TABLE(weekly_bars_of_brands) PARTITION BY symbol ORDER BY (date), 'MA5,MA20,BOLL20,MACD,RSI14,ATR14')")
    return rounded(out.select("symbol", "date", "ma5", "ma20", "upper20", "dif", "dea", "rsi14", "atr14"), 6, "ma5", "ma20", "upper20", "dif", "dea", "rsi14", "atr14")
