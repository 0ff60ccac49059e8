"""Greeks, option signals and ranges on cases worked out by hand; stores and uploads."""

import datetime as dt
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import options as O  # noqa: E741
from tidemark.sources import market as M
from tidemark.sources import uploads as U


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_greeks_become_wide(spark):
    rows = [("c", 1, "Delta", "0.5"), ("c", 1, "Gamma", "x"), ("c", 1, "IV", "20"), ("c", 1, "IV", "21"), ("c", 2, "Delta", "NaN"), ("c", 2, "other", "7"), ("d", 1, "IV", None)]
    got = O.greeks_wide(spark.createDataFrame(rows, "contract string, ts long, field string, value string"), ["contract", "ts"], {"delta": "Delta", "gamma": "Gamma", "iv": "IV"})
    assert sorted(tuple(r) for r in got.collect()) == [("c", 1, 0.5, None, 21.0), ("c", 2, None, None, None), ("d", 1, None, None, None)]


def test_greeks_change_by_hand(spark):
    rows = [("five", k, d, g, v) for k, (d, g, v) in enumerate([(0.3, 1.0, 20.0), (0.4, 1.0, 20.0), (0.2, 1.0, 25.0), (None, None, None), (0.5, 3.0, 20.0)])]
    rows += [("two", 1, 0.1, 0.0, 0.0), ("two", 2, 0.2, 0.0, 10.0), ("one", 1, 0.1, 0.2, 0.3), ("bare", 1, None, None, None), ("bare", 2, None, None, None)]
    got = {r.c: r for r in O.greeks_change(spark.createDataFrame(rows, "c string, ts long, delta double, gamma double, iv double"), ["c"]).collect()}
    five = got["five"]
    assert five.n == 5 and five.quality == "good" and math.isclose(five.delta_change, 0.3) and math.isclose(five.gamma_peak, 2.0) and math.isclose(five.iv_change, -20.0)
    assert (got["two"].quality, got["two"].gamma_peak, got["two"].iv_change) == ("low", 1.0, 0.0) and math.isclose(got["two"].delta_change, 0.1)
    assert tuple(got["one"])[1:] == (1, 0.0, 1.0, 0.0, "insufficient")
    assert tuple(got["bare"])[1:] == (2, 0.0, 1.0, 0.0, "low")


@pytest.mark.parametrize(
    ("delta", "gamma", "iv", "quality", "want"),
    [(0.25, 1.0, 0.0, "good", 0.05), (-0.5, 1.75, 10.0, "good", 0.1 + 0.075 + 0.025), (0.9, 3.0, 40.0, "good", 0.2), (0.9, 3.0, 40.0, "low", 0.2), (0.25, 1.5, -5.0, "low", 0.8 * (0.05 + 0.05 + 0.0125)), (0.25, 1.0, 0.0, "insufficient", 0.03), (0.09, 1.4, 4.9, "good", 0.0)],
)
def test_greeks_score_by_hand(spark, delta, gamma, iv, quality, want):
    got = one(spark, x=O.greeks_score(F.lit(delta), F.lit(gamma), F.lit(iv), F.lit(quality))).x
    assert math.isclose(got, want, abs_tol=1e-12)


def test_boundaries_and_turns_by_hand(spark):
    near = O.boundary_rebound(F.lit(10.1), F.lit(10.0), F.lit(11.0))
    assert one(spark, kind=near["kind"], s=near["strength"]).kind == "call" and math.isclose(one(spark, s=near["strength"]).s, 0.6, rel_tol=1e-9)
    high = O.boundary_rebound(F.lit(12.0), F.lit(10.0), F.lit(11.0))
    assert tuple(one(spark, kind=high["kind"], s=high["strength"])) == ("put", 1.0)
    for price, low, up in ((10.5, 10.0, 11.0), (10.0, 11.0, 11.0)):
        x = O.boundary_rebound(F.lit(price), F.lit(low), F.lit(up))
        assert tuple(one(spark, kind=x["kind"], s=x["strength"])) == (None, None)
    for hist, was, kind, strength in ((2.0, -3.0, "bullish", 0.5), (-2.0, 30.0, "bearish", 1.0), (-6.0, -8.0, "bullish", 0.25), (6.0, 8.0, "bearish", 0.25), (-7.0, -8.0, None, None), (9.0, 8.0, None, None), (0.0, 5.0, None, None)):
        x = O.macd_turn(F.lit(hist), F.lit(was))
        assert tuple(one(spark, kind=x["kind"], s=x["strength"])) == (kind, strength)


def test_window_divergence_by_hand(spark):
    def rows(name, closes, rsi):
        return [(name, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(c), None if r is None else float(r)) for k, (c, r) in enumerate(zip(closes, rsi, strict=True))]

    flat = [50.0] * 15
    bull = rows("bull", [10, 9, 8, 9, 10, 11, 12, 11, 10, 9, 7, 8, 9, 10, 11], [*flat[:2], 30, *flat[3:10], 42, *flat[11:]])
    bear = rows("bear", [10, 11, 12, 11, 10, 9, 8, 9, 10, 11, 13, 12, 11, 10, 7.5], [*flat[:2], 80, *flat[3:10], 60, *flat[11:]])
    short = rows("short", range(14), flat[:14])
    none = rows("none", range(15, 0, -1), flat)
    unknown = rows("unknown", [10, 9, 8, 9, 10, 11, 12, 11, 10, 9, 7, 8, 9, 10, 11], [None] * 15)
    long = rows("long", [1.0, *[x[2] for x in bull]], [99.0, *[x[3] for x in bull]])
    got = {r.symbol: (r.kind, r.strength) for r in O.window_divergence(spark.createDataFrame(bull + bear + short + none + unknown + long, "symbol string, date date, close double, rsi double")).collect()}
    assert got == {"bull": ("bullish", 0.6), "bear": ("bearish", 1.0), "none": (None, None), "unknown": (None, None), "long": ("bullish", 0.6)}


def test_option_signals_by_hand(spark):
    part = "struct<kind string, strength double>"
    rows = [
        ("a", None, ("call", 1.0), ("bearish", 0.5), ("bullish", 0.2), "bullish", 0.08),  # .4 + .075 + .03 whatever their direction: call and put
        ("b", None, ("put", 0.8), None, None, "bearish", 0.1),  # .32 + .1 = .42: only with a bearish side
        ("c", None, None, None, None, "bullish", 0.1),
        ("d", None, ("call", 1.0), ("bullish", 1.0), ("bullish", 1.0), None, None),
    ]
    turns = spark.createDataFrame(rows, f"symbol string, date date, boundary {part}, divergence {part}, macd {part}, direction string, trend double")
    greeks = spark.createDataFrame([("a", "call", 0.2), ("d", "call", 0.1)], "symbol string, kind string, score double")
    got = {(r.symbol, r.kind): r for r in O.option_signals(turns, greeks, spark.createDataFrame([("b", "bearish"), ("a", "neutral")], "symbol string, side string")).collect()}
    assert set(got) == {("a", "call"), ("a", "put"), ("b", "put"), ("d", "call")}
    assert math.isclose(got["a", "call"].strength, 0.505 + 0.2 + 0.08) and got["a", "call"].level == "strong"
    assert math.isclose(got["a", "put"].strength, 0.505) and got["a", "put"].level == "weak"
    assert math.isclose(got["b", "put"].strength, 0.42) and math.isclose(got["d", "call"].strength, 0.8)
    bullish = spark.createDataFrame([("b", "bullish")], "symbol string, side string")
    assert {r.symbol for r in O.option_signals(turns, greeks, bullish).filter("kind = 'put'").collect()} == {"a"}


def priced(kind, price, spot, lower, upper, strike, delta, gamma, vega, iv, hv, minutes, trend):
    """The rule's steps one after the other."""
    if delta is None:
        if strike is None:
            delta = 0.2
        else:
            m = spot / strike
            delta = (0.1 if m < 0.95 else 0.2 if m < 0.98 else 0.3) if kind == "call" else (0.1 if m > 1.05 else 0.2 if m > 1.02 else 0.3)
        delta = delta if kind == "call" else -delta
    gamma, vega = 0.02 if gamma is None else gamma, 0.001 if vega is None else vega
    up, down, rng = (upper - spot) / spot, (spot - lower) / spot, (upper - lower) / spot
    a, b = (delta * up + 0.5 * gamma * up**2, -delta * down + 0.5 * gamma * down**2) if kind == "call" else (abs(delta) * down + 0.5 * gamma * down**2, abs(delta) * up + 0.5 * gamma * up**2)
    share, move = math.sqrt(minutes / 60000), None
    if iv is not None and iv > 0:
        iv = iv * 100 if iv < 5 else iv
        move = abs(delta) * iv / 100 * share if 5 <= iv <= 50 else None
    v = min(vega * min(rng * 100 / 2, 5) / 100, 0.2) if vega > 0 else 0.0
    lever = max(rng * 4, min(abs(delta) * rng * spot / price, rng * 10)) if price > 0 else 0
    a, b = abs(a), abs(b)
    if lever > 0:
        base = max(lever, move or 0)
        a, b = base + min(a, 0.15) + 1.5 * v, base + min(b, 0.15) + 1.5 * v
    elif move is not None:
        a, b = max(min(a, 0.3), min(move, 0.3)) + v, max(min(b, 0.3), min(move, 0.3)) + v
    else:
        a, b = min(a, 0.3) + v, min(b, 0.3) + v
    if hv and hv > 0 and a + b > 0:
        r = hv / 100 * share / ((a + b) / 2)
        f = 1.0 if r <= 0 else min(1.5, r) if r > 1.3 else max(0.7, r) if r < 0.7 else 1 + (r - 1) / 2
        a, b = a * f, b * f
    if trend in ("up", "down"):
        a, b = (a * 1.1, b * 0.9) if trend == "up" else (a * 0.9, b * 1.1)
    if abs(delta) < 0.3:
        a, b = a * (1 + (0.3 - abs(delta)) * 1.5), b * (1 + (0.3 - abs(delta)) * 1.5)
    most = 0.6 if abs(delta) < 0.3 else 0.5
    a, b = min(a, most), min(b, most)
    high, low = price * (1 + a), max(0.001, price * (1 - b))
    return (max(0.001, high * 0.95) if high <= low else low), high


def test_option_range_against_its_steps(spark):
    cases = [
        ("call", 0.05, 4.0, 3.95, 4.06, 4.1, 0.45, 0.8, 0.002, 18.0, 25.0, 120, None), ("put", 0.03, 4.0, 3.9, 4.1, 3.9, -0.2, 1.2, 0.003, 0.22, None, 200, "up"),
        ("call", 0.02, 4.0, 3.95, 4.05, 4.4, None, None, None, None, 300.0, 240, "down"), ("put", 0.02, 4.0, 3.95, 4.05, None, None, 0.5, 5.0, 80.0, 1.0, 10, None),
        ("call", 0.0, 4.0, 3.95, 4.05, 4.0, 0.5, 1.0, 0.1, 30.0, None, 100, "up"), ("put", 0.0, 4.0, 3.95, 4.05, 4.0, -0.5, 1.0, 0.1, None, None, 100, None),
        ("call", 0.0001, 4.0, 3.9, 4.2, 4.0, 0.1, 30.0, 9.0, 45.0, 500.0, 240, "up"), ("call", 1.0, 4.0, 3.999, 4.001, 3.0, 0.95, 0.1, 0.0, 10.0, 12.0, 0, None),
    ]
    kinds = "kind string, price double, spot double, lower double, upper double, strike double, delta double, gamma double, vega double, iv double, hv double, minutes int, trend string"
    got = O.option_range(spark.createDataFrame([(*c,) for c in cases], kinds)).collect()
    for r, case in zip(got, cases, strict=True):
        low, high = priced(*case)
        assert math.isclose(r.option_lower, low, rel_tol=1e-9) and math.isclose(r.option_upper, high, rel_tol=1e-9, abs_tol=1e-12), case


def test_underlying_range_prefers_the_fitted_one(spark):
    rows = [(100.0, 1.0, 20.0, 104.0, 97.0, 0.5, 60, None), (100.0, None, None, None, None, None, 240, None), (100.0, 1.0, 20.0, 104.0, 97.0, 0.5, 240, 0.02), (100.0, 1.0, 20.0, 104.0, 97.0, 0.5, 240, 0.5)]
    got = O.underlying_range(spark.createDataFrame(rows, "price double, atr double, hv double, band_upper double, band_lower double, intraday double, minutes int, sigma double")).collect()
    assert math.isclose(got[0].range_upper, 0.3 * 102 + 0.3 * 110 + 0.2 * 104 + 0.2 * 100.25) and math.isclose(got[0].range_lower, 0.3 * 98 + 0.3 * 90 + 0.2 * 97 + 0.2 * 99.75)
    assert math.isclose(got[1].range_upper, 0.3 * 102 + 0.3 * 101.5 + 0.2 * 102 + 0.2 * 101) and got[1].method == "blend"
    assert math.isclose(got[2].range_upper, 103.92) and got[2].method == "garch" and got[3].range_lower == 80.0


# --- stores


def test_a_load_of_one_symbol_keeps_the_others(spark, tmp_path):
    day, path = dt.date(2024, 5, 6), str(tmp_path / "store")
    schema = "symbol string, date date, close double"
    put = lambda rows: M.write_days(spark.createDataFrame(rows, schema), path, "stock")
    put([("a", day, 1.0), ("a", day + dt.timedelta(days=1), 2.0), (None, day, 9.0)])
    put([("b", day, 3.0)])
    put([("a", day, 4.0), (None, day, 8.0), ("b", day, 3.5), ("b", day, 3.5)])
    put([])
    got = M.read_range(spark, path, "stock", "2024-05-01", "2024-05-31").collect()
    assert sorted((str(r.symbol), r.date.day, r.close) for r in got) == [("None", 6, 8.0), ("a", 6, 4.0), ("a", 7, 2.0), ("b", 6, 3.5)]
    M.write_days(spark.createDataFrame([("a", day, 7.0)], schema), path, "etf")
    assert M.read_range(spark, path, "stock", "2024-05-01", "2024-05-31").count() == 4


def test_null_keys_are_appended_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, ts timestamp, x int"
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at, 1), (None, at, 2), ("a", None, 3), (None, None, 4)]
    for at_ in (None, "ts", "ts"):
        M.append_unseen(spark.createDataFrame(rows, schema), path, ["k", "ts"], at_)
    M.append_unseen(spark.createDataFrame([("a", None, 5)], schema), path, ["k", "ts"], "ts")
    M.append_unseen(spark.createDataFrame([("b", at, 6)], schema), path, ["k", "ts"], "ts")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 6]


# --- uploads


def test_uploads_of_all_layouts(spark, tmp_path):
    row = {"最高": 2, "最低": 1, "收盘": 1.7, "成交量": "100"}
    files = {
        "a.json": json.dumps({"symbol": "000300", "period": "30", "data": [{"时间": "2024-01-02 09:30:00", "开盘": "1.5", **row}, {"时间": "2024-01-02 10:00", "开盘": "x", **row}, {"时间": "bad", "开盘": 1, **row}, {"时间": "20240102", "最高": 2}]}),
        "b.json": '[{"symbol":"x","date":"20240103","open":1,"high":2,"low":0.5,"close":1.5,"volume":3}, 7]',
        "c.csv": '﻿symbol,date,open,high,low,close,volume,note\r\n"a,b",2024-01-04,1,2,0.5,"1.25",9,"say ""hi"""\r\nz,2024-01-04,1,2\r\n\r\n',
        "d.json": "{broken", "e.json": '{"symbol":"q"}', "f.csv": "symbol,date", "g.json": '{"symbol":"q","data":[]}', "h.json": '{"symbol":"q","data":{"a":1}}',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    uploads = U.read_uploads(spark, str(tmp_path))
    bars, rejects = U.bars_and_rejects(uploads)
    assert sorted((r.file, r.layout, r.symbol, r.period, str(r.time), r.open, r.volume) for r in bars.collect()) == [
        ("a.json", "envelope", "000300", "30", "2024-01-02 09:30:00", 1.5, 100.0), ("b.json", "array", "x", None, "2024-01-03 00:00:00", 1.0, 3.0), ("c.csv", "csv", "a,b", None, "2024-01-04 00:00:00", 1.0, 9.0),
    ]
    assert {(r.file, r.pos): r.reason for r in rejects.collect()} == {
        ("a.json", 1): "no number open", ("a.json", 2): "no time", ("a.json", 3): "missing open low close volume", ("b.json", 1): "missing symbol time open high low close volume", ("c.csv", 1): "not read",
        ("d.json", None): "not read", ("e.json", None): "no rows", ("f.csv", None): "no rows", ("g.json", None): "no rows", ("h.json", None): "no rows",
    }
    schemas = {r.layout: r.schema for r in U.merged_schema(uploads).collect()}
    assert "note: STRING" in schemas["csv"] and "收盘" in schemas["envelope"]


def test_uploaded_greeks(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"timestamp": "20240105093000", "records": [{"contract_code": "'10010891'", "time": "20240105093001", "Delta": "0.1466", "隐含波动率": "20"}, {"Delta": "1"}, {"contract_code": "1", "Delta": "--"}]}))
    got = U.typed(U.read_uploads(spark, str(tmp_path)), U.GREEKS, ["contract", "time"]).orderBy("pos").collect()
    assert [(r.contract, str(r.time), r.delta, r.iv, r.reason) for r in got] == [("10010891", "2024-01-05 09:30:01", 0.1466, 20.0, None), (None, "2024-01-05 09:30:00", 1.0, None, "missing contract"), ("1", "2024-01-05 09:30:00", None, None, "no number delta")]


def test_a_filter_on_uploads_parses_nothing_twice(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,date,open,high,low,close,volume\na,2024-01-04,1,2,0.5,1.25,9\n")
    bars, _ = U.bars_and_rejects(U.read_uploads(spark, str(tmp_path)))
    plan = bars._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and bars.count() == 1  # of JSON files, and of CSV lines


def test_upload_rows_are_typed_in_compiled_code(spark):
    uploads = spark.range(1).select(*[F.col("id").cast("string").alias(c) for c in ("folder", "file", "layout")], F.lit(None).cast("map<string,string>").alias("envelope"), F.col("id").alias("pos"), F.parse_json(F.lit('{"date":"20240103"}')).alias("row"))
    for columns in (U.BARS, U.GREEKS):
        query = U.typed(uploads, columns, ["time"]).filter("reason IS NULL")._jdf.queryExecution()
        assert "lambda" not in query.optimizedPlan().toString()  # such steps are interpreted
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(query, "codegen"))]
        assert sizes and max(sizes) < 8000  # the JVM compiles no longer method
