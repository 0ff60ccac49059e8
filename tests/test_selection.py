"""Rotation, screening and snapshots on cases worked out by hand or in plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rotation as R
from tidemark.operators import selection as X
from tidemark.operators import snapshot as N

START = dt.date(2024, 1, 1)


def bars_of(spark, closes):
    rows = [(s, START + dt.timedelta(days=k), float(c), float(c * 1.01), float(c * 0.99), float(c), 1e7 + k) for s, x in closes.items() for k, c in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(0, 0.01, 300)
    walks = {s: 100 * np.exp(np.cumsum(0.001 * k + w * common + rng.normal(0, 0.01 * (1 - w), 300))) for k, (s, w) in enumerate([("a", 0.9), ("b", 0.9), ("c", 0.0), ("d", 0.0), ("e", 0.0)])}
    walks["new"] = walks["c"][:40][::-1].copy()
    late = {s: x for s, x in walks.items() if s != "new"}
    pools = spark.createDataFrame([(s, "industry" if s in "abc" else "concept") for s in late], "symbol string, pool string")
    return bars_of(spark, late), pools


def test_rotation_of_two_equal_rising_symbols(spark):
    """Two symbols that rise in a straight line: both are ranked, or one of them is dropped as the other's double."""
    line = np.linspace(10, 12, 300)
    bars, pools = bars_of(spark, {"A": line, "B": line}), spark.createDataFrame([("A", "x"), ("B", "x")], "symbol string, pool string")
    both = {r.symbol: r for r in X.rotation(bars, pools, X.RotationRules(correlation="off", crowding_soft=None)).collect()}
    assert sorted(r.rank for r in both.values()) == [1, 2] and all(r.reason is None for r in both.values())
    one = {r.symbol: r for r in X.rotation(bars, pools, X.RotationRules(correlation="filter_greedy")).collect()}
    assert (one["A"].rank, one["B"].reason) == (1, "correlated")
    left = X.rotation_readiness(pools, X.rotation(bars, pools, X.RotationRules())).collect()
    assert [(r.pool, r.total, r.available, r.degraded) for r in left] == [("x", 2, 1, True)]


def test_rotation_against_its_parts(spark, market):
    bars, pools = market
    rules = X.RotationRules(ma="soft", ma_penalty=0.8, volatility="off", drawdown="hard", drawdown_least=-0.2, crowding_soft=0.8, correlation="filter_greedy", pair_most=0.5)
    got = {r.symbol: r for r in X.rotation(bars, pools, rules).collect()}
    metrics = {r.symbol: r.asDict() for r in R.base_metrics(bars).collect()}
    corr = {(r.a, r.b): r["corr"] for r in R.correlations(R.log_returns(bars)).collect()}
    pool = {r.symbol: r.pool for r in pools.collect()}
    for s, m in metrics.items():
        m["mean_corr"] = float(np.mean([abs(v) for (a, _), v in corr.items() if a == s]))
        m["penalty"] = (0.8 if not m["above_ma"] else 1.0) * (0.95 if m["crowding"] >= 0.8 else 1.0)
        m["reason"] = "drawdown" if m["mdd60"] < -0.2 else None
    from tidemark.operators.scoring import FACTORS

    score = {s: sum(m[k] * v for k, v in FACTORS.items() if k != "mean_corr") * m["penalty"] for s, m in metrics.items() if m["reason"] is None}
    kept = []
    for s in sorted(score, key=lambda s: (-score[s], s)):
        if all(abs(corr[s, t]) < 0.5 for t in kept):
            kept.append(s)
        else:
            metrics[s]["reason"] = "correlated"
    assert {s: r.reason for s, r in got.items()} == {s: m["reason"] for s, m in metrics.items()}
    assert any(r.reason == "correlated" for r in got.values()) and got["a"].pool == "industry"
    final = {}
    for p in set(pool.values()):
        inside = [s for s in kept if pool[s] == p]
        for s in inside:
            total = 0.0
            for k, w in R.WEIGHTS.items():
                order = sorted(inside, key=lambda t: (metrics[t][k] if k in R.ASCENDING else -metrics[t][k], t))
                total += w * (order.index(s) / (len(inside) - 1) if len(inside) > 1 else 1.0)
            final[s] = total * metrics[s]["penalty"]
    for place, s in enumerate(sorted(final, key=lambda s: (-round(final[s], 10), s)), 1):
        assert got[s].rank == place and math.isclose(got[s].score, final[s], rel_tol=1e-9)


def test_rotation_rules_are_checked():
    with pytest.raises(ValueError):
        X.RotationRules(ma="maybe")
    with pytest.raises(ValueError):
        X.RotationRules(correlation="pairs")


def test_pools_fall_back_and_merge(spark):
    rows = [("p", f"s{k}", k % 3, 1e8, 60.0 + k) for k in range(14)] + [("q", f"s{k}", k % 3, 1e8, 90.0 - k) for k in range(3)] + [("q", "big", 9, 5e9, 88.5)]
    df = spark.createDataFrame(rows, "paradigm string, symbol string, class long, amount double, score double")
    got = X.pooled(df, {"p": 80.0, "q": 85.0}, F.lit(1.0), F.lit(False)).collect()
    assert [(r.symbol, r.fallback) for r in sorted(got, key=lambda r: r.place) if r.paradigm == "p"] == [(f"s{k}", True) for k in range(13, 3, -1)]
    assert [(r.symbol, r.place, r.fallback) for r in sorted(got, key=lambda r: r.place) if r.paradigm == "q"] == [("s0", 1, False), ("s1", 2, False), ("big", 3, False), ("s2", 4, False)]
    relieved = X.pooled(df, {"p": 80.0, "q": 85.0}, F.lit(1.0), F.lit(True)).filter("paradigm = 'p'").collect()
    assert sorted(r.symbol for r in relieved) == ["s12", "s13"] and not any(r.fallback for r in relieved)
    merged = {r.symbol: r for r in X.merged_pools(X.pooled(df, {"p": 71.0, "q": 80.0}, F.lit(1.0), F.lit(False)), k=3, cap=1).collect()}
    assert merged["s0"].place == 2 and merged["big"].place == 1 and math.isclose(merged["big"].score, 90.5) and math.isclose(merged["s0"].score, 90.4)
    assert merged["s13"].place is None and merged["s13"].tags == ["first"] and merged["s0"].tags == ["top", "first"]


def test_weekly_limit_counts_what_was_allowed(spark):
    days = [1, 2, 3, 8, 9, 10, 30]
    df = spark.createDataFrame([("a", dt.date(2024, 1, d)) for d in days] + [("b", dt.date(2024, 1, 2))], "symbol string, date date")
    got = {(r.symbol, r.date.day): r.allowed for r in X.weekly_limited(df, 2).collect()}
    kept = []
    for d in days:
        ok = sum(d - x < 7 for x in kept) < 2
        kept += [d] if ok else []
        assert got["a", d] == ok
    assert got["b", 2] and not got["a", 3] and got["a", 8] and len(kept) == 5


def test_margin_change_adds_markets(spark):
    schema = "region string, date date, total double, financing double"
    day = [dt.date(2026, 4, 27), dt.date(2026, 4, 28)]
    rows = [("x", day[0], 100.0, 90.0), ("x", day[1], 105.0, 95.0), ("x", day[0], 200.0, 180.0), ("x", day[1], 210.0, 190.0), ("y", day[0], None, 7.0), ("y", day[1], None, 14.0), ("z", day[0], 5.0, None)]
    got = {r.region: tuple(r)[1:] for r in N.margin_change(spark.createDataFrame(rows, schema), ["region"]).collect()}
    assert got == {"x": (315.0, 0.05, 0.3, "info"), "y": (14.0, 1.0, 0.3, "info"), "z": (5.0, None, None, "degraded")}


def test_predictors_by_hand(spark):
    f = F.lit
    row = spark.range(1).select(
        N.leading_sector_score(f(0.02), f(0.04), f(-0.02), f(0.06), f(0.7)).alias("a"), N.industry_score(f(0.04), f(75.0), f(0.04)).alias("b"), N.science_score(f(2.0), f(0.13), f(-0.04), f(0.5)).alias("c"),
        N.small_cap_score(f(0.09), f(-0.03), f(0.2), f(0.3), f(-1.0), f(0.5)).alias("d"), N.event_gate(f("After the FOMC and US CPI, Tankan and China PMI")).get("risk").alias("e"), N.flow_score(f(2.5e9)).alias("f"), N.flow_score(f(-60.0)).alias("g"),
    ).first()
    assert math.isclose(row.a, (0.007 + 0.01 - 0.003) * 0.5 - 0.15 * 0.3 + 0.08 * 0.2) and math.isclose(row.b, 0.02 - 0.024 + 0.02)
    assert math.isclose(row.c, 0.4 - 0.03 - 0.02 + 0.02) and math.isclose(row.d, -0.35 * 0.45 - 0.08 * 0.2 + 0.01 + 0.005 - 0.004 + 0.1)
    assert row.e == 0.8 and row.f == 0.5 and row.g == -1.0


def test_liquidity_grades(spark):
    cases = [(0.4, 120, "excellent"), (0.4, 60, "good"), (3.9, 20, "fair"), (7.9, 9, "poor"), (7.9, 7, "critical"), (9.0, 500, "critical")]
    df = spark.createDataFrame([(s, d) for s, d, _ in cases], "s double, d int")
    made = N.liquidity_grade(F.col("s"), F.col("d"), F.lit(0.5), F.lit(True))
    out = df.select(made["grade"].alias("g"), made["score"].alias("x")).collect()
    assert [r.g for r in out] == [g for *_, g in cases] and all(r.x <= 50 for r in out)


def test_near_money_volatility(spark):
    day = dt.date(2024, 1, 1)
    at = lambda n: day + dt.timedelta(days=n)
    rows = [("u", day, 100.0, at(5), "call", 100.0, 9.0), ("u", day, 100.0, at(40), "call", 98.0, 20.0), ("u", day, 100.0, at(40), "call", 102.0, 30.0), ("u", day, 100.0, at(40), "put", 98.0, 24.0), ("u", day, 100.0, at(8), "put", 100.0, 1.0), ("v", day, 100.0, at(10), "call", 90.0, 15.0)]
    got = {r.underlying: r for r in N.near_money_volatility(spark.createDataFrame(rows, "underlying string, day date, spot double, expiry date, kind string, strike double, iv double")).collect()}
    assert got["u"].strike == 98.0 and got["u"].iv == 22.0 and math.isclose(got["u"].iv_30d, 22 * math.sqrt(40 / 30)) and (got["v"].iv, got["v"].iv_30d) == (15.0, None)


def test_pools_sort_the_best_rows_only(spark):
    """Scores with ties, nulls and a paradigm that nobody enters against plain sorting; what goes to one task are a few rows."""
    import random

    rng = random.Random(4)
    rows = [(p, k, k % 3, 1.0, rng.choice([None, float(rng.randrange(top or 1)), rng.random() * top])) for p, top in (("p", 95), ("q", 60), ("none", 0)) for k in range(3000) if top or k < 20]
    rows = [(p, k, c, a, None if p == "none" else s) for p, k, c, a, s in rows]
    df = spark.createDataFrame(rows, "paradigm string, symbol int, class int, amount double, score double").repartition(4)
    made = X.pooled(df, {"p": 80.0, "q": 85.0}, F.lit(1.0), F.lit(False))
    want = {(p, place): k for p in "pq" for place, (_, _, k) in enumerate(sorted((s is None, -round(s or 0.0, 10), k) for q, k, _, _, s in rows if q == p)[:10], 1)}
    assert {(r.paradigm, r.place): r.symbol for r in made.collect()} == want and {r.paradigm for r in made.filter("fallback").collect()} == {"q"}
    assert made._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("symbol", ["int", "string"])
def test_pools_sort_few_of_the_rows_that_tie(spark, symbol):
    """Nearly all rows of a paradigm have one score, or none; symbols of one beginning and a null among them."""
    one, none = [("p", k, 50.0) for k in range(3000)], [("none", k, None if k > 4 else 1.0) for k in range(3000)]
    rows = [*one, ("p", 2999, 60.0), *none, ("q", None, 7.0), *[("q", k, 7.0) for k in range(3000)]]
    df = spark.createDataFrame(rows, "paradigm string, id int, score double").select("paradigm", F.col("id").cast(symbol).alias("symbol"), F.lit(0).alias("class"), F.lit(1.0).alias("amount"), "score")
    sides = df.withColumns({"_side": F.lit(True), "_key": F.col("score")})
    assert X.contenders(sides, 10).count() < 1000
    name = (lambda k: k) if symbol == "int" else str
    first = lambda of: sorted((k is not None and (1, name(k)) or (0, 0), -s) for p, k, s in rows if p == of and s)
    want = {"p": [(1, name(2999)), *[k for k, s in first("p") if s == -50.0]][:10], "q": [k for k, _ in first("q")][:10]}
    got = sorted(X.pooled(df, {"p": 10.0, "q": 1.0}, F.lit(1.0), F.lit(False)).collect(), key=lambda r: r.place)
    assert {p: [(0, 0) if r.symbol is None else (1, r.symbol) for r in got if r.paradigm == p] for p in "pq"} == want
