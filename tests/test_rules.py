"""Operators against plain Python: fusion, interval fusion, options, levels, divergence, greedy filter, states, hand-made edge rows."""

import datetime
import math
import random

import pytest

from tidemark import catalog
from tidemark.operators import cleaning, evaluation, indicators, relate, rotation, scoring, trading, volatility

SF = "/root/testdata/sf0.001"


def fused(spark, rows, weights, **policy):
    made = trading.fuse(spark.createDataFrame(rows, "strategy string, symbol string, direction string, score double, confidence double"), weights, **policy)
    return {r.symbol: r for r in made.collect()}


def test_fusion_cases(spark):
    one = {"a": 1.0, "b": 1.0, "c": 1.0}
    out = fused(spark, [("a", "x", "long", 0.9, 1.0), ("b", "x", "short", -0.9, 1.0)], one, least=0.05, agreement=0.3, strong=0.5)["x"]
    assert (out.rule, out.direction, out.score) == ("conflict", "neutral", 0.0)
    out = fused(spark, [("a", "x", "long", 0.8, 1.0), ("b", "x", "short", -0.7, 1.0), ("c", "x", "neutral", 0.0, 0.5)], one, least=0.01, agreement=0.99, strong=0.99)["x"]
    assert (out.rule, out.direction) == ("low_agreement", "neutral")
    both = fused(spark, [("a", "x", "long", 0.6, 0.9), ("b", "x", "long", 0.5, 0.8), ("a", "y", "short", -0.55, 0.85), ("b", "y", "short", -0.5, 0.8)], one, least=0.1, agreement=0.4, strong=0.95)
    assert both["x"].direction == "long" and both["y"].direction == "short" and math.isclose(both["x"].score, (0.54 + 0.4) / 2)
    # neutral votes count as agreement; unknown strategies weigh .1; weights of 0 give 0
    out = fused(spark, [("q", "x", "neutral", 0.05, 1.0), ("r", "x", "neutral", 0.0, 1.0), ("s", "x", "long", 0.5, 1.0)], {})["x"]
    assert out.rule == "weak" and math.isclose(out.score, 0.55 / 3) and math.isclose(out.agreement, 2 / 3)
    assert fused(spark, [("a", "x", "long", 0.9, 1.0)], {"a": 0.0})["x"].score == 0.0


def weighted_quantile(values, weights, q):
    total, so_far = sum(weights), 0.0
    for v, w in sorted(zip(values, weights, strict=True)):
        so_far += w
        if so_far >= q * total:
            return v


def test_interval_fusion(spark):
    rng = random.Random(2)
    groups = {g: [(rng.uniform(90, 100), rng.uniform(98, 110), rng.choice([1.0, 2.0, 0.5])) for _ in range(n)] for g, n in (("one", 1), ("two", 2), ("ten", 10), ("crossed", 3))}
    groups["ten"].append((500.0, 600.0, 1.0))
    groups["crossed"] = [(100.0, 90.0, 1.0)] * 3
    df = spark.createDataFrame([(g, *x) for g, xs in groups.items() for x in xs], "g string, lower double, upper double, w double")
    got = {r.g: r for r in evaluation.outlier_fusion(df, ["g"], "w").collect()}
    for g, xs in groups.items():
        mids = [(a + b) / 2 for a, b, _ in xs]
        mean = sum(mids) / len(mids)
        dev = math.sqrt(sum((m - mean) ** 2 for m in mids) / max(1, len(mids) - 1))
        kept = xs if len(xs) < 3 or dev <= 1e-12 else [x for x, m in zip(xs, mids, strict=True) if abs(m - mean) <= 2 * dev]
        low, high = weighted_quantile([x[0] for x in kept], [x[2] for x in kept], 0.2), weighted_quantile([x[1] for x in kept], [x[2] for x in kept], 0.8)
        assert (got[g].kept, got[g].lower, got[g].upper) == (len(kept), min(low, high), max(low, high))
    assert got["ten"].kept == 10


def test_breakthrough_edges(spark):
    from pyspark.sql import functions as F

    rows = [(105.0, 100.0, 110.0, 0.8, 60), (105.0, 100.0, 100.0, 0.8, 60), (120.0, 100.0, 110.0, 2.0, 999), (105.0, 100.0, 110.0, 0.8, -5)]
    df = spark.createDataFrame(rows, "p double, l double, u double, c double, m int")
    got = [tuple(r) for r in df.select(*volatility.breakthrough(*[F.col(c) for c in "pluc"], F.col("m")).values()).collect()]
    assert got == [(0.2, 0.2, 0.5, 0.5), (0.0, 0.0, 0.0, 0.5), (0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.5)]


def test_options_match_closed_form(spark):
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    rows = [(100.0, k, t, 0.03, s, c) for k in (60.0, 100.0, 180.0) for t in (0.0, 0.1, 2.0) for s in (0.0, 0.05, 0.6) for c in (True, False)]
    got = volatility.black_scholes(spark.createDataFrame(rows, "spot double, strike double, years double, rate double, sigma double, is_call boolean")).collect()
    for r in got:
        if r.years * r.sigma == 0:
            assert r.price == max(0.0, r.spot - r.strike if r.is_call else r.strike - r.spot)
            continue
        root = r.sigma * math.sqrt(r.years)
        d1 = (math.log(r.spot / r.strike) + (r.rate + r.sigma**2 / 2) * r.years) / root
        paid = r.strike * math.exp(-r.rate * r.years)
        call = r.spot * cdf(d1) - paid * cdf(d1 - root)
        assert math.isclose(r.price, call if r.is_call else call - r.spot + paid, abs_tol=1e-9)
        assert math.isclose(r.delta, cdf(d1) - (0 if r.is_call else 1), abs_tol=1e-9)


def bars_of(spark, closes, symbol="s"):
    day = datetime.date(2024, 1, 1)
    rows = [(symbol, day + datetime.timedelta(k), float(c), float(c), float(c), float(c), 100.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_key_levels_pass_over_a_far_extreme(spark):
    r = indicators.key_levels(bars_of(spark, [4639.3721] * 59 + [4418.0]).unionByName(bars_of(spark, [4639.3721] * 30 + [4418.0] + [4639.3721] * 30, "t"))).filter("symbol = 't'").first()
    assert 4418.0 not in r.supports and 4600.0 in r.supports and r.resistances == [4700.0]


def test_divergence_by_loops(spark):
    rng = random.Random(5)
    closes = [100.0]
    for _ in range(300):
        closes.append(closes[-1] * math.exp(rng.gauss(0, 0.03)))
    got = [r.divergence for r in indicators.divergence(bars_of(spark, closes), 20, 5.0).orderBy("date").collect()]
    rsi = [r.rsi for r in indicators.rsi_simple(bars_of(spark, closes)).orderBy("date").collect()]
    for k, kind in enumerate(got):
        past = [(closes[i], rsi[i]) for i in range(max(0, k - 19), k)]
        want = "none"
        if len(past) == 19 and all(x[1] is not None for x in past):
            low, high = min(past), max(past)
            if closes[k] < low[0] and rsi[k] > low[1] + 5:
                want = "bullish"
            elif closes[k] > high[0] and rsi[k] < high[1] - 5:
                want = "bearish"
        assert kind == want, k
    assert len(set(got)) > 1


def test_greedy_filter_by_loops(spark):
    rng = random.Random(6)
    names = [f"n{k}" for k in range(40)]
    corr = {(a, b): rng.uniform(-1, 1) for i, a in enumerate(names) for b in names[:i]}
    pairs = spark.createDataFrame([(a, b, c) for (a, b), c in corr.items()] + [(b, a, c) for (a, b), c in corr.items()], "a string, b string, corr double")
    ranked = spark.createDataFrame([(k % 2, n, k) for k, n in enumerate(names)], "pool int, symbol string, rank int")
    got = [(r.pool, r.symbol) for r in rotation.greedy_filter(ranked, pairs, 0.7).orderBy("pool", "kept_rank").collect()]
    want = []
    for pool in (0, 1):
        kept = []
        for n in names[pool::2]:
            if all(abs(corr.get((n, k), corr.get((k, n)))) < 0.7 for k in kept):
                kept.append(n)
        want += [(pool, n) for n in kept]
    assert got == want


def test_states_by_plain_rules(spark):
    rows = [(1.0, 0.5, 0.5, 60.0, 30.0, 3.0, 105.0, 110.0, 100.0, 90.0), (-1.0, -0.5, -0.5, 40.0, 22.0, 150.0, 85.0, 110.0, 100.0, 90.0), (0.4, 0.5, -0.1, 75.0, 10.0, 0.0, 111.0, 110.0, 100.0, 90.0), (0.0, 0.0, 0.0, 47.0, 20.0, 1.0, 95.0, 110.0, 100.0, 90.0)]
    df = spark.createDataFrame(rows, "dif double, dea double, hist double, rsi double, adx double, natr double, close double, upper double, middle double, lower double")
    got = [(r.macd_state, r.rsi_state, r.strength, r.natr_score, r.band_state) for r in scoring.state_scores(df).collect()]
    assert got == [(1.0, 1.0, 1.0, 0.03, 1.0), (-1.0, -1.0, 0.6, 1.0, -1.0), (0.0, 0.0, 0.2, 0.0, 0.0), (0.0, 0.0, 0.6, 0.01, 0.0)]


@pytest.mark.parametrize("name", ["j11_states", "j12_key_levels", "j13_divergence", "k14_black_scholes"])
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_bounded_fill_and_divergence_edges(spark):
    made = relate.fill_gaps(bars_of(spark, [1, 2, 3, 4, 5, 6, 7, 8]).selectExpr("symbol", "date", "CASE WHEN close IN (1, 8) THEN close END AS close"), "close", 2)
    assert [r.close for r in made.orderBy("date").collect()] == [1.0, 1.0, 1.0, None, None, 8.0, 8.0, 8.0]


def test_sane_change_cases(spark):
    from pyspark.sql import functions as F

    rows = [(-1.0, 99.0, 100.0), (-0.01, 99.0, 100.0), (-39.0, 3900.0, 3939.0), (None, 101.0, 100.0), (7.0, 0.0, 100.0), (3.0, 130.0, 100.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw double, p double, b double").select(cleaning.sane_change(F.col("raw"), F.col("p"), F.col("b"))).collect()]
    assert [None if x is None else round(x, 4) for x in got] == [-1.0, -1.0, -0.9901, 1.0, 7.0, 3.0]


def test_key_levels_against_plain_python(spark):
    rng = random.Random(6)
    rows = [(s, datetime.date(2024, 1, 1) + datetime.timedelta(days=k), base * (1 + rng.uniform(-0.06, 0.06))) for s, base, n in (("a", 3000.0, 90), ("b", 410.0, 90), ("c", 55.0, 15), ("d", 1000.0, 61)) for k in range(n)]
    rows = [(s, d, c, c * 1.01, c * 0.985) for s, d, c in rows] + [("e", datetime.date(2024, 1, 1), 200.0, 200.0, 200.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, high double, low double")
    for r in indicators.key_levels(df).collect():
        own = [x for x in rows if x[0] == r.symbol]
        close = own[-1][2]
        levels = [sum(x[2] for x in own[-20:]) / 20] if len(own) >= 20 else []
        levels += [math.floor(close / 100) * 100.0, math.ceil(close / 100) * 100.0, max(x[3] for x in own[-60:]), min(x[4] for x in own[-60:])]
        levels = {x for x in levels if x > 0}
        for got, keep in ((r.supports, lambda x: x < close), (r.resistances, lambda x: x > close)):
            ranked = sorted((abs(x - close), x) for x in levels if keep(x))
            near = [x for gap, x in ranked if gap <= 0.035 * close] or [x for _, x in ranked[:1]]
            assert [math.isclose(a, b, abs_tol=1e-4) for a, b in zip(got, near[:3], strict=True)] == [True] * len(near[:3]), r.symbol


def test_state_composite_against_its_inputs(spark):
    from tidemark.operators import rotation as R
    from tidemark.plans import scoring as plans
    from tidemark.plans.panels import weekly_bars

    folder = "/root/testdata/sf0.01"  # brands of the smallest table have no week in common
    bars = weekly_bars(spark, folder)
    metrics = {r.symbol: r for r in R.base_metrics(bars).join(R.mean_abs_correlation(R.correlations(R.log_returns(bars))), "symbol").collect()}
    states = {r.symbol: r for r in plans.states(spark, folder).collect()}
    got = {r.symbol: r.score for r in catalog.queries()["l07_state_composite"](spark, folder).collect()}
    assert set(got) == set(metrics) & set(states) and got
    for s, value in got.items():
        m, x = metrics[s], states[s]
        if None in (m.m20, m.m60, m.mean_corr, x.natr_score):
            continue
        mood = (x.macd_state + x.rsi_state) / 2
        want = mood * abs(m.m20) * 0.3 + mood * abs(m.m60) * 0.25 - x.natr_score * 0.15 + m.mdd60 * 0.05 + x.strength * 0.1 - m.mean_corr * 0.2
        assert math.isclose(value, want, abs_tol=2e-6)
        assert x.rsi_state == (1 if 50 <= x.rsi < 70 else -1 if x.rsi < 45 else 0) and x.strength == (1.0 if x.adx >= 25 else 0.6 if x.adx >= 20 else 0.2)
        assert x.macd_state == (1 if 2 * x.dif > x.dea and x.hist > 0 else -1 if 2 * x.dif < x.dea and x.hist < 0 else 0)


def test_score_of_zeros_counts_them_as_missing(spark):
    rows = [("a", 0.5, 1.0, 0.0, 0.4, 0.0, 0.0, 0.0), ("b", 0.5, 1.0, 0.6, 0.4, 0.8, 0.3, -0.2), ("c", 0.5, 1.0, None, 0.4, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, momentum double, gate double, sentiment double, resonance double, leadership double, breadth double, share double")
    got = {r.symbol: r for r in scoring.three_factor_v3(df).collect()}
    missing = 0.5 * 0.5 * 0.5 * 0.55 + 0.4 * 0.2 + 0.4 * 0.15 + 0.5 * 0.1
    assert math.isclose(got["a"].score_v3, missing) and math.isclose(got["c"].score_v3, missing) and got["a"].events == ""
    assert math.isclose(got["b"].score_v3, 0.5 * 0.8 * 0.3 * 0.55 + 0.08 - 0.03 + 0.06) and got["b"].events == "breadth_collapse,price_share_divergence"
