"""Fitted forecasts against plain numpy, simulated series and brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecasts as P

START = dt.date(2020, 1, 1)


def bars_of(spark, closes, extra=None):
    """closes: symbol -> prices of consecutive days."""
    rows = [(s, START + dt.timedelta(days=k), float(c), float(c * 1.02), float(c * 0.97), float(c), float(100 + k % 7)) for s, x in closes.items() for k, c in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


# --- logistic


def newton(x, y, penalty=0.01):
    """The same objective by dense Newton steps."""
    n, k = x.shape
    a, w = np.c_[x, np.ones(n)], np.zeros(k + 1)
    ridge = np.r_[np.full(k, 2 * penalty / k), 0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a @ w)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / n + np.diag(ridge), a.T @ (p - y) / n + ridge * w)
    return w


def test_logistic_fit_is_numpys(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, n, shift in (("a", 400, 0.0), ("b", 90, 2.0), ("few", 79, 0.0), ("apart", 200, 0.0)):
        x = rng.normal(shift, [1, 5, 0.01], (n, 3))
        y = (x[:, 0] > 0).astype(float) if key == "apart" else (x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 1, n) > shift).astype(float)
        rows += [(key, *map(float, r), 7.0, float(t)) for r, t in zip(x, y, strict=True)]
        x = np.c_[x, np.full(n, 7.0)]  # a feature that never moves
        std = np.where(x.std(0) > 1e-12, x.std(0), 1)
        want[key] = (x.mean(0), std, newton((x - x.mean(0)) / std, y), n)
    rows += [("a", None, 1.0, 1.0, 7.0, 1.0), ("a", 1.0, 1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(rows, "k string, f1 double, f2 double, f3 double, f4 double, y double").repartition(5)
    models = {r.k: r for r in P.fit_logistic(df, ["k"], ["f1", "f2", "f3", "f4"], "y").collect()}
    assert set(models) == {"a", "b", "apart"}
    for key, r in models.items():
        mean, std, w, n = want[key]
        assert r.n == n
        np.testing.assert_allclose(r.mean, mean, rtol=1e-9)
        np.testing.assert_allclose(r.std, std, rtol=1e-9)
        np.testing.assert_allclose([*r.weights, r.bias], w, atol=1e-7)
    scored = P.logistic_scores(df.dropna(), spark.createDataFrame(list(models.values())), ["k"], ["f1", "f2", "f3", "f4"]).filter("k = 'a'").collect()
    mean, std, w, _ = want["a"]
    for r in scored[:50]:
        z = (np.array([r.f1, r.f2, r.f3, r.f4]) - mean) / std
        assert math.isclose(r.probability_up, 1 / (1 + math.exp(-(z @ w[:-1] + w[-1]))), abs_tol=1e-6)


def test_logistic_forecast_sees_no_test_bar(spark):
    """What comes after the split changes neither the models nor any probability before it."""
    rng = np.random.default_rng(2)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    y = x.copy()
    y[200:] *= 3 + rng.normal(0, 0.5, 100)
    split = F.lit(START + dt.timedelta(days=200)).cast("date")
    first, second = ({(r.date, r.part): r.probability_up for r in P.logistic_forecast(bars_of(spark, {"a": v}), split).collect() if r.date < START + dt.timedelta(days=200)} for v in (x, y))
    assert first == second and len(first) == 200
    assert sum(part == "test" for _, part in first) == 1  # the bar whose label lies beyond the split


# --- neighbours


def neighbours(rows, k):
    out = {}
    for s, d, *v in rows:
        if None in v or not any(v):
            continue
        close = []
        for t, e, *u in rows:
            if t == s and e < d and None not in u and any(u):
                cos = sum(a * b for a, b in zip(u, v, strict=True)) / math.sqrt(sum(a * a for a in u)) / math.sqrt(sum(b * b for b in v))
                close.append((-round(cos, 9), -e.toordinal()))
        if close:
            out[s, d] = [dt.date.fromordinal(-e) for _, e in sorted(close)[:k]]
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_earlier_neighbours_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "NEIGHBOUR_BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(s, START + dt.timedelta(days=k), *map(float, rng.normal(0, 1, 3))) for s in "ab" for k in range(60)]
    rows[5], rows[9] = ("a", rows[5][1], None, 1.0, 1.0), ("a", rows[9][1], 0.0, 0.0, 0.0)
    rows += [("c", START + dt.timedelta(days=k), 1.0, 2.0, 0.0) for k in range(30)]  # all alike: the latest come first
    df = spark.createDataFrame(rows, "symbol string, date date, x double, y double, z double").repartition(3)
    got = {}
    for r in P.earlier_neighbours(df, "symbol", "date", ["x", "y", "z"], 4).orderBy("symbol", "date", "place").collect():
        got.setdefault((r.symbol, r.date), []).append(r.other_date)
        assert r.other_date < r.date
    assert got == neighbours(rows, 4)
    share = {(r.symbol, r.date): (r.n, r.share) for r in P.earlier_share(df, "symbol", "date", "x").collect()}
    had = [(s, d, x) for s, d, x, y, z in rows if x is not None]
    for s, d, x in had:
        before = [u for t, e, u in had if t == s and e < d]
        assert share[s, d] == (len(before), sum(u <= x for u in before) / len(before) if before else None)


def test_calibration_looks_back_only(spark):
    rng = np.random.default_rng(4)
    rows = [("a", START + dt.timedelta(days=k), float(rng.normal()), int(rng.random() < 0.7) if k % 5 else None) for k in range(150)]
    got = {r.date: r for r in P.calibrated(spark.createDataFrame(rows, "symbol string, date date, s double, label int")).collect()}
    for k, (_, d, s, _) in enumerate(rows):
        past = [(u, y) for _, _, u, y in rows[max(0, k - 60) : k] if y is not None]
        alpha = 1.0
        if len(past) >= 20:
            brier = [round(sum((1 / (1 + math.exp(-a * u)) - y) ** 2 for u, y in past) / len(past), 12) for a in P.ALPHAS]
            alpha = P.ALPHAS[brier.index(min(brier))]
            assert math.isclose(got[d].brier, min(brier), abs_tol=1e-9)
        assert got[d].alpha == alpha and math.isclose(got[d].p_up_rule, 1 / (1 + math.exp(-alpha * s)), rel_tol=1e-12)


# --- GARCH


def simulated(n, mu, omega, alpha, beta, seed):
    rng = np.random.default_rng(seed)
    v, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        e = rng.normal() * math.sqrt(v)
        out.append(mu + e)
        v = omega + alpha * e * e + beta * v
    return np.array(out), v


def test_garch_recovers_parameters():
    for seed, scale in ((1, 1.0), (2, 1000.0), (3, 1e-3)):
        r, v = simulated(6000, 0.05, 0.1, 0.1, 0.8, seed)
        fit = P.fit_garch(r * scale)
        assert fit["converged"]
        assert abs(fit["alpha"] - 0.1) < 0.035 and abs(fit["beta"] - 0.8) < 0.07 and abs(fit["mu"] / scale - 0.05) < 0.04
        assert abs(fit["omega"] / scale**2 - 0.1) < 0.05 and abs(fit["sigma_next"] / scale / math.sqrt(v) - 1) < 0.08
        free = np.array([[0.05, math.log(0.1), math.log(0.1 / 0.1), math.log(0.8 / 0.1)]])
        at_truth = -len(r) * (P.garch_loss(r, free)[0] + 0.5 * math.log(2 * math.pi) + math.log(scale))
        assert fit["loglik"] >= at_truth - 1e-6


def test_garch_loss_is_the_plain_loop():
    r, _ = simulated(200, 0.0, 0.2, 0.15, 0.7, 5)
    mu, omega, alpha, beta = (x[0] for x in P.garch_parameters(np.array([[0.01, -1.5, -0.5, 1.0]])))
    v, total = r.var(), 0.0
    for t, x in enumerate(r):
        v = v if t == 0 else omega + alpha * (r[t - 1] - mu) ** 2 + beta * v
        total += math.log(v) + (x - mu) ** 2 / v
    assert math.isclose(P.garch_loss(r, np.array([[0.01, -1.5, -0.5, 1.0]]))[0], total / 400, rel_tol=1e-12)


def test_garch_forecast_of_short_flat_and_long_series(spark):
    r, _ = simulated(700, 0.0, 2.0, 0.1, 0.8, 6)
    closes = {"long": 100 * np.exp(np.cumsum(r) / 1000), "flat": np.full(200, 5.0), "short": 100 + np.arange(40.0)}
    got = P.garch_forecast(bars_of(spark, closes)).collect()
    assert [(g.symbol, g.n) for g in got] == [("long", 500)]
    g, last = got[0], P.fit_garch(np.diff(np.log(closes["long"]))[-500:] * 1000)
    assert math.isclose(g.sigma_next, last["sigma_next"], rel_tol=1e-6) and g.lower < g.close < g.upper
    assert math.isclose(g.upper / g.close - 1, 1.645 * g.sigma_next / 1000, rel_tol=1e-9)


# --- ARIMA


def plain_sse(d, phi, theta):
    e = []
    for t in range(len(d)):
        e.append(d[t] - sum(f * d[t - 1 - i] for i, f in enumerate(phi) if t > i) - sum(m * e[t - 1 - j] for j, m in enumerate(theta) if t > j))
    return sum(x * x for x in e)


def test_arima_residuals_are_the_plain_loop():
    rng = np.random.default_rng(7)
    d = rng.normal(0, 1, 80)
    for p, q in ((0, 1), (1, 0), (2, 3), (3, 2)):
        phi, theta = rng.uniform(-0.4, 0.4, p), rng.uniform(-0.4, 0.4, q)
        e = P.arma_residuals(d, phi[None], theta[None])[:, 0]
        assert math.isclose(float(e @ e), plain_sse(d, phi, theta), rel_tol=1e-10)


def test_arima_weights_are_stationary():
    rng = np.random.default_rng(8)
    for w in P.lag_weights(rng.normal(0, 2, (200, 3))):
        assert np.abs(np.roots([1, *(-w)])).max() < 1 + 1e-9


def test_arima_finds_weights_that_a_grid_finds():
    rng = np.random.default_rng(9)
    d = np.zeros(300)
    e = rng.normal(0, 1, 300)
    for t in range(1, 300):
        d[t] = 0.6 * d[t - 1] + e[t] + 0.3 * e[t - 1]
    prices = np.r_[100.0, 100 + np.cumsum(d)]
    fit = P.fit_arima(prices, 1, 1)
    grid = min(plain_sse(d, [a], [b]) for a in np.arange(0.4, 0.82, 0.02) for b in np.arange(0.0, 0.62, 0.02))
    assert fit["converged"] and len(d) * fit["variance"] <= grid * (1 + 1e-3)
    least = 2 * 3 + len(d) * (math.log(2 * math.pi * grid / len(d)) + 1)
    assert abs(fit["aic"] - least) < 1 and fit["ljung_box"] > 0.01 and fit["mean_p"] < 0.01
    alone = P.fit_arima(prices, 1, 0)
    slope = float(d[:-1] @ d[1:] / (d[:-1] @ d[:-1]))
    assert math.isclose(len(d) * alone["variance"], plain_sse(d, [slope], []) - len(d) * np.mean(d - np.r_[0, slope * d[:-1]]) ** 2, rel_tol=1e-4)


def test_arima_trend_picks_the_least_aic(spark):
    rng = np.random.default_rng(10)
    closes = {"up": 100 + np.cumsum(0.8 + rng.normal(0, 0.3, 260)), "noise": 100 + rng.normal(0, 0.2, 120), "short": np.arange(1.0, 20), "flat": np.full(60, 3.0)}
    bars = bars_of(spark, closes)
    best = {r.symbol: r for r in P.arima_trend(bars).collect()}
    assert set(best) == {"up", "noise"}
    for s, r in best.items():
        x = closes[s][-200:]
        fits = {o: P.fit_arima(x, *o) for o in P.ORDERS}
        order = min(P.ORDERS, key=lambda o: round(fits[o]["aic"], 9))
        f = fits[order]
        assert (r.p, r.q) == order and math.isclose(r.aic, f["aic"], rel_tol=1e-9)
        hold = lambda v: min(0.95, max(0.5, v))
        parts = [hold(1 - 2 * f["mean_p"]), (hold(1 - f["aic"] / 10000) + hold(1 - f["bic"] / 10000)) / 2, hold(f["ljung_box"]), hold(1 - f["variance"] / 10000)]
        assert math.isclose(r.confidence, hold(sum(parts) / 4), rel_tol=1e-9)
    assert best["up"].forecast > closes["up"][-1]


def test_ljung_box_against_its_definition():
    rng = np.random.default_rng(11)
    e = rng.normal(0, 1, 200)
    assert 0 <= P.ljung_box(e) <= 1 and P.ljung_box(np.cumsum(e)) < 1e-6
    # The tail of a chi-square with 2 degrees is exp(-x / 2): one pair of lags by hand.
    c = e - e.mean()
    stat = 200 * 202 * sum((float(c[k:] @ c[:-k]) / float(c @ c)) ** 2 / (200 - k) for k in (1, 2))
    assert math.isclose(P.ljung_box(e, 2), math.exp(-stat / 2), rel_tol=1e-12)
