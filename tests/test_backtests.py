"""The event simulator and the strategies against a loop over the bars."""

import datetime as dt
import math

import numpy as np
import pandas as pd

from tidemark.operators import backtests as K

START = dt.date(2022, 1, 3)


def prices(seed, n=260):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame({"date": [START + dt.timedelta(days=k) for k in range(n)], "close": close, "high": close * (1 + rng.uniform(0, 0.02, n)), "low": close * (1 - rng.uniform(0, 0.02, n))})


def said(x, name, low=30.0, high=70.0, width=2.0, percent=5.0):
    """The event of the last bar of x, all indicators made anew on it."""
    c = x["close"]

    def cross(f, s):
        if f.iloc[-2] <= s.iloc[-2] and f.iloc[-1] > s.iloc[-1]:
            return "entry"
        return "exit" if f.iloc[-2] >= s.iloc[-2] and f.iloc[-1] < s.iloc[-1] else None

    if name == "sma_crossover":
        return cross(c.rolling(20).mean(), c.rolling(50).mean())
    ema = lambda v, n: v.ewm(span=n, adjust=False).mean()
    if name == "ema_crossover":
        return cross(ema(c, 12), ema(c, 26))
    if name == "macd":
        dif = ema(c, 12) - ema(c, 26)
        return cross(dif, ema(dif, 9))
    if name == "rsi_reversal":
        d = c.diff()
        rsi = 100 - 100 / (1 + d.where(d > 0, 0).rolling(14).mean() / (-d.where(d < 0, 0)).rolling(14).mean())
        a, b = rsi.iloc[-2], rsi.iloc[-1]
        return "entry" if a <= low and b > low else "exit" if a >= high and b < high else None
    m, s = c.rolling(20).mean(), c.rolling(20).std()
    if name == "bollinger_bands":
        up, down = m + width * s, m - width * s
        return "entry" if c.iloc[-2] >= down.iloc[-2] and c.iloc[-1] < down.iloc[-1] else "exit" if c.iloc[-2] <= up.iloc[-2] and c.iloc[-1] > up.iloc[-1] else None
    if name == "mean_reversion":
        z = (c - m) / s
        return "entry" if z.iloc[-1] < -width and z.iloc[-2] >= -width else "exit" if z.iloc[-1] >= 0 and z.iloc[-2] < 0 else None
    if name == "breakout":
        return "entry" if c.iloc[-1] > x["high"].iloc[-21:-1].max() else "exit" if c.iloc[-1] < x["low"].iloc[-21:-1].min() else None
    roc = lambda k: (c.iloc[-1 - k] / c.iloc[-14 - k] - 1) * 100
    return "entry" if roc(1) <= percent and roc(0) > percent else "exit" if roc(1) >= 0 and roc(0) < 0 else None


def simulated(events, closes, capital=10_000.0, share=0.95, fee=0.001, slip=0.0005):
    cash, size, entry, trades, curve = capital, 0.0, None, [], []
    for k, (event, price) in enumerate(zip(events, closes, strict=True)):
        if event == "entry" and entry is None:
            value = cash * share
            entry, size = (k, price * (1 + slip)), value / (price * (1 + slip))
            cash -= value * (1 + fee)
        elif event == "exit" and entry is not None:
            value = size * price * (1 - slip)
            cash += value * (1 - fee)
            trades.append((entry[0], k, entry[1], price * (1 - slip), size))
            entry, size = None, 0.0
        curve.append(cash + size * price)
    if entry is not None:
        value = size * closes[-1] * (1 - slip)
        trades.append((entry[0], len(closes) - 1, entry[1], closes[-1] * (1 - slip), size))
        curve[-1] = cash + value * (1 - fee)
    return curve, trades


def test_strategies_and_simulator_are_the_loop(spark):
    frames = {"a": prices(1), "b": prices(2), "few": prices(3, 12)}
    rows = [(s, r.date, float(r.high), float(r.low), float(r.close)) for s, x in frames.items() for r in x.itertuples()]
    bars = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double").repartition(4)
    events = K.strategy_events(bars, {"sma_crossover": 60, "ema_crossover": 60}, low=40.0, high=60.0, width=1.5, percent=3.0)
    curves = K.equity_curves(events)
    got, met, trades = {}, {(r.strategy, r.symbol): r for r in K.equity_metrics(curves).collect()}, {}
    for r in curves.collect():
        got.setdefault((r.strategy, r.symbol), {})[r.date] = r
    for r in K.event_trades(curves).collect():
        trades.setdefault((r.strategy, r.symbol), []).append((r.entry_date, r.exit_date, r.entry_price, r.exit_price, r.size))
    warm = K.STRATEGIES | {"sma_crossover": 60, "ema_crossover": 60}
    seen = set()
    for symbol, x in frames.items():
        for name in K.STRATEGIES:
            want = [None if k < warm[name] else said(x.iloc[: k + 1], name, 40.0, 60.0, 1.5, 3.0) for k in range(len(x))]
            mine = [got[name, symbol][d] for d in x["date"]]
            assert [r.event for r in mine] == want, name
            seen |= {(name, e) for e in want}
            curve, deals = simulated(want, x["close"].tolist())
            np.testing.assert_allclose([r.equity for r in mine], curve, rtol=1e-9)
            assert [(a, b) for a, b, *_ in sorted(trades.get((name, symbol), []))] == [(x["date"][a], x["date"][b]) for a, b, *_ in deals]
            for t, d in zip(sorted(trades.get((name, symbol), [])), deals, strict=True):
                np.testing.assert_allclose(t[2:], d[2:], rtol=1e-9)
            peak, run, longest, worst = 10_000.0, 0, 0, 0.0
            for e in curve:
                peak = max(peak, e)
                run = run + 1 if e < peak - 1e-9 else 0
                longest, worst = max(longest, run), min(worst, (e / peak - 1) * 100)
            m = met[name, symbol]
            assert m.longest_drawdown == longest and m.trades == len(deals) and math.isclose(m.max_drawdown_pct, worst, abs_tol=1e-9) and math.isclose(m.final, curve[-1], rel_tol=1e-9)
            if deals:
                assert math.isclose(m.win_rate, 100 * sum(d[3] > d[2] for d in deals) / len(deals))
    assert seen >= {(k, e) for k in K.STRATEGIES for e in ("entry", "exit")}
