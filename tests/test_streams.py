"""Monitors over several runs, with late rows and restarts, against plain Python over the whole input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges, screening
from tidemark.streaming import live, monitors

START = dt.datetime(2024, 3, 1)
DELAY = 600


def statuses(rows, seconds, dedup):
    """rows: (rule, event_id, ts) in any order."""
    out, state = {}, {}
    for rule, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        fired, minute = state.get(rule, (None, None))
        now = ts.replace(second=0, microsecond=0)
        if dedup and now == minute:
            out[rule, event] = "dedup_skipped"
            continue
        fires = fired is None or (ts - fired) >= dt.timedelta(seconds=seconds)
        state[rule] = (ts if fires else fired, now)
        out[rule, event] = "triggered" if fires else "cooldown_skipped"
    return out


@pytest.fixture(scope="module")
def matches():
    rng, at, rows = random.Random(1), START, []
    for k in range(400):
        at += dt.timedelta(microseconds=rng.choice([0, 400_000, 30_000_000, 61_000_000, 200_000_000]))
        rows.append((rng.randint(1, 3), k, at))
    return rows


def arriving(spark, rows, schema, ts, parts=5):
    """The rows in ``parts`` as they arrive: every fifth comes up to DELAY late."""
    rng = random.Random(2)
    arrived = sorted((r[ts] + dt.timedelta(seconds=rng.uniform(0, DELAY - 5) if k % 5 == 0 else 0), k) for k, r in enumerate(rows))
    size = -(-len(rows) // parts)
    return [spark.createDataFrame([rows[k] for _, k in arrived[i : i + size]], schema) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("dedup", [False, True])
def test_cooldown_in_runs_is_the_batch(spark, matches, dedup):
    parts = arriving(spark, matches, "rule long, event_id long, ts timestamp", 2)
    out = live.drained(spark, parts, lambda s: monitors.cooled_alerts(s, 90, f"{DELAY} seconds", dedup), "alerts").collect()
    want = statuses(matches, 90, dedup)
    seen = max(r[2] for r in matches) - dt.timedelta(seconds=DELAY)
    known = {(r, e) for r, e, ts in matches if ts <= seen}
    got = {(r.rule, r.event_id): r.status for r in out}
    assert len(out) == len(got) and known - set(got) == set()
    assert all(want[k] == v for k, v in got.items()) and len(got) < len(matches)
    batch = screening.cooled(spark.createDataFrame(matches, "rule long, event_id long, ts timestamp"), ["rule"], "ts", 90, dedup)
    assert {(r.rule, r.event_id): r.status for r in batch.collect()} == want
    assert set(want.values()) == {"triggered", "cooldown_skipped"} | ({"dedup_skipped"} if dedup else set())


def test_batch_and_stream_agree_below_a_second(spark):
    """Matches at 0.5 s and 60.1 s with a cooldown of 60 s: the second one is held back."""
    rows = [(1, 1, START + dt.timedelta(milliseconds=500)), (1, 2, START + dt.timedelta(milliseconds=60_100)), (1, 3, START + dt.timedelta(milliseconds=60_500)), (2, 4, START + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "rule long, event_id long, ts timestamp")
    batch = {r.event_id: r.status for r in screening.cooled(df, ["rule"], "ts", 60).collect()}
    stream = {r.event_id: r.status for r in live.drained(spark, [df], lambda s: monitors.cooled_alerts(s, 60, "1 minute"), "alerts").collect()}
    assert batch == {1: "triggered", 2: "cooldown_skipped", 3: "triggered", 4: "triggered"}
    assert stream == {k: v for k, v in batch.items() if k < 4}


def test_one_shot_waits_for_late_rows_and_fires_once(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    parts = [[(1, 10, at(100)), (2, 20, at(5))], [(1, 11, at(40)), (1, 12, at(101)), (3, 30, at(900))], [(1, 13, at(2000)), (2, 21, at(2000))], [(1, 14, at(5000)), (4, 40, at(5000))]]
    out = live.drained(spark, [spark.createDataFrame(p, "rule long, event_id long, ts timestamp") for p in parts], lambda s: monitors.one_shot(s, f"{DELAY} seconds"), "shots")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 11), (2, 20), (3, 30)]


def watched(ticks, gap, fill, within):
    out, last, day = {}, {}, {}
    opened = {}
    for symbol, ts, _, price in sorted(ticks, key=lambda r: (r[1], r[2])):
        if price is None:
            continue
        if symbol in last and day[symbol] != ts.date():
            opened.pop(symbol, None)
            if last[symbol] and price and abs(price / last[symbol] - 1) >= gap:
                opened[symbol] = (ts, last[symbol], price)
                out[symbol, ts] = (None, 0.0, None, 0.0)
        if symbol in opened:
            at, was, first = opened[symbol]
            g, change = first / was - 1, price / first - 1
            if (ts - at).total_seconds() > within:
                del opened[symbol]
            elif (change <= -fill) if g > 0 else (change >= fill):
                share = abs(change) / abs(g)
                out[symbol, at] = (ts, share, "buy" if g > 0 else "sell", min(0.8, 0.5 + 0.3 * share))
                del opened[symbol]
        last[symbol], day[symbol] = price, ts.date()
    return out


def test_gaps_in_runs_are_the_batch(spark):
    rng, rows = random.Random(3), []
    for symbol in "abc":
        price = 100.0
        for d in range(8):
            price *= 1 + rng.choice([0, 0.004, 0.01, -0.01, 0.03, -0.03])
            for k in range(30):
                price *= 1 + rng.uniform(-0.004, 0.004)
                rows.append((symbol, START + dt.timedelta(days=d, hours=9, seconds=k * 120 + rng.random()), len(rows), None if rng.random() < 0.02 else price))
    rows.append(("zero", START, len(rows), 0.0))
    rows.append(("zero", START + dt.timedelta(days=1), len(rows), 5.0))
    want = watched(rows, 0.008, 0.003, 1800)
    micros = lambda t: None if t is None else int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5)
    want = {(s, micros(t)): (micros(f), *v) for (s, t), (f, *v) in want.items()}

    def held(out):
        got = {(r.symbol, r.opened_us): (r.filled_us, r.fill, r.signal, r.strength) for r in out.collect()}
        for k, v in got.items():
            assert v[0] == want[k][0] and v[2] == want[k][2] and v[1] == pytest.approx(want[k][1]) and v[3] == pytest.approx(want[k][3])
        return got

    schema = "symbol string, ts timestamp, id long, price double"
    ticks = spark.createDataFrame(rows, schema)
    assert set(held(ranges.gap_fills(ticks))) == set(want)
    parts = arriving(spark, rows, schema, 1, 6)
    got = held(live.drained(spark, parts, lambda s: monitors.watched_gaps(s, late=f"{DELAY} seconds"), "gaps"))
    seen = max(r[1] for r in rows) - dt.timedelta(seconds=DELAY)
    assert {k for k in want if k[1] + 1801 * 10**6 <= micros(seen)} <= set(got)
    assert any(v[2] == "buy" for v in got.values()) and any(v[2] == "sell" for v in got.values()) and any(v[2] is None for v in got.values())


def test_state_goes_once_it_cannot_matter(spark):
    """After its cooldown a rule holds nothing: a later match fires without any memory of the one before."""

    class Held:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, x):
            self.value = x

        def clear(self):
            self.value = None

    class Handle:
        def getListState(self, *_):  # noqa: N802
            held = Held()
            held.get, held.appendList, held.put = lambda: iter(held.value or []), lambda x: held.update([*(held.value or []), *x]), held.update
            return held

        def getValueState(self, *_):  # noqa: N802
            return Held()

        def registerTimer(self, _): ...  # noqa: N802

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    import pandas as pd

    monitor = monitors.Cooldown(10, True)
    monitor.init(Handle())
    list(monitor.handleInputRows((1,), iter([pd.DataFrame({"us": [5_000_000, 1_000_000], "id": [2, 1]})]), Now(0)))
    out = [r for x in monitor.handleExpiredTimer((1,), Now(6_000), None) for r in x.itertuples(index=False, name=None)]
    assert out == [(1, 1, "triggered"), (1, 2, "dedup_skipped")] and monitor.last.exists() and list(monitor.waiting.get()) == []
    assert list(monitor.handleExpiredTimer((1,), Now(20_000), None)) == [] and monitor.last.exists()
    assert list(monitor.handleExpiredTimer((1,), Now(60_000), None)) == [] and not monitor.last.exists()


def test_monitors_ask_the_store_per_run_and_not_per_row():
    import pandas as pd

    asked = []

    class State:
        def __init__(self):
            self.value = None

        def __getattribute__(self, name):
            if name != "value":
                asked.append(name)
            return object.__getattribute__(self, name)

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value if isinstance(self.value, tuple) else iter(self.value or [])

        def update(self, x):
            self.value = x

        put = update

        def appendList(self, x):  # noqa: N802
            self.value = [*(self.value or []), *x]

        def clear(self):
            self.value = None

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return State()

        getValueState = getListState  # noqa: N815

        def registerTimer(self, _):  # noqa: N802
            asked.append("timer")

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10**11

    n, day = 4000, 24 * 60 * monitors.MINUTE
    rows = pd.DataFrame({"us": [k * day // 10 for k in range(n)][::-1], "id": range(n), "price": [1.0 + k // 10 % 2 for k in range(n)]})
    for monitor in (monitors.Cooldown(10, True), monitors.GapWatch(0.05, 0.02, 3600)):
        asked.clear()
        monitor.init(Handle())
        for part in (rows[: n // 2], rows[n // 2 :]):
            list(monitor.handleInputRows(("a",), iter([part]), Now()))
        out = pd.concat(monitor.handleExpiredTimer(("a",), Now(), None))
        assert len(out) > 100 and len(asked) < 20
