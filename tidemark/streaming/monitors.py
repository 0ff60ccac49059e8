"""Monitors that keep state: alerts with a cooldown, one-shot alerts, gaps until they fill.

Rows come in any order within the watermark's delay, and in any number of micro-batches. A monitor holds them until the
watermark has passed them, then takes them in the order of their times, so that what it says is what the whole table in
one batch would give, up to the watermark. Timers by event time set it off; what no later row can need is dropped. All
times within are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that such monitors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000
#: Rows of a block of waiting records, and of a frame that a monitor gives.
BLOCK = 50_000


class InOrder(StatefulProcessor):
    """Rows (us, id, ...) of a key in order, each once the watermark has passed it; rows of one time go by id.

    Waiting rows are at most those of the watermark's delay. They are kept as blocks of records, and a subclass keeps what
    it knows in ``state``, a tuple that is read and written once a call: each access to the store is a message to the JVM.
    A subclass has ``step`` (a row; what it gives) and ``due`` (after the rows up to a time; what that gives).
    """

    #: The records that wait, in the order of their fields: us and id first.
    waits = [("us", "<i8"), ("id", "<i8")]
    #: DDL of ``state``, None before there is any and once it is dropped.
    holds = ""
    gives: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.last = handle.getValueState("state", self.holds)

    def step(self, key: tuple, row: tuple) -> list[tuple]:
        return []

    def due(self, key: tuple, now: int) -> list[tuple]:
        return []

    def wakes(self) -> int | None:
        """When ``due`` has something to do next."""
        return None

    def at(self, us: int) -> None:
        """Be set off once the watermark has reached us."""
        self.handle.registerTimer(-(-us // 1000))

    def _keep(self, rows: np.ndarray) -> None:
        self.waiting.appendList([(rows[k : k + BLOCK].tobytes(),) for k in range(0, len(rows), BLOCK)])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        last = None
        for some in rows:
            new = np.empty(len(some), self.waits)
            for name in new.dtype.names:
                np.copyto(new[name], some[name].to_numpy(), casting="same_kind")
            if len(new):
                self._keep(new)
                last = int(new["us"].max()) if last is None else max(last, int(new["us"].max()))
        if last is not None:
            self.at(last)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [np.frombuffer(b, self.waits) for (b,) in self.waiting.get()]
        rows = np.concatenate(blocks) if blocks else np.empty(0, self.waits)
        early = rows["us"] <= now
        was = self.state = tuple(self.last.get()) if self.last.exists() else None
        out = []
        if early.any():
            self.waiting.clear()
            if not early.all():
                self._keep(rows[~early])
            ready = rows[early]
            ready = ready[np.lexsort((ready["id"], ready["us"]))]
            for k in range(0, len(ready), BLOCK):
                for row in ready[k : k + BLOCK].tolist():
                    out += self.step(key, row)
                if len(out) >= BLOCK:
                    yield pd.DataFrame(out, columns=self.gives, dtype=object)
                    out = []
        out += self.due(key, now)
        if self.state != was:
            if self.state is None:
                self.last.clear()
            else:
                self.last.update(self.state)
        wakes = self.wakes()
        if wakes is not None:
            self.at(wakes)
        if out:
            yield pd.DataFrame(out, columns=self.gives, dtype=object)


class Cooldown(InOrder):
    """triggered, or cooldown_skipped within the cooldown of the last trigger, or dedup_skipped in one minute with the match before."""

    holds = "fired long, minute long"
    gives = ["rule", "event_id", "status"]

    def __init__(self, seconds: int, dedup: bool) -> None:
        self.cooldown, self.dedup = seconds * 1_000_000, dedup

    def step(self, key: tuple, row: tuple) -> list[tuple]:
        fired, minute = self.state or (None, None)
        now = row[0] // MINUTE
        if self.dedup and minute == now:
            status = "dedup_skipped"
        else:
            status = "triggered" if fired is None or row[0] - fired >= self.cooldown else "cooldown_skipped"
        self.state = (row[0] if status == "triggered" else fired, now)
        return [(key[0], row[1], status)]

    def wakes(self) -> int | None:
        return max(self.state[0] + self.cooldown, (self.state[1] + 1) * MINUTE) if self.state else None

    def due(self, key: tuple, now: int) -> list[tuple]:
        if self.state and now >= self.wakes():
            self.state = None  # no later match can be held back by it
        return []


class OneShot(StatefulProcessor):
    """The first match of a key by time and id, once no earlier one can come; then the key is off. Its state is one row, however many matches there are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first, self.off = handle.getValueState("first", "us long, id long"), handle.getValueState("off", "off boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        least = min(min(zip(x["us"].tolist(), x["id"].tolist(), strict=True)) for x in rows)
        if not self.off.exists() and (not self.first.exists() or least < tuple(self.first.get())):
            self.first.update(least)
            self.handle.registerTimer(-(-least[0] // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        if self.first.exists() and self.first.get()[0] <= timerValues.getCurrentWatermarkInMs() * 1000:
            event = self.first.get()[1]
            self.first.clear()
            self.off.update((True,))
            yield pd.DataFrame({"rule": [key[0]], "event_id": [event]})


class GapWatch(InOrder):
    """Each day's opening gap against the last price before, and whether it filled within a time of the opening."""

    waits = [*InOrder.waits, ("price", "<f8")]
    holds = "us long, price double, opened long, previous double, opening double"
    gives = ["symbol", "opened_us", "previous", "opening", "gap", "filled_us", "fill", "signal", "strength"]

    def __init__(self, gap: float, fill: float, within: int) -> None:
        self.gap, self.fill, self.within = gap, fill, within * 1_000_000

    def step(self, key: tuple, row: tuple) -> list[tuple]:
        us, _, price = row
        day, out = 24 * 60 * MINUTE, []
        last, before, *watch = self.state or (None,) * 5
        if last is not None and last // day < us // day:
            out += self._unfilled(key, watch)
            watch = [None] * 3
            if before and price and abs(price / before - 1) >= self.gap:
                watch = [us, before, price]
        if watch[0] is not None:
            opened, previous, opening = watch
            if us - opened > self.within:
                out += self._unfilled(key, watch)
                watch = [None] * 3
            else:
                gap, change = opening / previous - 1, price / opening - 1
                if (change <= -self.fill) if gap > 0 else (change >= self.fill):
                    fill = abs(change) / abs(gap)
                    out.append((key[0], opened, previous, opening, gap, us, fill, "buy" if gap > 0 else "sell", min(0.8, 0.5 + 0.3 * fill)))
                    watch = [None] * 3
        self.state = (us, price, *watch)
        return out

    def _unfilled(self, key: tuple, watch: list) -> list[tuple]:
        opened, previous, opening = watch
        return [] if opened is None else [(key[0], opened, previous, opening, opening / previous - 1, None, 0.0, None, 0.0)]

    def wakes(self) -> int | None:
        return self.state[2] + self.within + 1 if self.state and self.state[2] is not None else None

    def due(self, key: tuple, now: int) -> list[tuple]:
        if self.wakes() is None or now < self.wakes():
            return []
        us, price, *watch = self.state
        self.state = (us, price, None, None, None)
        return self._unfilled(key, watch)


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    return rows.withColumn("us", F.unix_micros(F.col(ts))).withWatermark(ts, late)


def cooled_alerts(matches: DataFrame, seconds: int, late: str = "1 hour", dedup: bool = False) -> DataFrame:
    """matches (rule, event_id, ts) with status: triggered, cooldown_skipped less than ``seconds`` after the rule's last trigger, and with
    ``dedup`` dedup_skipped in the same minute as the rule's match before. The batch form is operators.screening.cooled."""
    rows = _timed(matches, "ts", late).withColumn("id", F.col("event_id"))
    return rows.groupBy("rule").transformWithStateInPandas(Cooldown(seconds, dedup), "rule long, event_id long, status string", "Append", "EventTime")


def one_shot(matches: DataFrame, late: str = "1 hour") -> DataFrame:
    """(rule, event_id): the first match of each rule (rule, event_id, ts); a rule that has fired is off."""
    rows = _timed(matches, "ts", late).withColumn("id", F.col("event_id"))
    return rows.groupBy("rule").transformWithStateInPandas(OneShot(), "rule long, event_id long", "Append", "EventTime")


def watched_gaps(ticks: DataFrame, gap: float = 0.008, fill: float = 0.003, within: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(symbol, opened_us, previous, opening, gap, filled_us, fill, signal, strength) of ticks (symbol, ts, id, price): a row for each day that
    opens ``gap`` or more away from the last price before it.

    A gap fills when the price comes back by ``fill`` from the opening within ``within`` seconds of it: then buy after a
    gap up, sell after one down, the stronger the more of the gap is gone. Else the row says so once the time is over.
    Prices that are 0 or missing open no gap. The batch form is operators.ranges.gap_fills.
    """
    rows = _timed(ticks.filter("price IS NOT NULL"), "ts", late)
    kinds = "symbol string, opened_us long, previous double, opening double, gap double, filled_us long, fill double, signal string, strength double"
    return rows.groupBy("symbol").transformWithStateInPandas(GapWatch(gap, fill, within), kinds, "Append", "EventTime")
