"""A table function for SQL: any set of indicators over partitions of bars.

    SELECT * FROM indicators(TABLE(bars) PARTITION BY symbol ORDER BY (date), 'MA5,MA20,RSI14,MACD')

Its columns follow from the names. A partition is a series, held by its task as plain columns until the last bar has come.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Used where a name has no number: bands, ranges and stochastics of so many bars.
DEFAULTS = {"MA": 20, "EMA": 20, "RSI": 14, "BOLL": 20, "ATR": 14, "KDJ": 9, "CCI": 20, "ADX": 14}
DEFAULT_SET = "MA5,MA10,MA20,MACD,RSI14,BOLL20"


def parsed(names: str) -> list[tuple[str, int]]:
    """(kind, bars) of comma-separated names such as MA10, rsi14, MACD or BOLL; empty means DEFAULT_SET, repeats count once."""
    out: list[tuple[str, int]] = []
    for name in (names or "").split(",") if (names or "").strip() else DEFAULT_SET.split(","):
        found = re.fullmatch(r"\s*(MA|EMA|RSI|BOLL|ATR|KDJ|CCI|ADX|MACD)\s*([0-9]*)\s*", name, re.IGNORECASE)
        if not found or found[1].upper() == "MACD" and found[2] or found[2] and int(found[2]) < 1:
            raise ValueError(f"no such indicator: {name.strip()!r}")
        one = (found[1].upper(), int(found[2]) if found[2] else DEFAULTS.get(found[1].upper(), 0))
        if one not in out:
            out.append(one)
    return out


def columns(kind: str, n: int) -> list[str]:
    more = {"MACD": ["dif", "dea", "hist"], "BOLL": [f"middle{n}", f"upper{n}", f"lower{n}"], "ATR": [f"atr{n}", f"natr{n}"], "KDJ": [f"k{n}", f"d{n}", f"j{n}"], "ADX": [f"plus_di{n}", f"minus_di{n}", f"adx{n}"]}
    return more.get(kind, [f"{kind.lower()}{n}"])


def least_bars(names: str) -> int:
    """Bars that a series needs for the last value of all indicators."""
    need = {"MA": lambda n: n, "EMA": lambda n: 1, "RSI": lambda n: n + 2, "BOLL": lambda n: n + 1, "ATR": lambda n: n + 2, "KDJ": lambda n: n + 11, "CCI": lambda n: n + 2, "ADX": lambda n: 2 * n + 5, "MACD": lambda n: 26 + 9 - 1}
    return max([2, *(need[k](n) for k, n in parsed(names))])


def _smooth(x: pd.Series, alpha: float) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()


def _rsi(x: pd.DataFrame, n: int) -> list[pd.Series]:
    move = x["close"].diff()
    up, down = _smooth(move.clip(lower=0), 1 / n), _smooth((-move).clip(lower=0), 1 / n)
    value = (100 - 100 / (1 + up / down.where(down != 0))).mask(down == 0, 100.0)
    return [value.where(pd.Series(range(1, len(x) + 1), index=x.index) > n)]


def _true_range(x: pd.DataFrame) -> pd.Series:
    was = x["close"].shift()
    return pd.concat([x["high"] - x["low"], (x["high"] - was).abs(), (x["low"] - was).abs()], axis=1).max(axis=1)


def _macd(x: pd.DataFrame, n: int) -> list[pd.Series]:
    dif = _smooth(x["close"], 2 / 13) - _smooth(x["close"], 2 / 27)
    dea = _smooth(dif, 0.2)
    return [dif, dea, dif - dea]


def _bollinger(x: pd.DataFrame, n: int) -> list[pd.Series]:
    middle, d = x["close"].rolling(n).mean(), x["close"].rolling(n).std(ddof=0)
    return [middle, middle + 2 * d, middle - 2 * d]


def _atr(x: pd.DataFrame, n: int) -> list[pd.Series]:
    value = _true_range(x).rolling(n).mean()
    return [value, value / x["close"] * 100]


def _kdj(x: pd.DataFrame, n: int) -> list[pd.Series]:
    low, high = x["low"].rolling(n).min(), x["high"].rolling(n).max()
    rsv = ((x["close"] - low) / (high - low).where(high > low) * 100).mask(high == low, 50.0)
    k = _smooth(rsv, 1 / 3)
    d = _smooth(k, 1 / 3)
    return [k, d, 3 * k - 2 * d]


def _cci(x: pd.DataFrame, n: int) -> list[pd.Series]:
    typical = (x["high"] + x["low"] + x["close"]) / 3
    mean = typical.rolling(n).mean()
    spread = typical.rolling(n).apply(lambda v: abs(v - v.mean()).mean(), raw=True)
    return [(typical - mean) / (0.015 * spread.where(spread > 0))]


def _adx(x: pd.DataFrame, n: int) -> list[pd.Series]:
    up, down = x["high"].diff(), -x["low"].diff()
    plus, minus = (a.where((a > b) & (a > 0), 0.0).where(up.notna()) for a, b in ((up, down), (down, up)))
    size = _smooth(_true_range(x).where(up.notna()), 1 / n)
    p, m = (100 * _smooth(v, 1 / n) / size.where(size > 0) for v in (plus, minus))
    total = p + m
    dx = (100 * (p - m).abs() / total.where(total > 0)).mask(total == 0, 0.0)
    return [p, m, _smooth(dx, 1 / n)]


_KINDS: dict[str, Callable[[pd.DataFrame, int], list[pd.Series]]] = {
    "MA": lambda x, n: [x["close"].rolling(n).mean()], "EMA": lambda x, n: [_smooth(x["close"], 2 / (n + 1))], "RSI": _rsi, "MACD": _macd, "BOLL": _bollinger, "ATR": _atr, "KDJ": _kdj, "CCI": _cci, "ADX": _adx,
}


def signals(last: dict[str, float | None], before: dict[str, float | None], wanted: list[tuple[str, int]], close: float) -> str:
    """What the last bar's indicators say, joined by commas; empty where nothing is out of the ordinary."""
    out, has = [], lambda *names: all(last.get(c) is not None and last[c] == last[c] for c in names)
    had = lambda *names: all(before.get(c) is not None and before[c] == before[c] for c in names)

    def cross(what: str, fast: str, slow: str) -> None:
        if has(fast, slow) and had(fast, slow):
            if before[fast] <= before[slow] and last[fast] > last[slow]:
                out.append(f"{what} golden cross")
            elif before[fast] >= before[slow] and last[fast] < last[slow]:
                out.append(f"{what} death cross")

    averages = sorted(n for k, n in wanted if k == "MA")
    if len(averages) > 1:
        cross("MA", f"ma{averages[0]}", f"ma{averages[1]}")
    if len(averages) > 2 and has(*(f"ma{n}" for n in averages[:3])):
        a, b, c = (last[f"ma{n}"] for n in averages[:3])
        out += ["bull arrangement"] if a > b > c else ["bear arrangement"] if a < b < c else []
    for kind, n in wanted:
        if kind == "MACD":
            cross("MACD", "dif", "dea")
        elif kind == "RSI" and has(f"rsi{n}"):
            out += ["RSI overbought"] if last[f"rsi{n}"] > 70 else ["RSI oversold"] if last[f"rsi{n}"] < 30 else []
        elif kind == "BOLL" and has(f"upper{n}"):
            out += ["above the upper band"] if close > last[f"upper{n}"] else ["below the lower band"] if close < last[f"lower{n}"] else []
        elif kind == "KDJ" and has(f"k{n}", f"d{n}"):
            out += ["KDJ overbought"] if last[f"k{n}"] > 80 and last[f"d{n}"] > 80 else ["KDJ oversold"] if last[f"k{n}"] < 20 and last[f"d{n}"] < 20 else []
        elif kind == "CCI" and has(f"cci{n}"):
            out += ["CCI strong"] if last[f"cci{n}"] > 100 else ["CCI weak"] if last[f"cci{n}"] < -100 else []
        elif kind == "ADX" and has(f"adx{n}") and last[f"adx{n}"] > 25:
            out.append("ADX strong trend")
    return ",".join(out)


class Indicators:
    """indicators(TABLE(bars) PARTITION BY ... ORDER BY (date), names): the bars' own columns, the indicators', and at the last bar of a series its signals (elsewhere null).

    The table needs open, high, low and close. A series with fewer bars than the indicators need has nulls, no error.
    """

    def __init__(self) -> None:
        self.rows: list = []
        self.names = ""

    @staticmethod
    def analyze(bars: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not bars.isTable:
            raise ValueError("the first argument is a TABLE")
        if names.value is None and not names.isConstantExpression:
            raise ValueError("the names are a constant")
        own = [f for f in bars.dataType.fields]
        missing = {"high", "low", "close"} - {f.name.lower() for f in own}
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        made = [c for kind, n in parsed(names.value) for c in columns(kind, n)]
        return AnalyzeResult(StructType([*own, *(StructField(c, DoubleType()) for c in made), StructField("bar", LongType()), StructField("signals", StringType())]))

    def eval(self, row, names: str):
        self.rows.append(tuple(row))
        self.fields, self.names = row.__fields__, names

    def terminate(self):
        if not self.rows:
            return
        frame = pd.DataFrame(self.rows, columns=self.fields)
        x = frame.rename(columns=str.lower)[["high", "low", "close"]].astype(float)
        wanted = parsed(self.names)
        made = {c: v for kind, n in wanted for c, v in zip(columns(kind, n), _KINDS[kind](x, n), strict=True)}
        values = [[None if v != v else float(v) for v in made[c]] for c in made]
        end = len(frame) - 1
        last, before = ({c: v[i] for c, v in zip(made, values, strict=True)} if i >= 0 else {} for i in (end, end - 1))
        for i, row in enumerate(self.rows):
            yield (*row, *(v[i] for v in values), i + 1, signals(last, before, wanted, float(x["close"].iloc[-1])) if i == end else None)


def register(spark: SparkSession, name: str = "indicators") -> None:
    """Make the function known to the session's SQL."""
    spark.udtf.register(name, udtf(Indicators))
