"""Window expressions over a series: lags, full-window statistics, drawdowns, streaks."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def back(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The n rows that end ``skip`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def full(stat: Column, n: int, w: WindowSpec, of: Column, skip: int = 0) -> Column:
    """A statistic over the last n rows, null until there are n values of ``of``."""
    frame = back(w, n, skip)
    return F.when(F.count(of).over(frame) == n, stat.over(frame))


def sma(x: str, n: int, w: WindowSpec) -> Column:
    return full(F.avg(x), n, w, F.col(x))


def pct_change(x: str, k: int, w: WindowSpec) -> Column:
    """x over its value k rows before, less 1; null where that is missing or 0."""
    was = F.lag(x, k).over(w)
    return F.when(was != 0, F.col(x) / was - 1)


def drawdown(x: str, w: WindowSpec) -> Column:
    """x over its running maximum, less 1."""
    return F.col(x) / F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def crossed(fast: str, slow: str, w: WindowSpec) -> Column:
    """golden where fast passes above slow, death where it passes below, else none."""
    was_fast, was_slow = F.lag(fast).over(w), F.lag(slow).over(w)
    return F.when((was_fast <= was_slow) & (F.col(fast) > F.col(slow)), "golden").when((was_fast >= was_slow) & (F.col(fast) < F.col(slow)), "death").otherwise("none")


def rank_share(value: str, w: WindowSpec, n: Column) -> Column:
    """The place in w's order as a share of the others, from 0; 1 where there is one row only."""
    return F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1)).otherwise(F.lit(1.0))


def carried_forward(x: str, limit: int, w: WindowSpec) -> Column:
    """x, or its last value within ``limit`` rows before."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def running_product(x: Column, w: WindowSpec) -> Column:
    """The product of x up to each row, with its sign: summed logs of the sizes, 0 from the first 0 on; nulls are passed over."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.sum((x < 0).cast("int")).over(so_far) % 2 == 1, -1.0).otherwise(1.0)
    size = F.exp(F.sum(F.when(x != 0, F.log(F.abs(x)))).over(so_far))
    return F.when(F.max((x == 0).cast("int")).over(so_far) == 1, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0)))
