"""Scalar expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """x held within low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function: its Taylor-like series phi(x) * (x + x^3/3 + x^5/15 + ...) + 1/2 in the middle, and the
    continued fraction of the tail beyond 3; better than 1e-12. Each is a fold over a short sequence, so plans stay small."""
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")), lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum")), lambda s: 0.5 + s["sum"] * normal_pdf(x))
    a = F.abs(x)
    tail = normal_pdf(x) / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda f, k: a + k / f)
    return F.when(a <= 3, near).when(x > 0, 1 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def compare(left: Column, operator: Column, right: Column) -> Column:
    """A comparison whose operator is data; an unknown operator, or a null, gives false."""
    out = (
        F.when(operator == ">", left > right)
        .when(operator == ">=", left >= right)
        .when(operator == "<", left < right)
        .when(operator == "<=", left <= right)
        .when(operator == "==", left == right)
        .when(operator == "!=", left != right)
    )
    return F.coalesce(out, F.lit(False))


def squash(x: Column, scale: float) -> Column:
    """tanh(x / scale)."""
    return F.tanh(x / scale)
