"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: Column, digits: int) -> Column:
    """Rounds a double half away from zero on the scaled value, bit for bit as floor(|x| 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def half_away_sql(x: str, digits: int) -> str:
    """The same in SQL."""
    return f"(sign({x}) * floor(abs({x}) * 1e{digits} + 0.5) / 1e{digits})"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]
