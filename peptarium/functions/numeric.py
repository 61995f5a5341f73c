"""Numeric coercion and small numeric expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def num(c: str | Column) -> Column:
    """Double, with text that is no number and NaN both folded to null."""
    value = as_col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def log10_1p(c: str | Column) -> Column:
    return F.log10(F.lit(1.0) + num(c))


def log_enrichment(signal: str | Column, baseline: str | Column) -> Column:
    return log10_1p(signal) - log10_1p(baseline)


def logistic(x: Column, midpoint: Column | float, k: float, sign: float = 1.0, clip: float | None = None) -> Column:
    """``1 / (1 + exp(sign·k·(x − midpoint)))``; ``clip`` bounds the exponent."""
    z = F.lit(sign * k) * (x - (midpoint if isinstance(midpoint, Column) else F.lit(float(midpoint))))
    if clip is not None:
        # greatest/least skip nulls, so a null exponent must stay null by hand
        z = F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z))
