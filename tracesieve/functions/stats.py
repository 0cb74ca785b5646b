"""Rates, intervals and percentiles as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: normal quantiles of the two interval variants
Z_EXACT = 1.959963984540054
Z_SHORT = 1.96


def ratio(k: Column, n: Column, empty: float = 0.0) -> Column:
    """k / n as double, ``empty`` where n is 0."""
    return F.when(n > 0, k.cast("double") / n.cast("double")).otherwise(F.lit(empty))


def rounded(c: Column, digits: int) -> Column:
    """A double rounded half away from zero after scaling in doubles, as SQL engines do: 0.1234525 gives 0.123453 although it lies just below.

    `F.round` rounds the shortest decimal form of the unscaled value and gives 0.123452 where that form is 0.12345249999999999.
    """
    scale = F.lit(10.0 ** digits)
    return F.round(c * scale, 0) / scale


def wilson(k: Column, n: Column, z: float = Z_EXACT, empty: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """Lower and upper Wilson score bound, clamped to [0, 1] and unrounded."""
    nn = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / nn
    z2 = z * z
    denom = F.lit(1.0) + F.lit(z2) / nn
    centre = (p + F.lit(z2) / (F.lit(2.0) * nn)) / denom
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / nn + F.lit(z2) / (F.lit(4.0) * nn * nn)) / denom
    # least/greatest skip NULL, so the empty case needs its own branch
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(F.lit(empty[0]))
    high = F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(F.lit(empty[1]))
    return low, high


def f1(precision: Column, recall: Column) -> Column:
    s = precision + recall
    return F.when(s > 0, F.lit(2.0) * precision * recall / s).otherwise(F.lit(0.0))
