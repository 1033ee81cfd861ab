"""Small statistics used by rule mining."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.text import _col


def ratio(numerator, denominator) -> Column:
    """Quotient, null on a zero denominator."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d != 0, n.cast("double") / d)


def wilson_lower(successes, total, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval, 0 for an empty sample."""
    s, n = _col(successes).cast("double"), _col(total).cast("double")
    p, z2 = s / n, z * z
    margin = F.sqrt((p * (1.0 - p) + z2 / (4.0 * n)) / n) * z
    bound = (p + z2 / (2.0 * n) - margin) / (z2 / n + 1.0)
    return F.when(n > 0, F.greatest(F.lit(0.0), bound)).otherwise(F.lit(0.0))


def promotion_ready(support, precision, wilson, batches) -> Column:
    """Fixed thresholds of an automation-ready rule."""
    return (_col(support) >= 6) & (_col(precision) >= 0.95) & (_col(wilson) >= 0.60) & (_col(batches) >= 3)
