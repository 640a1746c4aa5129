"""Window helpers on the integer day ``d``.

All frames are RANGE frames over ``d``, so a missing day shifts nothing, and all
use the same partitioning and ordering, so one shuffle on ``id`` serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_series() -> WindowSpec:
    return Window.partitionBy("id").orderBy("d")


def at_lag(value: str, lag: int) -> Column:
    """The value exactly ``lag`` days ago; null when that day has no row."""
    return F.max(value).over(by_series().rangeBetween(-lag, -lag))


def up_to(lag: int) -> WindowSpec:
    """Everything up to ``lag`` days ago. Grows row by row, so it costs O(1) per row."""
    return by_series().rangeBetween(Window.unboundedPreceding, -lag)


def trailing(days: int, shift: int) -> WindowSpec:
    """The ``days`` days that end ``shift`` days ago."""
    return by_series().rangeBetween(-(shift + days - 1), -shift)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error, on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return ratio(F.lit(float(scale)) * part, whole.cast("double"))
