"""Joins with a table that is expected, but not known, to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup of this many narrow rows is a few megabytes.
MAX_BROADCAST_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, on: list[str], max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left join that broadcasts ``small`` once a count has shown it to be small.

    Without the count the optimizer has to shuffle ``big`` before it learns the
    size of an aggregated ``small``. A larger ``small`` is joined by shuffling.
    """
    fits = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if fits else small, on, "left")
