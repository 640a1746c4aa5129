"""Exact order statistics of a whole column without a sort in one task.

The values are counted by equal buckets of the range that still holds the wanted rank; the bucket with the rank, tightened
to its own smallest and largest value, is the next range. A few rounds leave one value, or few enough to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
# So many values of the last range are read by the driver.
READ_ROWS = 1000


def order_statistic(df: DataFrame, column: str, rank: int, buckets: int = BUCKETS, read_rows: int = READ_ROWS) -> float:
    """The value at ``rank`` (from 0) of the non-null values in rising order. ``df`` is read once per round."""
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 0 <= rank < n:
        raise ValueError(f"rank {rank} of {n} values")
    while low < high:
        inside = values.where(F.col("v").between(low, high))
        if n <= read_rows:
            return sorted(r[0] for r in inside.collect())[rank]
        # halves first, so that the width of the range itself cannot overflow
        share = (F.col("v") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("bucket")
        counted = inside.groupBy(bucket).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        for r in sorted(counted.collect()):
            if rank < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            rank -= r["n"]
    return low


def median(df: DataFrame, column: str) -> float | None:
    """The mean of the two middle values; None without values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    upper = order_statistic(df, column, n // 2)
    return upper if n % 2 else (order_statistic(df, column, n // 2 - 1) + upper) / 2
