"""Running totals and dense numbers over a whole table without a single-task sort.

The table is range-partitioned by the order columns and checkpointed, which
fixes its partitions. Each partition is totalled on its own; only one row per
partition is needed to shift the partitions against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import cut_lineage


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to and including this one.

    ``order`` must identify a row, else the order among equals is arbitrary.
    """
    placed = cut_lineage(df.withColumn("_value", value).repartitionByRange(*order))
    placed = placed.withColumn("_part", F.spark_partition_id())
    totals = placed.groupBy("_part").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
        .drop("_part", "_value", "_offset")
    )


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order."""
    numbered = running_total(df, order, F.lit(1).cast("long"), name)
    return numbered.withColumn(name, F.col(name) - 1)
