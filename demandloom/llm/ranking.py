"""Ranks and running totals inside groups of any size, a hot group included.

Rows are range-partitioned by group and order and written, which fixes their parts. Each part
is totalled on its own; one row per part and group shifts the parts against each other, so no task
ever holds more of a group than one part of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.tables import stage

PART = "_part"


def place(df: DataFrame, group: str, order: Sequence[str], values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with their part, one row per group and part).

    The second has for each name in ``values`` the total ``<name>_before`` of the group's earlier parts and
    ``<name>_all`` of the whole group. ``order`` should identify a row; rows that tie may come in any order.
    """
    valued = df.withColumns({f"_{name}": value for name, value in values.items()})
    placed = stage(valued.repartitionByRange(group, *order).withColumn(PART, F.spark_partition_id()))
    sums = placed.groupBy(group, PART).agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in values])
    whole = Window.partitionBy(group)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = []
    for name in values:
        shifts.append(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).cast("long").alias(f"{name}_before"))
        shifts.append(F.sum(f"_{name}").over(whole).cast("long").alias(f"{name}_all"))
    return placed, stage(sums.select(group, PART, *shifts))


def number(placed: DataFrame, offsets: DataFrame, group: str, order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Every placed row with ``<name>_before`` (the total of all rows of its group before it) and the other columns of ``offsets``."""
    inside = Window.partitionBy(group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(offsets, [group, PART])
    shifted = {
        f"{name}_before": F.col(f"{name}_before") + F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in names
    }
    return met.withColumns(shifted).drop(PART, *[f"_{name}" for name in names])


def running(df: DataFrame, group: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with ``<name>_before`` and ``<name>_all`` inside each group, for every name in ``values``."""
    placed, offsets = place(df, group, order, values)
    return number(placed, offsets, group, order, list(values))
