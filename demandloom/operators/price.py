"""Price and promotion features. Prices are known in advance; medians trail only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.windows import at_lag, ratio

# Fixed values.
PROMO_THRESHOLD = 0.85
MEDIAN_WEEKS = 52
MEDIAN_MIN_WEEKS = 4


def weekly_prices(df: DataFrame) -> DataFrame:
    """One row per (id, week) with a price: that of the week's first priced day."""
    priced = df.where(F.col("sell_price").isNotNull())
    return priced.groupBy("id", "wm_yr_wk").agg(F.min_by("sell_price", "d").alias("sell_price"))


def _median_window(*extra: str):
    return Window.partitionBy("id", *extra).orderBy("wm_yr_wk").rowsBetween(1 - MEDIAN_WEEKS, 0)


def weekly_trailing_median(weekly: DataFrame) -> DataFrame:
    """Median over the last 52 offered weeks, this one included; null below 4 weeks."""
    window = _median_window()
    return weekly.withColumn(
        "trail_med",
        F.when(F.count("sell_price").over(window) >= MEDIAN_MIN_WEEKS, F.percentile("sell_price", 0.5).over(window)),
    )


def trailing_median(df: DataFrame) -> DataFrame:
    """``trail_med`` on every day of a priced week, at no extra shuffle.

    The first priced day of each week stands for the week. These days form a
    window of their own in each series, and a second window spreads the median
    over the week. Both are satisfied by the partitioning on ``id``, where a
    join with the weekly table would shuffle the panel on (id, week).
    """
    week = Window.partitionBy("id", "wm_yr_wk")
    first_day = F.min(F.when(F.col("sell_price").isNotNull(), F.col("d"))).over(week)
    marked = df.withColumn("_first", first_day).withColumn(
        "_stands", F.coalesce(F.col("d") == F.col("_first"), F.lit(False))
    )
    weekly = marked.withColumn("_week_price", F.when(F.col("_stands"), F.col("sell_price")))
    window = _median_window("_stands")
    median = F.when(
        F.count("_week_price").over(window) >= MEDIAN_MIN_WEEKS, F.percentile("_week_price", 0.5).over(window)
    )
    return (
        weekly.withColumn("_median", median)
        .withColumn("trail_med", F.max("_median").over(week))
        .drop("_first", "_stands", "_week_price", "_median")
    )


def week_change(df: DataFrame) -> DataFrame:
    """``price_chg_7``: price against that of seven days ago."""
    return df.withColumn("_before", at_lag("sell_price", 7)).withColumn(
        "price_chg_7", ratio(F.col("sell_price"), F.col("_before")) - 1
    ).drop("_before")


def promotion(df: DataFrame, threshold: float = PROMO_THRESHOLD) -> DataFrame:
    """``price_rel_med`` and the ``is_promo`` flag below ``threshold``."""
    return (
        trailing_median(df)
        .withColumn("price_rel_med", ratio(F.col("sell_price"), F.col("trail_med")))
        .withColumn("is_promo", F.coalesce(F.col("price_rel_med") < threshold, F.lit(False)).cast("int"))
        .drop("trail_med")
    )


def shelf_price(df: DataFrame) -> DataFrame:
    """``price_rel_dept``: price against the mean of its store, department and day.

    The means are folded before they are shuffled and joined back, so a shelf
    that holds most of the items is never gathered in one place, and its rows
    can be split over several tasks of the join. The one price feature that
    shuffles on other keys than ``id``: run it first, on the narrow panel.
    """
    shelf = ["store_id", "dept_id", "d"]
    means = df.where(F.col("sell_price").isNotNull()).groupBy(*shelf).agg(F.avg("sell_price").alias("_shelf"))
    joined = df.join(means, shelf, "left")
    return joined.select(*df.columns, ratio(F.col("sell_price"), F.col("_shelf")).alias("price_rel_dept"))


def price_features(df: DataFrame) -> DataFrame:
    return promotion(week_change(shelf_price(df)))
