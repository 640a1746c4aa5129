"""Exploratory tables: daily totals, seasonality, events, intermittency, exemplars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import selection
from demandloom.functions.windows import by_series, ratio, share
from demandloom.operators.price import PROMO_THRESHOLD
from demandloom.session import cut_lineage

# Fixed values.
CENTRED_DAYS = 28
EVENT_DAYS = 7
HISTOGRAM_BINS = 40
PROMO_MIN_BASE = 2.0
PROMO_DAYS = (30, 400)
PROMO_MIN_PRICE = 3.0


def daily_totals(panel: DataFrame) -> DataFrame:
    """(date, sales, dow, month): one row per day."""
    daily = panel.groupBy("date").agg(F.sum("sales").alias("sales"))
    return daily.withColumns({"dow": F.weekday("date"), "month": F.month("date")})


def _is_christmas() -> Column:
    return (F.month("date") == 12) & (F.dayofmonth("date") == 25)


def smoothed_totals(daily: DataFrame, days: int = CENTRED_DAYS) -> DataFrame:
    """The centred mean of the daily totals, null where the window is not full.

    An even window reaches one day further back than ahead. Each day hands its
    total to the days whose window it is in, so the days are not lined up in one
    task.
    """
    behind, ahead = days // 2, days - days // 2 - 1
    reach = F.explode(F.sequence(F.lit(-ahead), F.lit(behind)))
    parts = daily.select(F.col("date").alias("_from"), "sales", reach.alias("_off"))
    means = parts.groupBy(F.date_add("_from", F.col("_off")).alias("date")).agg(
        F.sum("sales").alias("_sum"), F.count("*").alias("_n")
    )
    mean = F.when(F.col("_n") == days, F.col("_sum") / F.lit(float(days)))
    return daily.join(means, "date").select(
        "date", "sales", mean.alias("centred_mean"), _is_christmas().cast("int").alias("is_christmas")
    )


def mean_by(daily: DataFrame, part: str) -> DataFrame:
    """Mean daily total per weekday (``dow``) or ``month``."""
    return daily.groupBy(part).agg(F.avg("sales").alias("mean_sales"))


def flag_effect(panel: DataFrame, by: Sequence[str] = ("state_id",)) -> DataFrame:
    """(*by, mean_off, mean_on, lift_pct): sales on days with and without the state's flag."""
    means = panel.groupBy(*by).agg(
        F.avg(F.when(F.col("snap") == 0, F.col("sales"))).alias("mean_off"),
        F.avg(F.when(F.col("snap") == 1, F.col("sales"))).alias("mean_on"),
    )
    return means.withColumn("lift_pct", 100 * (ratio(F.col("mean_on"), F.col("mean_off")) - 1))


def event_windows(panel: DataFrame, daily: DataFrame, names: Sequence[str], reach: int = EVENT_DAYS) -> DataFrame:
    """(event_name, offset, mean_sales) around the named events; complete windows only."""
    dates = panel.where(F.col("event_name_1").isin(*names)).select(F.col("event_name_1").alias("event_name"), F.col("date").alias("_event")).distinct()
    around = dates.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    seen = around.withColumn("date", F.date_add("_event", F.col("offset"))).join(daily.select("date", "sales"), "date")
    # a window holds 2 * reach + 1 days
    windows = seen.groupBy("event_name", "_event").agg(F.collect_list(F.struct("offset", "sales")).alias("_days"))
    full = windows.where(F.size("_days") == 2 * reach + 1).select("event_name", F.inline("_days"))
    return full.groupBy("event_name", "offset").agg(F.avg("sales").alias("mean_sales"))


def zero_fractions(panel: DataFrame) -> DataFrame:
    """(id, zero_frac)."""
    return panel.groupBy("id").agg(F.avg((F.col("sales") == 0).cast("double")).alias("zero_frac"))


def zero_histogram(fractions: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, n_series): equal bins from the smallest to the largest fraction, the last one closed."""
    span = fractions.agg(F.struct(F.min("zero_frac").alias("lo"), F.max("zero_frac").alias("hi"))).scalar()
    width = F.col("_span.hi") - F.col("_span.lo")
    place = F.coalesce(F.floor((F.col("zero_frac") - F.col("_span.lo")) / F.nullif(width, F.lit(0.0)) * bins), F.lit(bins // 2))
    return (
        fractions.withColumn("_span", span)
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n_series"))
    )


def median_zero_fraction(fractions: DataFrame) -> DataFrame:
    """One row, ``median_zero_frac``, from (id, zero_frac) by distributed selection."""
    kept = cut_lineage(fractions.select("zero_frac"))
    return kept.sparkSession.createDataFrame([(selection.median(kept, "zero_frac"),)], "median_zero_frac double")


def store_category_means(panel: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """(store_id, one mean column per category): those given, or all of the table, which are as many columns."""
    if categories is None:
        categories = sorted(r[0] for r in panel.select("cat_id").distinct().dropna().collect())
    return panel.groupBy("store_id").pivot("cat_id", list(categories)).agg(F.avg("sales"))


def promo_candidates(panel: DataFrame) -> DataFrame:
    """(id, base, promo, promo_days, median_price, lift) of series that sell, cost and promote enough.

    A promotion day is priced below 85 % of the series' own median price.
    """
    offered = panel.where(F.col("sell_price").isNotNull()).select("id", "sales", "sell_price")
    medians = offered.groupBy("id").agg(F.percentile("sell_price", 0.5).alias("median_price"))
    cheap = F.col("sell_price") < PROMO_THRESHOLD * F.col("median_price")
    sums = offered.join(medians, "id").groupBy("id").agg(
        F.avg(F.when(~cheap, F.col("sales"))).alias("base"),
        F.avg(F.when(cheap, F.col("sales"))).alias("promo"),
        F.count_if(cheap).alias("promo_days"),
        F.max("median_price").alias("median_price"),
    )
    fit = (
        (F.col("base") >= PROMO_MIN_BASE)
        & F.col("promo_days").between(*PROMO_DAYS)
        & (F.col("median_price") >= PROMO_MIN_PRICE)
    )
    return sums.where(fit).withColumn("lift", F.col("promo") / F.col("base"))


def promo_exemplar(panel: DataFrame) -> DataFrame:
    """The candidate with the largest lift, ties by id."""
    return promo_candidates(panel).orderBy(F.desc("lift"), "id").limit(1)


def series_view(panel: DataFrame, series: DataFrame, days: int = 7) -> DataFrame:
    """(id, date, centred_mean, sell_price) of the series listed in ``series`` (id)."""
    order = by_series().rowsBetween(-(days // 2), days // 2)
    chosen = panel.join(series.select("id"), "id", "left_semi")
    full = F.count("sales").over(order) == days
    return chosen.select("id", "date", F.when(full, F.avg("sales").over(order)).alias("centred_mean"), "sell_price")


def headline(panel: DataFrame) -> DataFrame:
    """One row: zero fractions, weekend lift over Tuesday and Wednesday, Christmas against an average day."""
    zeros = panel.groupBy("id").agg(F.count_if(F.col("sales") == 0).alias("_z"), F.count("*").alias("_n"))
    zeros = cut_lineage(zeros.withColumn("_share", F.col("_z") / F.col("_n")))
    middle = selection.median(zeros, "_share")
    per_series = zeros.agg(
        F.round(share(F.sum("_z"), F.sum("_n")), 4).alias("zero_sales_frac"),
        F.round(F.lit(middle).cast("double"), 4).alias("median_series_zero_frac"),
    )
    daily = daily_totals(panel)
    per_day = daily.agg(
        F.avg(F.when(F.col("dow") >= 5, F.col("sales"))).alias("weekend"),
        F.avg(F.when(F.col("dow").isin(1, 2), F.col("sales"))).alias("midweek"),
        F.avg(F.when(_is_christmas(), F.col("sales"))).alias("xmas"),
        F.avg("sales").alias("day"),
    )
    days = per_day.select(F.struct("*")).scalar()
    return per_series.withColumn("_days", days).select(
        "zero_sales_frac",
        "median_series_zero_frac",
        F.round(ratio(F.col("_days.weekend"), F.col("_days.midweek")) - 1, 4).alias("weekend_vs_midweek_lift"),
        F.round(ratio(F.col("_days.xmas"), F.col("_days.day")), 4).alias("christmas_vs_avg_day"),
    )
