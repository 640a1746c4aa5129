"""Windows of series for an external trainer: ordered arrays, sampled starts, slices.

A group is one series, so no array is longer than the panel has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.ordering import dense_index, running_total
from demandloom.operators.forecast import CONTEXT_DAYS

# The covariates of a day, and the volume every series has at least.
COVARIATES = ("dow", "dom", "month", "snap", "is_event", "price")
MIN_VOLUME = 0.01
HORIZON = 28

_CELL_BLOCK = 10_000


def covariates() -> Column:
    """The six covariates as one array, in the order of ``COVARIATES``."""
    return F.array(
        F.col("dow") / 7.0,
        F.col("dom") / 31.0,
        F.col("month") / 12.0,
        F.col("snap").cast("double"),
        F.col("is_event").cast("double"),
        F.log1p(F.coalesce("sell_price", F.lit(0.0))),
    )


def blank_after(panel: DataFrame, train_end: int) -> DataFrame:
    """Sales after the cutoff become 0; covariates stay."""
    return panel.withColumn("sales", F.when(F.col("d") <= train_end, F.col("sales")).otherwise(0))


def series_arrays(panel: DataFrame) -> DataFrame:
    """(id, first_day, sales, covs): one row per series, arrays in day order."""
    days = F.array_sort(F.collect_list(F.struct("d", F.col("sales").cast("double").alias("sales"), covariates().alias("covs"))))
    return panel.groupBy("id").agg(days.alias("_days")).select(
        "id",
        F.col("_days")[0]["d"].alias("first_day"),
        F.col("_days.sales").alias("sales"),
        F.col("_days.covs").alias("covs"),
    )


def dense_codes(meta: DataFrame, columns: tuple[str, ...] = ("item_id", "dept_id", "store_id")) -> DataFrame:
    """(id, <column>_code, ...): each key numbered from 0 in sorted order."""
    coded = meta.select("id", *columns)
    for column in columns:
        codes = dense_index(meta.select(column).distinct(), [column], f"{column}_code")
        coded = coded.join(codes, column)
    return coded.select("id", *[f"{c}_code" for c in columns])


def series_weights(panel: DataFrame, train_end: int) -> DataFrame:
    """(id, weight): mean training sales plus a small constant, not yet normalised."""
    trained = panel.where(F.col("d") <= train_end)
    return trained.groupBy("id").agg((F.sum("sales") / F.lit(float(train_end)) + MIN_VOLUME).alias("weight"))


def uniform(seed: int, number: Column) -> Column:
    """A number in [0, 1) that depends on seed and number only: 52 bits of their md5.

    A lost task draws the same again, and so does any other engine.
    """
    text = F.concat(F.lit(f"{seed}:"), number.cast("string"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10)
    return bits.cast("double") / float(2**52)


def _unit_cells(spans: DataFrame) -> DataFrame:
    """One row per whole number a span [_begin, _end] touches, as ``_cell``.

    In two steps with a shuffle between them, so that a series that takes a
    third of all draws is spread over the tasks.
    """
    first, last = F.floor(F.col("_begin")), F.floor(F.col("_end"))
    blocks = spans.withColumn("_block", F.explode(F.sequence(F.floor(first / _CELL_BLOCK), F.floor(last / _CELL_BLOCK))))
    low = F.greatest(first, F.col("_block") * _CELL_BLOCK)
    high = F.least(last, F.col("_block") * _CELL_BLOCK + _CELL_BLOCK - 1)
    return blocks.repartition("_block", "id").withColumn("_cell", F.explode(F.sequence(low, high))).drop("_block")


def sample_windows(
    weights: DataFrame, n_windows: int, train_end: int, context: int = CONTEXT_DAYS, horizon: int = HORIZON, seed: int = 42
) -> DataFrame:
    """(draw, id, start): ``n_windows`` draws with replacement, a series in proportion to its weight.

    ``start`` counts the days before the first target day, uniform in
    [context, train_end - horizon). The weights are laid end to end on
    [0, n_windows), and each draw falls on one of them. Draws and series meet
    by an equi-join on the unit interval they touch, which holds one draw and
    the series starting in it on average.
    """
    whole = weights.agg(F.sum("weight")).scalar()
    scaled = weights.withColumn("_width", F.col("weight") / whole * n_windows)
    laid = running_total(scaled, ["id"], F.col("_width"), "_end")
    cells = _unit_cells(laid.withColumn("_begin", F.col("_end") - F.col("_width")).select("id", "_begin", "_end"))
    draws = weights.sparkSession.range(n_windows).select(
        F.col("id").alias("draw"), (uniform(seed, F.col("id")) * n_windows).alias("_at")
    )
    draws = draws.withColumn("_cell", F.floor("_at"))
    hit = draws.join(cells, "_cell").where((F.col("_begin") <= F.col("_at")) & (F.col("_at") < F.col("_end")))
    room = train_end - horizon - context
    offset = F.floor(uniform(seed + 1, F.col("draw")) * room).cast("int")
    return hit.select("draw", "id", (F.lit(context) + offset).alias("start"))


def cut_windows(arrays: DataFrame, draws: DataFrame, context: int = CONTEXT_DAYS, horizon: int = HORIZON) -> DataFrame:
    """Slices around each start: past and future, sales scaled by nu = 1 + mean(past)."""
    joined = draws.join(arrays, "id")
    begin = F.col("start") - context + 1
    cut = joined.select(
        *draws.columns,
        F.slice("sales", begin, context).alias("past"),
        F.slice("sales", F.col("start") + 1, horizon).alias("target"),
        F.slice("covs", begin, context).alias("past_covs"),
        F.slice("covs", F.col("start") + 1, horizon).alias("future_covs"),
    )
    total = F.aggregate("past", F.lit(0.0), lambda acc, x: acc + x)
    return cut.withColumn("nu", 1 + total / context).withColumn(
        "past_scaled", F.transform("past", lambda x: x / F.col("nu"))
    )


def inference_windows(arrays: DataFrame, train_end: int, context: int = CONTEXT_DAYS, horizon: int = HORIZON) -> DataFrame:
    """The window of every series whose target starts right after the cutoff."""
    starts = arrays.select("id", F.lit(train_end).alias("start"))
    return cut_windows(arrays, starts, context, horizon)
