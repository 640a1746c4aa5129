"""Backtest folds, point and quantile metrics, and the weighted scaled error."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.windows import ratio
from demandloom.operators.hierarchy import LEVELS, Level, aggregate
from demandloom.operators.panel import day_slice

# Fixed value: revenue of the last training days weighs the nodes.
REVENUE_DAYS = 28


@dataclass(frozen=True)
class Fold:
    fold_id: int
    train_end: int
    test_start: int
    test_end: int


def expanding_folds(n_folds: int, horizon: int, last_train_day: int) -> list[Fold]:
    """Adjacent test blocks of ``horizon`` days that end at ``last_train_day``, oldest first."""
    first_end = last_train_day - n_folds * horizon
    cuts = [first_end + horizon * k for k in range(n_folds)]
    return [Fold(k, cut, cut + 1, cut + horizon) for k, cut in enumerate(cuts, start=1)]


def folds_table(panel: DataFrame, n_folds: int, horizon: int) -> DataFrame:
    """The folds that end at the panel's own last day, as rows."""
    last = panel.agg(F.max("d").alias("_last"))
    numbered = last.withColumn("fold_id", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    cut = F.col("_last") - (F.lit(n_folds) - F.col("fold_id") + 1) * horizon
    return numbered.select(
        "fold_id", cut.alias("train_end"), (cut + 1).alias("test_start"), (cut + horizon).alias("test_end")
    )


def _matched(preds: DataFrame, actuals: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per prediction key with how often the key occurs on either side."""
    truth = actuals.groupBy("id", "d").agg(F.max("sales").alias("sales"), F.count("*").alias("_truths"))
    joined = preds.join(truth, ["id", "d"], "left")
    return joined.groupBy("id", "d", *by).agg(
        F.max("yhat").alias("yhat"),
        F.max("sales").alias("sales"),
        F.count("*").alias("_preds"),
        F.max("_truths").alias("_truths"),
    )


def point_metrics(preds: DataFrame, actuals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, mae, rmse, wape, bias, n).

    Predictions and actuals must match one to one; the job fails with counts of
    what does not. Bias is positive when the forecast is too high.
    """
    error = F.col("yhat") - F.col("sales")
    keys = _matched(preds, actuals, by)
    totals = keys.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        ratio(F.sum(F.abs(error)), F.sum("sales")).cast("double").alias("wape"),
        F.avg(error).alias("bias"),
        F.count("*").alias("n"),
        F.count_if(F.col("_truths").isNull()).alias("_unmatched"),
        F.count_if((F.col("_preds") > 1) | (F.col("_truths") > 1)).alias("_repeated"),
    )
    message = F.format_string("%d predictions without an actual, %d repeated keys", "_unmatched", "_repeated")
    checked = F.when((F.col("_unmatched") > 0) | (F.col("_repeated") > 0), F.raise_error(message))
    return totals.select(
        *by, "mae", "rmse", "wape", "bias", F.coalesce(checked.cast("long"), F.col("n")).alias("n")
    )


def mean_over_folds(metrics: DataFrame) -> DataFrame:
    """(model, mae, rmse, wape, bias), best WAPE first, ties by model."""
    names = ["mae", "rmse", "wape", "bias"]
    return metrics.groupBy("model").agg(*[F.avg(n).alias(n) for n in names]).orderBy("wape", "model")


def pinball(actual: Column, predicted: Column, q: Column) -> Column:
    """Quantile loss of one row: missing low costs q, missing high costs 1 - q."""
    miss = actual - predicted
    return F.greatest(q * miss, (q - 1) * miss)


def quantile_report(quantiles: DataFrame, actuals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, q, pinball, coverage) from quantile rows (id, d, q, yhat_q).

    The job fails on a quantile row without an actual, as ``point_metrics`` does.
    """
    truth = actuals.select("id", "d", "sales", F.lit(True).alias("_known"))
    totals = quantiles.join(truth, ["id", "d"], "left").groupBy(*by, "q").agg(
        F.avg(pinball(F.col("sales"), F.col("yhat_q"), F.col("q"))).alias("pinball"),
        F.avg((F.col("sales") <= F.col("yhat_q")).cast("double")).alias("coverage"),
        F.count_if(F.col("_known").isNull()).alias("_unmatched"),
    )
    refused = F.raise_error(F.format_string("%d quantile rows without an actual", "_unmatched")).cast("double")
    checked = [F.when(F.col("_unmatched") > 0, refused).otherwise(F.col(name)).alias(name) for name in ("pinball", "coverage")]
    return totals.select(*by, "q", *checked)


def mean_pinball(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return report.groupBy(*by).agg(F.avg("pinball").alias("mean_pinball"))


def naive_scale(node_history: DataFrame, value: str = "sales", exclude_days: DataFrame | None = None) -> DataFrame:
    """(level, key, scale): mean squared daily change after the first sale.

    0 for a node that never sold. A single window pass per node: a change counts
    once an earlier day of the node has sold. ``exclude_days`` (d) drops the
    changes into the given days.
    """
    order = Window.partitionBy("level", "key").orderBy("d")
    sold_before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0
    change = F.col(value) - F.lag(value).over(order)
    steps = node_history.select("level", "key", "d", F.when(sold_before, change * change).alias("_sq"))
    if exclude_days is not None:
        skipped = exclude_days.select("d").distinct().withColumn("_skip", F.lit(True))
        steps = steps.join(skipped, "d", "left").withColumn("_sq", F.when(F.col("_skip").isNull(), F.col("_sq")))
    return steps.groupBy("level", "key").agg(F.coalesce(F.avg("_sq"), F.lit(0.0)).alias("scale"))


def leaf_revenue(panel: DataFrame, train_end: int, days: int = REVENUE_DAYS, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(*keys, revenue) over the last ``days`` training days; no price counts as 0.

    A series needs a row on any of these days, not on ``train_end``. One without has no revenue.
    """
    recent = day_slice(panel, train_end - days + 1, train_end)
    return recent.groupBy(*keys).agg(F.sum(F.col("sales") * F.coalesce("sell_price", F.lit(0.0))).alias("revenue"))


def level_weights(revenue: DataFrame, levels: Sequence[Level] = LEVELS) -> DataFrame:
    """(level, key, weight): revenue share inside the level, each level worth 1/n.

    ``revenue`` has one row per leaf with the key columns.
    """
    per_node = aggregate(revenue, ["revenue"], (), levels)
    # every level holds every leaf once, so all levels have the same revenue
    whole = revenue.agg(F.sum("revenue").cast("double")).scalar()
    return per_node.withColumn("_whole", whole).select(
        "level", "key", F.coalesce(ratio(F.col("revenue"), F.col("_whole")) / len(levels), F.lit(0.0)).alias("weight")
    )


def node_rmsse(
    leaves: DataFrame, scales: DataFrame, by: Sequence[str] = (), levels: Sequence[Level] = LEVELS
) -> DataFrame:
    """(*by, level, key, rmsse) from leaf rows with key columns, d, yhat and sales.

    Forecast and actual are summed up the levels together. A node with scale 0,
    or without any history, has rmsse 0.
    """
    filled = leaves.withColumn("yhat", F.coalesce("yhat", F.lit(0.0)))
    per_node = aggregate(filled, ["yhat", "sales"], (*by, "d"), levels)
    error = F.col("yhat") - F.col("sales")
    mse = per_node.groupBy(*by, "level", "key").agg(F.avg(error * error).alias("_mse"))
    joined = mse.join(scales, ["level", "key"], "left")
    return joined.select(
        *by, "level", "key",
        F.when(F.col("scale") > 0, F.sqrt(ratio(F.col("_mse"), F.col("scale")))).otherwise(0.0).alias("rmsse"),
    )


def weighted_rmsse(
    rmsse: DataFrame, weights: DataFrame, by: Sequence[str] = (), levels: Sequence[Level] = LEVELS
) -> DataFrame:
    """(*by, level, wrmsse): one row per level and one, ``overall``, for all of them.

    A level's row is scaled by the number of levels, so that it reads as the
    level's own score; the overall score is the mean of the levels' scores.
    """
    joined = rmsse.join(weights, ["level", "key"])
    whole = F.grouping("level") == 1
    score = F.sum(F.col("weight") * F.col("rmsse"))
    sums = joined.groupingSets([[*by, "level"], [*by]], *by, "level").agg(score.alias("_score"), whole.alias("_whole"))
    return sums.select(
        *by,
        F.when(F.col("_whole"), "overall").otherwise(F.col("level")).alias("level"),
        F.when(F.col("_whole"), F.col("_score")).otherwise(F.col("_score") * len(levels)).alias("wrmsse"),
    )
