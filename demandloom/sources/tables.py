"""Parquet tables: panel, features by store, forecasts and metrics by model and fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demandloom.operators.panel import BLOCK, check_observed, day_block, observed_rules

RUN_KEYS = ["model", "fold"]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Only the named columns are read from disk."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def write_panel(panel: DataFrame, path: str) -> None:
    """The panel in blocks of days, so that a read of recent days opens few folders.

    Tasks hold whole series and write their days to one file per block; nothing
    is shuffled, and rows are sorted by the block number only. For files in
    strict (id, d) order pass ``operators.panel.clustered(panel)``.
    """
    write_table(panel.withColumn(BLOCK, day_block(F.col("d"))), path, [BLOCK])


def write_checked_panel(panel: DataFrame, path: str, n_series: int, n_days: int) -> DataFrame:
    """Write the panel and check it in the same pass; the summary row.

    The rules are observed on the rows as they are written. A panel that breaks some raises PanelError with all of them; what was
    written then is not to be used.
    """
    seen = Observation()
    write_panel(panel.observe(seen, *observed_rules()), path)
    kinds = "rows long, series long, days long, date_range string, zero_sales_frac double, price_missing_frac double"
    row = panel.sparkSession.createDataFrame([check_observed(seen.get, n_series, n_days)], kinds)
    return row.withColumns({c: F.round(c, 4) for c in ("zero_sales_frac", "price_missing_frac")})


def write_features(features: DataFrame, path: str) -> None:
    """One folder per store and block of days, in a single job.

    The rebalance hint gives each folder few files and still splits a folder that
    holds most of the rows over several tasks.
    """
    blocked = features.withColumn(BLOCK, day_block(F.col("d")))
    placed = blocked.hint("rebalance", F.col("store_id"), F.col(BLOCK)).sortWithinPartitions("store_id", BLOCK, "id", "d")
    write_table(placed, path, ["store_id", BLOCK])


def read_features(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    min_day: int | None = None,
    stores: Sequence[str] | None = None,
) -> DataFrame:
    """Stores and the blocks before ``min_day`` prune folders, ``columns`` prune the rest."""
    table = spark.read.parquet(path)
    if stores is not None:
        table = table.where(F.col("store_id").isin(*stores))
    if min_day is not None:
        table = table.where((F.col(BLOCK) >= day_block(F.lit(min_day))) & (F.col("d") >= min_day))
    return table.select(*columns) if columns else table.drop(BLOCK)


def _write_runs(df: DataFrame, path: str) -> None:
    """Replace the (model, fold) parts present in ``df`` and keep all others."""
    placed = df.hint("rebalance", *[F.col(k) for k in RUN_KEYS])
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*RUN_KEYS).parquet(path)


def write_forecasts(forecasts: DataFrame, root: str) -> None:
    """(model, fold, id, d, yhat) below ``root``; a separate root keeps hold-out runs apart."""
    _write_runs(forecasts.select(*RUN_KEYS, "id", "d", "yhat"), f"{root}/forecasts")


def write_quantiles(quantiles: DataFrame, root: str) -> None:
    _write_runs(quantiles.select(*RUN_KEYS, "id", "d", "q", "yhat_q"), f"{root}/quantiles")


def write_importances(importances: DataFrame, root: str) -> None:
    """(model, fold, feature, gain, splits)."""
    _write_runs(importances.select(*RUN_KEYS, "feature", "gain", "splits"), f"{root}/importances")


def read_runs(spark: SparkSession, root: str, kind: str, model: str | None = None, fold: int | None = None) -> DataFrame:
    """``kind`` is forecasts, quantiles, importances or metrics; keys prune folders."""
    table = spark.read.parquet(f"{root}/{kind}")
    if model is not None:
        table = table.where(F.col("model") == model)
    if fold is not None:
        table = table.where(F.col("fold") == fold)
    return table


def write_metrics(metrics: DataFrame, root: str) -> None:
    """Merge metric rows into those of earlier runs: same (model, fold) replaced, others kept."""
    _write_runs(metrics, f"{root}/metrics")
