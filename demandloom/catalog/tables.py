"""Source and sink queries: each writes a table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.base import (
    FOLDS,
    MODELS,
    TRAIN_END,
    Entry,
    big,
    entry,
    r,
    rr,
    with_forecasts,
    with_panel,
)
from demandloom.catalog.features import FEATURE_CTES
from demandloom.catalog.forecast import QUANTILE_CTE, quantiles
from demandloom.operators import panel as P
from demandloom.plans import retail
from demandloom.plans.backtest import backtest, baseline_forecasts
from demandloom.plans.stages import feature_table, panel_table
from demandloom.session import scratch_path
from demandloom.sources import raw, tables


def _csv(df, path):
    df.write.option("header", True).csv(path)
    return path


def _sales_scan(spark, sf):
    path = _csv(retail.wide_sales(spark, sf), scratch_path(spark, "sales"))
    return P.melt_days(raw.load_sales(spark, path)).select("id", "d", "sales")


def _calendar_scan(spark, sf):
    """Days as read from a calendar file with columns the scan has to drop."""
    wide = retail.calendar(spark, sf).withColumns({"weekday": F.date_format("date", "EEEE"), "year": F.year("date")})
    calendar = raw.load_calendar(spark, _csv(wide, scratch_path(spark, "calendar")))
    joined = P.join_calendar(retail.dense_sales(spark, sf).select(*P.ID_COLS, "d", "sales"), calendar)
    return joined.groupBy("date", "wm_yr_wk", "event_name_1", "event_type_1").agg(
        F.sum("sales").alias("sales"), F.sum("snap").alias("flags")
    )


def _price_scan(spark, sf):
    prices = retail.prices(spark, sf).withColumn("sell_price", F.col("sell_price").cast("float"))
    return raw.load_prices(spark, _csv(prices, scratch_path(spark, "prices")))


def _panel_roundtrip(spark, sf):
    path = scratch_path(spark, "panel")
    tables.write_panel(retail.panel(spark, sf), path)
    return tables.read_table(spark, path, ["id", "d", "sales", "sell_price"])


def _feature_store(spark, sf):
    return feature_table(spark, sf).select("store_id", "id", "d", "r_mean_28", "is_promo", "days_to_event")


def _feature_scan(spark, sf):
    path = scratch_path(spark, "features")
    tables.write_features(feature_table(spark, sf), path)
    return tables.read_features(spark, path, ["id", "d", "hist_mean", "price_rel_med"], min_day=TRAIN_END - 364)


def _forecast_store(spark, sf):
    """The first folds, then the last two: the fold in both is replaced, not doubled."""
    root, panel = scratch_path(spark, "runs"), panel_table(spark, sf)
    for folds in (FOLDS[:2], FOLDS[1:]):
        tables.write_forecasts(baseline_forecasts(panel, folds, MODELS), root)
    return tables.read_runs(spark, root, "forecasts")


def _quantile_store(spark, sf):
    root = scratch_path(spark, "runs")
    made = quantiles(spark, sf).withColumns({"model": F.lit("recent_days"), "fold": F.lit(FOLDS[-1].fold_id)})
    tables.write_quantiles(made, root)
    return tables.read_runs(spark, root, "quantiles", "recent_days", FOLDS[-1].fold_id)


def _metric_store(spark, sf):
    root, panel = scratch_path(spark, "runs"), panel_table(spark, sf)
    for folds in (FOLDS[:2], FOLDS[1:]):
        tables.write_metrics(backtest(panel, folds, MODELS), root)
    return tables.read_runs(spark, root, "metrics")


def _holdout_store(spark, sf):
    """Backtest and hold-out runs below different roots."""
    panel, roots = panel_table(spark, sf), {}
    for name, folds in (("backtest", FOLDS[:-1]), ("holdout", FOLDS[-1:])):
        roots[name] = scratch_path(spark, name)
        tables.write_forecasts(baseline_forecasts(panel, folds, MODELS), roots[name])
    seen = None
    for name, root in roots.items():
        part = tables.read_runs(spark, root, "forecasts").groupBy("model").agg(
            F.count("*").alias("rows"), F.min("d").alias("first"), F.max("d").alias("last")
        ).withColumn("store", F.lit(name))
        seen = part if seen is None else seen.unionByName(part)
    return seen


ENTRIES: dict[str, Entry] = {
    "io_sales_scan": entry(_sales_scan, with_panel(f"SELECT id, {big('d', 'sales')} FROM panel")),
    "io_calendar_scan": entry(
        _calendar_scan,
        with_panel(
            "SELECT CAST(date AS VARCHAR) AS date, CAST(wm_yr_wk AS BIGINT) AS wm_yr_wk, event_name_1, event_type_1, "
            "CAST(sum(sales) AS BIGINT) AS sales, CAST(sum(snap) AS BIGINT) AS flags FROM panel GROUP BY ALL"
        ),
    ),
    "io_price_scan": entry(
        _price_scan,
        with_panel(f"SELECT store_id, item_id, {big('wm_yr_wk')}, {r('CAST(sell_price AS FLOAT)', 'sell_price')} FROM price"),
    ),
    "io_panel_roundtrip": entry(
        _panel_roundtrip, with_panel(f"SELECT id, {big('d', 'sales')}, {rr('sell_price')} FROM panel")
    ),
    "io_feature_store": entry(
        _feature_store,
        with_panel(
            f"SELECT store_id, id, {big('d', 'is_promo', 'days_to_event')}, {rr('r_mean_28')} FROM joined", *FEATURE_CTES
        ),
    ),
    "io_feature_scan": entry(
        _feature_scan,
        with_panel(
            f"SELECT id, {big('d')}, {rr('hist_mean', 'price_rel_med')} FROM joined WHERE d >= {TRAIN_END - 364}",
            *FEATURE_CTES,
        ),
    ),
    "io_forecast_store": entry(
        _forecast_store, with_forecasts(f"SELECT model, {big('fold', 'd')}, id, {rr('yhat')} FROM fc")
    ),
    "io_quantile_store": entry(
        _quantile_store,
        with_panel(
            f"SELECT 'recent_days' AS model, CAST({FOLDS[-1].fold_id} AS BIGINT) AS fold, id, {big('d')}, {rr('q', 'yhat_q')} FROM qf",
            QUANTILE_CTE,
        ),
    ),
    "io_metric_store": entry(
        _metric_store,
        with_forecasts(
            f"SELECT model, {big('fold')}, {r('avg(abs(yhat - sales))', 'mae')}, "
            f"{r('sqrt(avg((yhat - sales) * (yhat - sales)))', 'rmse')}, "
            f"{r('sum(abs(yhat - sales)) / nullif(sum(sales), 0)', 'wape')}, {r('avg(yhat - sales)', 'bias')}, "
            "count(*) AS n FROM fc JOIN panel USING (id, d) GROUP BY model, fold"
        ),
    ),
    "io_holdout_store": entry(
        _holdout_store,
        with_forecasts(
            f"SELECT model, CASE WHEN fold = {FOLDS[-1].fold_id} THEN 'holdout' ELSE 'backtest' END AS store, "
            "count(*) AS rows, CAST(min(d) AS BIGINT) AS first, CAST(max(d) AS BIGINT) AS last FROM fc GROUP BY 1, 2"
        ),
    ),
}
