"""Panel construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.base import (
    HORIZON,
    PANEL_SELECT,
    TRAIN_END,
    Entry,
    big,
    entry,
    r,
    with_panel,
)
from demandloom.operators import panel as P
from demandloom.plans import retail
from demandloom.session import scratch_path
from demandloom.sources import tables


def _long(spark, sf):
    return retail.dense_sales(spark, sf).select(*P.ID_COLS, "d", "sales")


def _with_weeks(spark, sf):
    return _long(spark, sf).withColumn("wm_yr_wk", retail.week_of(F.col("d")))


def _clusters(spark, sf):
    placed = P.clustered(retail.panel(spark, sf).select("id", "d", "sales"))
    seen = placed.withColumns({"_part": F.spark_partition_id(), "_gap": F.monotonically_increasing_id() - F.col("d")})
    return seen.groupBy("id").agg(
        F.countDistinct("_part").alias("partitions"),
        (F.max("_gap") - F.min("_gap")).alias("order_breaks"),
        F.count("*").alias("rows"),
    )


def _violations(spark, sf):
    panel = retail.panel(spark, sf)
    n_series = retail.daily_sales(spark, sf).select("id").distinct().count()
    first, last = retail.first_and_last_day(spark, sf)
    return P.violation_counts(panel, n_series, last - first + 1)


SUMMARY_SQL = with_panel(
    f"""SELECT count(*) AS rows, count(DISTINCT id) AS series, count(DISTINCT d) AS days,
    CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS date_range,
    {r('round(avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END), 4)', 'zero_sales_frac')},
    {r('round(avg(CASE WHEN sell_price IS NULL THEN 1.0 ELSE 0.0 END), 4)', 'price_missing_frac')} FROM panel"""
)


def _checked_write(spark, sf):
    """The panel written and validated in one pass."""
    n_series = retail.daily_sales(spark, sf).select("id").distinct().count()
    first, last = retail.first_and_last_day(spark, sf)
    return tables.write_checked_panel(retail.panel(spark, sf), scratch_path(spark, "checked-panel"), n_series, last - first + 1)


ENTRIES: dict[str, Entry] = {
    "pn_melt_days": entry(
        lambda s, sf: P.melt_days(retail.wide_sales(s, sf)),
        with_panel(f"SELECT id, item_id, dept_id, cat_id, store_id, state_id, {big('d', 'sales')} FROM panel"),
    ),
    "pn_join_calendar": entry(
        lambda s, sf: P.join_calendar(_long(s, sf), retail.calendar(s, sf)),
        with_panel(
            "SELECT id, item_id, dept_id, cat_id, store_id, state_id, "
            f"{big('d', 'sales', 'wm_yr_wk', 'snap')}, CAST(date AS VARCHAR) AS date, "
            "event_name_1, event_type_1, event_name_2, event_type_2 FROM panel"
        ),
    ),
    "pn_own_state_flag": entry(
        lambda s, sf: P.join_calendar(_long(s, sf), retail.calendar(s, sf)).groupBy("state_id").agg(
            F.sum("snap").alias("flag_days"), F.sum(F.col("snap") * F.col("sales")).alias("flag_sales")
        ),
        with_panel(
            "SELECT state_id, CAST(sum(snap) AS BIGINT) AS flag_days, "
            "CAST(sum(snap * sales) AS BIGINT) AS flag_sales FROM panel GROUP BY state_id"
        ),
    ),
    "pn_join_prices": entry(
        lambda s, sf: P.join_prices(_with_weeks(s, sf), retail.prices(s, sf)),
        with_panel(
            "SELECT id, item_id, dept_id, cat_id, store_id, state_id, "
            f"{big('d', 'sales', 'wm_yr_wk')}, {r('sell_price', 'sell_price')} FROM panel"
        ),
    ),
    "pn_assemble": entry(
        lambda s, sf: P.assemble(retail.wide_sales(s, sf), retail.calendar(s, sf), retail.prices(s, sf)),
        with_panel(f"SELECT {PANEL_SELECT} FROM panel"),
    ),
    "pn_panel": entry(retail.panel, with_panel(f"SELECT {PANEL_SELECT} FROM panel")),
    "pn_clustered": entry(
        _clusters,
        with_panel(
            "SELECT id, CAST(1 AS BIGINT) AS partitions, CAST(0 AS BIGINT) AS order_breaks, count(*) AS rows "
            "FROM panel GROUP BY id"
        ),
    ),
    "pn_checked_write": entry(_checked_write, SUMMARY_SQL),
    "pn_violations": entry(
        _violations,
        with_panel(
            f"""SELECT CAST(abs(count(*) - (SELECT count(*) FROM ids) * (SELECT count(*) FROM days)) AS BIGINT) AS row_gap,
            count(*) FILTER (sales IS NULL) AS null_sales, count(*) FILTER (sales < 0) AS negative_sales,
            CAST(abs(count(DISTINCT d) - (SELECT count(*) FROM days)) AS BIGINT) AS day_gap,
            CAST(abs(count(DISTINCT date) - (SELECT count(*) FROM days)) AS BIGINT) AS date_gap,
            count(*) FILTER (sales > 0 AND sell_price IS NULL) AS sold_without_price FROM panel"""
        ),
    ),
    "pn_summary": entry(lambda s, sf: P.summary(retail.panel(s, sf)), SUMMARY_SQL),
    "pn_day_slices": entry(
        lambda s, sf: P.split_at(retail.panel(s, sf), TRAIN_END, HORIZON)[1],
        with_panel(f"SELECT id, {big('d', 'sales')} FROM panel WHERE d BETWEEN {TRAIN_END + 1} AND {TRAIN_END + HORIZON}"),
    ),
    "pn_history_slice": entry(
        lambda s, sf: P.split_at(retail.panel(s, sf), TRAIN_END, HORIZON)[0],
        with_panel(f"SELECT id, {big('d', 'sales')} FROM panel WHERE d <= {TRAIN_END}"),
    ),
    "pn_series_dimension": entry(
        lambda s, sf: P.series_dimension(retail.panel(s, sf)), with_panel("SELECT * FROM ids")
    ),
    "pn_dense_grid": entry(
        lambda s, sf: retail.dense_sales(s, sf).select("id", "d", "sales"),
        with_panel(f"SELECT id, {big('d', 'sales')} FROM panel"),
    ),
}
