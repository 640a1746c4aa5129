"""Promotion, event, regime and winner queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.base import (
    EVENT_FOLDS,
    LAST_DAY,
    LAST_FOLD,
    MODELS,
    TEST_ROWS,
    TRAIN_END,
    Entry,
    baseline_ctes,
    big,
    entry,
    r,
    with_forecasts,
    with_panel,
)
from demandloom.catalog.features import EVENT_CTE, WEEKLY_CTE
from demandloom.catalog.forecast import last_fold
from demandloom.catalog.metrics import actuals
from demandloom.operators import analysis as A
from demandloom.operators.panel import day_slice
from demandloom.plans.backtest import baseline_forecasts
from demandloom.plans.stages import feature_table, panel_table

CHAMPION = "moving_avg_28"
EVENT_MODELS = ("moving_avg_28", "seasonal_naive_7")


def _truth(spark, sf, first, *columns):
    return day_slice(feature_table(spark, sf), first, LAST_DAY, ["id", "d", "sales", *columns])


def _segments(spark, sf):
    truth = _truth(spark, sf, TRAIN_END + 1, "is_promo", "cat_id")
    return A.segment_metrics(last_fold(spark, sf), truth, "is_promo", ("model", "cat_id"))


def _event_errors(spark, sf):
    preds = baseline_forecasts(panel_table(spark, sf), EVENT_FOLDS, EVENT_MODELS)
    truth = _truth(spark, sf, EVENT_FOLDS[0].test_start, "days_to_event")
    return A.event_distance_error(preds, truth, ("model", "fold"))


def _profile(spark, sf):
    return A.training_profile(day_slice(panel_table(spark, sf), None, None, ["id", "d", "sales"]), TRAIN_END)


def _categories(spark, sf):
    return A.classify(_profile(spark, sf), A.test_means(actuals(spark, sf)))


def _champion(spark, sf):
    return last_fold(spark, sf).where(F.col("model") == CHAMPION).drop("model")


def _winners(spark, sf):
    return A.series_winners(last_fold(spark, sf), actuals(spark, sf), MODELS)


# ---- SQL ----

_PROFILE_CTE = f"""
profile AS (
  SELECT id, count(*) FILTER (sales > 0) AS nonzero,
         coalesce(sum(sales) FILTER (d > {TRAIN_END - A.TAIL_DAYS}), 0) AS tail_sum,
         coalesce(min(d) FILTER (sales > 0), {TRAIN_END + 1}) AS first_sale
  FROM panel WHERE d <= {TRAIN_END} GROUP BY id
),
profiled AS (
  SELECT *, greatest({TRAIN_END} - first_sale + 1, 0) AS hist_days,
         1 - nonzero / CAST(greatest(greatest({TRAIN_END} - first_sale + 1, 0), 1) AS DOUBLE) AS zero_frac,
         tail_sum / {A.TAIL_DAYS}.0::DOUBLE AS recent_mean
  FROM profile
),
cats AS (
  SELECT id, CASE
    WHEN hist_days < {A.COLD_START_DAYS} THEN 'cold_start'
    WHEN tail_sum = 0 AND nonzero > 0 THEN 'dormant'
    WHEN zero_frac >= {A.SPARSE_ZERO_FRAC} THEN 'sparse'
    WHEN recent_mean > {A.SHOCK_MIN_LEVEL} AND (test_mean > 2 * recent_mean OR test_mean < 0.5 * recent_mean) THEN 'demand_shock'
    ELSE 'dense_stable' END AS category
  FROM profiled LEFT JOIN (SELECT id, avg(sales) AS test_mean FROM {TEST_ROWS} t GROUP BY id) USING (id)
)"""
_CHAMPION_CTE = f"""
err AS (
  SELECT id, d, yhat, sales, abs(yhat - sales) AS abs_err, category
  FROM {LAST_FOLD} f JOIN {TEST_ROWS} t USING (id, d) JOIN cats USING (id) WHERE model = '{CHAMPION}'
)"""
_WINNER_CTE = f"""
total AS (
  SELECT id, model, sum(abs(yhat - sales)) AS a, sum((yhat - sales) * (yhat - sales)) AS s,
         list_position({list(MODELS)}, model) AS no
  FROM {LAST_FOLD} f JOIN {TEST_ROWS} t USING (id, d) GROUP BY id, model
),
win AS (
  SELECT id, max(CASE WHEN ra = 1 THEN model END) AS abs_winner, max(CASE WHEN rs = 1 THEN model END) AS sq_winner
  FROM (SELECT id, model, row_number() OVER (PARTITION BY id ORDER BY a, no) AS ra,
               row_number() OVER (PARTITION BY id ORDER BY s, no) AS rs FROM total) GROUP BY id
)"""
_WIDE = f"""
wide AS (
  SELECT id, d, {", ".join(f"max(CASE WHEN model = '{m}' THEN yhat END) AS {m}" for m in MODELS)}
  FROM {LAST_FOLD} f GROUP BY id, d
),
aligned AS (SELECT t.id, t.d, t.sales, {", ".join(MODELS)} FROM {TEST_ROWS} t LEFT JOIN wide USING (id, d))"""


def _share_sql(group: str, select: str) -> str:
    return (
        f"SELECT {group}, model, {r(f'round(100.0 * n / sum(n) OVER (PARTITION BY {group}), 1)', 'pct')} FROM ({select})"
    )


_EVENT_SQL_CTES = (baseline_ctes(EVENT_FOLDS), EVENT_CTE)
_EVENT_ROWS = (
    "(SELECT model, fold, id, d, days_to_event, yhat - sales AS err, sales FROM fc JOIN panel USING (id, d) "
    f"JOIN dist USING (d) WHERE days_to_event <= {A.EVENT_REACH} AND model IN {EVENT_MODELS})"
)

ENTRIES: dict[str, Entry] = {
    "an_promo_segments": entry(
        _segments,
        with_forecasts(
            f"""SELECT model, cat_id, CASE WHEN is_promo = 1 THEN 'on' ELSE 'off' END AS segment,
            {r('sum(abs(yhat - sales)) / nullif(sum(sales), 0)', 'wape')}, {r('avg(yhat - sales)', 'bias')},
            {r('avg(sales)', 'mean_actual')}, count(*) AS n
            FROM {LAST_FOLD} f JOIN {TEST_ROWS} t USING (id, d) JOIN priced USING (id, d) GROUP BY model, cat_id, is_promo""",
            WEEKLY_CTE,
        ),
    ),
    "an_event_error": entry(
        _event_errors,
        with_panel(
            f"SELECT model, {big('fold', 'days_to_event')}, {r('avg(err)', 'mean_err')}, {r('avg(sales)', 'mean_actual')}, "
            f"count(*) AS n FROM {_EVENT_ROWS} GROUP BY model, fold, days_to_event",
            *_EVENT_SQL_CTES,
        ),
    ),
    "an_mean_event_error": entry(
        lambda s, sf: A.mean_event_error(_event_errors(s, sf), ("model",)),
        with_panel(
            f"SELECT model, {big('days_to_event')}, {r('avg(e)', 'mean_err')}, {r('avg(a)', 'mean_actual')} FROM ("
            f"SELECT model, fold, days_to_event, avg(err) AS e, avg(sales) AS a FROM {_EVENT_ROWS} "
            "GROUP BY model, fold, days_to_event) GROUP BY model, days_to_event",
            *_EVENT_SQL_CTES,
        ),
    ),
    "an_promo_elasticity": entry(
        lambda s, sf: A.promo_elasticity(feature_table(s, sf)),
        with_panel(
            f"""SELECT cat_id, {r('round(off, 3)', 'mean_off')}, {r('round(onn, 3)', 'mean_on')},
            {r('round(onn / nullif(off, 0), 3)', 'lift')}, {r('round(rel, 3)', 'mean_price_ratio')},
            {r('round((onn / nullif(off, 0) - 1) / nullif(rel - 1, 0), 2)', 'elasticity')}, promo_days
            FROM (SELECT cat_id, avg(sales) FILTER (is_promo = 0) AS off, avg(sales) FILTER (is_promo = 1) AS onn,
                         avg(price_rel_med) FILTER (is_promo = 1) AS rel, count(*) FILTER (is_promo = 1) AS promo_days,
                         count(*) FILTER (is_promo = 0) AS other_days
                  FROM panel JOIN priced USING (id, d) GROUP BY cat_id) WHERE promo_days > 0 AND other_days > 0""",
            WEEKLY_CTE,
        ),
    ),
    "an_training_profile": entry(
        _profile,
        with_panel(
            f"SELECT id, {big('nonzero', 'tail_sum', 'first_sale', 'hist_days')}, {r('zero_frac', 'zero_frac')}, "
            f"{r('recent_mean', 'recent_mean')} FROM profiled",
            _PROFILE_CTE,
        ),
    ),
    "an_regimes": entry(_categories, with_panel("SELECT id, category FROM cats", _PROFILE_CTE)),
    "an_regime_counts": entry(
        lambda s, sf: A.category_counts(_categories(s, sf)),
        with_panel("SELECT category, count(*) AS n_series FROM cats GROUP BY category", _PROFILE_CTE),
    ),
    "an_error_taxonomy": entry(
        lambda s, sf: A.error_taxonomy(_champion(s, sf), actuals(s, sf), _categories(s, sf)),
        with_forecasts(
            f"""SELECT category, count(DISTINCT id) AS n_series,
            {r('round(100.0 * count(DISTINCT id) / (SELECT count(DISTINCT id) FROM err), 1)', 'series_pct')},
            {r('round(sum(abs_err), 0)', 'abs_err')},
            {r('round(100 * sum(abs_err) / (SELECT sum(abs_err) FROM err), 1)', 'err_share_pct')},
            {r('round(100.0 * sum(sales) / (SELECT sum(sales) FROM err), 1)', 'sales_share_pct')},
            {r('round(sum(abs_err) / greatest(sum(sales), 1), 3)', 'wape')},
            {r('round(avg(sales), 3)', 'mean_actual')} FROM err GROUP BY category""",
            _PROFILE_CTE,
            _CHAMPION_CTE,
        ),
    ),
    "an_worst_series": entry(
        lambda s, sf: A.worst_series(_champion(s, sf), actuals(s, sf), _categories(s, sf)),
        with_forecasts(
            f"SELECT id, {r('sum(abs_err)', 'abs_err')}, CAST(sum(sales) AS BIGINT) AS actual, {r('sum(yhat)', 'fc')}, "
            "max(category) AS category FROM err GROUP BY id ORDER BY sum(abs_err) DESC, id LIMIT 10",
            _PROFILE_CTE,
            _CHAMPION_CTE,
        ),
    ),
    "an_aligned_models": entry(
        lambda s, sf: A.align_models(last_fold(s, sf), actuals(s, sf), MODELS),
        with_forecasts(f"SELECT id, {big('d', 'sales')}, {', '.join(r(m, m) for m in MODELS)} FROM aligned", _WIDE),
    ),
    "an_regime_wape": entry(
        lambda s, sf: A.regime_wape(last_fold(s, sf), actuals(s, sf), _categories(s, sf), MODELS),
        with_forecasts(
            "SELECT category AS regime, count(*) AS n, "
            + ", ".join(r(f"round(sum(abs({m} - sales)) / nullif(sum(sales), 0), 3)", m) for m in MODELS)
            + " FROM aligned JOIN cats USING (id) GROUP BY category",
            _WIDE,
            _PROFILE_CTE,
        ),
    ),
    "an_series_winners": entry(_winners, with_forecasts("SELECT id, abs_winner, sq_winner FROM win", _WINNER_CTE)),
    "an_winner_share": entry(
        lambda s, sf: A.winner_share(_winners(s, sf)),
        with_forecasts(
            _share_sql(
                "metric",
                "SELECT 'abs_winner' AS metric, abs_winner AS model, count(*) AS n FROM win GROUP BY abs_winner "
                "UNION ALL SELECT 'sq_winner', sq_winner, count(*) FROM win GROUP BY sq_winner",
            ),
            _WINNER_CTE,
        ),
    ),
    "an_winner_share_by_regime": entry(
        lambda s, sf: A.winner_share_by_regime(_winners(s, sf), _categories(s, sf)),
        with_forecasts(
            _share_sql(
                "category", "SELECT category, sq_winner AS model, count(*) AS n FROM win JOIN cats USING (id) GROUP BY 1, 2"
            ),
            _WINNER_CTE,
            _PROFILE_CTE,
        ),
    ),
}
