"""Backtest and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.base import (
    FOLDS,
    HORIZON,
    LAST_FOLD,
    MODELS,
    TEST_ROWS,
    TRAIN_END,
    Entry,
    big,
    entry,
    r,
    rr,
    with_forecasts,
    with_panel,
)
from demandloom.catalog.forecast import QUANTILE_CTE, last_fold, quantiles, sales
from demandloom.catalog.hierarchy import BRIDGE_CTE
from demandloom.operators import forecast as FC
from demandloom.operators import hierarchy as H
from demandloom.operators import metrics as M
from demandloom.operators.panel import ID_COLS, day_slice
from demandloom.plans import retail
from demandloom.plans.backtest import backtest, compare_models, holdout, score_levels
from demandloom.plans.stages import panel_table

_POINT = (
    f"{r('avg(abs(yhat - sales))', 'mae')}, {r('sqrt(avg((yhat - sales) * (yhat - sales)))', 'rmse')}, "
    f"{r('sum(abs(yhat - sales)) / nullif(sum(sales), 0)', 'wape')}, {r('avg(yhat - sales)', 'bias')}, count(*) AS n"
)


RUNS = [(m,) for m in MODELS]


def actuals(spark, sf):
    return day_slice(panel_table(spark, sf), TRAIN_END + 1, TRAIN_END + HORIZON, ["id", "d", "sales"])


def _pinball_rows(spark, sf):
    rows = quantiles(spark, sf).join(actuals(spark, sf), ["id", "d"])
    loss = M.pinball(F.col("sales"), F.col("yhat_q"), F.col("q"))
    return rows.select("id", "d", "q", loss.alias("pinball"))


def _history(spark, sf):
    return day_slice(panel_table(spark, sf), None, TRAIN_END)


def _leaf_scale(spark, sf):
    leaves = _history(spark, sf).select(F.lit("item_store").alias("level"), F.col("id").alias("key"), "d", "sales")
    return M.naive_scale(leaves).select("key", "scale")


def _scales(spark, sf):
    return M.naive_scale(H.aggregate(_history(spark, sf).select(*ID_COLS, "d", "sales"), ["sales"]))


def _weights(spark, sf):
    return M.level_weights(M.leaf_revenue(panel_table(spark, sf), TRAIN_END, keys=ID_COLS))


def _rmsse(spark, sf):
    test = day_slice(panel_table(spark, sf), TRAIN_END + 1, TRAIN_END + HORIZON, [*ID_COLS, "d", "sales"])
    leaves = test.join(last_fold(spark, sf), ["id", "d"])
    return M.node_rmsse(leaves, _scales(spark, sf), ("model",))


def _levels(spark, sf):
    return score_levels(panel_table(spark, sf), last_fold(spark, sf), TRAIN_END, HORIZON, runs=RUNS)


def _functionals(spark, sf):
    panel = panel_table(spark, sf)
    return score_levels(panel, FC.point_functionals(panel, TRAIN_END, HORIZON), TRAIN_END, HORIZON)


def _compare(spark, sf):
    quantile = quantiles(spark, sf).withColumn("model", F.lit("moving_avg_28"))
    return compare_models(panel_table(spark, sf), last_fold(spark, sf), quantile, TRAIN_END, HORIZON, MODELS)


_N_LEVELS = len(H.LEVELS)
SCORE_CTES = (
    BRIDGE_CTE,
    f"""
nodehist AS (
  SELECT level, key, d, sum(sales) AS v FROM panel JOIN br USING (id) WHERE d <= {TRAIN_END} GROUP BY level, key, d
),
firstsale AS (SELECT level, key, min(d) AS first FROM nodehist WHERE v > 0 GROUP BY level, key),
step2 AS (
  SELECT level, key, d, v - lag(v) OVER (PARTITION BY level, key ORDER BY d) AS diff FROM nodehist
),
scale AS (
  SELECT level, key, coalesce(avg(CASE WHEN d > first THEN diff * diff END), 0) AS scale
  FROM step2 LEFT JOIN firstsale USING (level, key) GROUP BY level, key
)""",
    f"""
revenue AS (
  SELECT id, sum(sales * coalesce(sell_price, 0)) AS revenue FROM panel
  WHERE d > {TRAIN_END - M.REVENUE_DAYS} AND d <= {TRAIN_END} GROUP BY id
),
noderev AS (SELECT level, key, sum(revenue) AS revenue FROM revenue JOIN br USING (id) GROUP BY level, key),
weight AS (
  SELECT level, key, coalesce(revenue / nullif(sum(revenue) OVER (PARTITION BY level), 0), 0) / {_N_LEVELS} AS weight
  FROM noderev
)""",
)


def score_ctes(source: str) -> tuple[str, ...]:
    """Common tables up to ``wr`` (model, level, wrmsse) for forecasts (model, id, d, yhat)."""
    return SCORE_CTES + (
        f"""
nodefc AS (
  SELECT model, level, key, d, sum(yhat) AS f, sum(sales) AS a
  FROM {source} JOIN {TEST_ROWS} t USING (id, d) JOIN br USING (id) GROUP BY model, level, key, d
),
rmsse AS (
  SELECT model, level, key,
         CASE WHEN scale > 0 THEN sqrt(avg((f - a) * (f - a)) / nullif(scale, 0)) ELSE 0 END AS rmsse
  FROM nodefc JOIN scale USING (level, key) GROUP BY model, level, key, scale
),
wr AS (
  SELECT model, level, sum(weight * rmsse) * {_N_LEVELS} AS wrmsse FROM rmsse JOIN weight USING (level, key) GROUP BY model, level
  UNION ALL
  SELECT model, 'overall', sum(weight * rmsse) FROM rmsse JOIN weight USING (level, key) GROUP BY model
)""",
    )


_REPORT = (
    f"{r('avg(greatest(q * (sales - yhat_q), (q - 1) * (sales - yhat_q)))', 'pinball')}, "
    f"{r('avg(CASE WHEN sales <= yhat_q THEN 1.0 ELSE 0.0 END)', 'coverage')}"
)

ENTRIES: dict[str, Entry] = {
    "me_expanding_folds": entry(
        lambda s, sf: M.folds_table(sales(s, sf), 3, HORIZON),
        with_panel(
            f"""SELECT k AS fold_id, last - (4 - k) * {HORIZON} AS train_end, last - (4 - k) * {HORIZON} + 1 AS test_start,
            last - (3 - k) * {HORIZON} AS test_end
            FROM (SELECT CAST(max(d) AS BIGINT) AS last FROM panel) CROSS JOIN (VALUES (1::BIGINT), (2), (3)) AS t(k)"""
        ),
    ),
    "me_point_metrics": entry(
        lambda s, sf: M.point_metrics(last_fold(s, sf), actuals(s, sf), ("model",)),
        with_forecasts(f"SELECT model, {_POINT} FROM {LAST_FOLD} JOIN {TEST_ROWS} t USING (id, d) GROUP BY model"),
    ),
    "me_pinball": entry(
        _pinball_rows,
        with_panel(
            f"SELECT id, {big('d')}, {r('q', 'q')}, "
            f"{r('CASE WHEN sales >= yhat_q THEN q * (sales - yhat_q) ELSE (1 - q) * (yhat_q - sales) END', 'pinball')} "
            f"FROM qf JOIN {TEST_ROWS} t USING (id, d)",
            QUANTILE_CTE,
        ),
    ),
    "me_quantile_report": entry(
        lambda s, sf: M.quantile_report(quantiles(s, sf), actuals(s, sf)),
        with_panel(f"SELECT {r('q', 'q')}, {_REPORT} FROM qf JOIN {TEST_ROWS} t USING (id, d) GROUP BY qf.q", QUANTILE_CTE),
    ),
    "me_mean_pinball": entry(
        lambda s, sf: M.mean_pinball(M.quantile_report(quantiles(s, sf), actuals(s, sf))),
        with_panel(
            f"SELECT {r('avg(greatest(q * (sales - yhat_q), (q - 1) * (sales - yhat_q)))', 'mean_pinball')} "
            f"FROM qf JOIN {TEST_ROWS} t USING (id, d)",
            QUANTILE_CTE,
        ),
    ),
    "me_naive_scale": entry(
        _leaf_scale,
        with_panel(f"SELECT key, {rr('scale')} FROM scale WHERE level = 'item_store'", *SCORE_CTES[:2]),
    ),
    "me_node_scales": entry(
        _scales, with_panel(f"SELECT level, key, {rr('scale')} FROM scale", *SCORE_CTES[:2])
    ),
    "me_leaf_revenue": entry(
        lambda s, sf: M.leaf_revenue(retail.panel(s, sf), TRAIN_END),
        with_panel(f"SELECT id, {rr('revenue')} FROM revenue", BRIDGE_CTE, SCORE_CTES[2]),
    ),
    "me_level_weights": entry(
        _weights, with_panel(f"SELECT level, key, {rr('weight')} FROM weight", BRIDGE_CTE, SCORE_CTES[2])
    ),
    "me_node_rmsse": entry(
        _rmsse, with_forecasts(f"SELECT model, level, key, {rr('rmsse')} FROM rmsse", *score_ctes(LAST_FOLD))
    ),
    "me_weighted_rmsse": entry(
        _levels, with_forecasts(f"SELECT model, level, {rr('wrmsse')} FROM wr", *score_ctes(LAST_FOLD))
    ),
    "me_mean_vs_median": entry(
        _functionals,
        with_panel(
            f"SELECT model, level, {rr('wrmsse')} FROM wr",
            f"""functional AS (
              SELECT model, id, d, yhat FROM (
                SELECT 'mean' AS model, id, avg(sales) AS yhat FROM panel
                WHERE d > {TRAIN_END - FC.CONTEXT_DAYS} AND d <= {TRAIN_END} GROUP BY id
                UNION ALL SELECT 'median', id, median(sales) FROM panel
                WHERE d > {TRAIN_END - FC.CONTEXT_DAYS} AND d <= {TRAIN_END} GROUP BY id)
              CROSS JOIN (SELECT CAST(range AS INTEGER) AS d FROM range({TRAIN_END + 1}, {TRAIN_END + HORIZON + 1})))""",
            *score_ctes("functional"),
        ),
    ),
    "me_backtest": entry(
        lambda s, sf: backtest(panel_table(s, sf), FOLDS, MODELS),
        with_forecasts(f"SELECT model, {big('fold')}, {_POINT} FROM fc JOIN panel USING (id, d) GROUP BY model, fold"),
    ),
    "me_mean_over_folds": entry(
        lambda s, sf: M.mean_over_folds(backtest(panel_table(s, sf), FOLDS, MODELS)),
        with_forecasts(
            f"SELECT model, {r('avg(mae)', 'mae')}, {r('avg(rmse)', 'rmse')}, {r('avg(wape)', 'wape')}, {r('avg(bias)', 'bias')} "
            "FROM (SELECT model, fold, avg(abs(yhat - sales)) AS mae, sqrt(avg((yhat - sales) * (yhat - sales))) AS rmse, "
            "sum(abs(yhat - sales)) / nullif(sum(sales), 0) AS wape, avg(yhat - sales) AS bias "
            "FROM fc JOIN panel USING (id, d) GROUP BY model, fold) GROUP BY model"
        ),
    ),
    "me_compare_models": entry(
        _compare,
        with_forecasts(
            f"SELECT model, {rr('wrmsse')}, CASE WHEN model = 'moving_avg_28' THEN (SELECT "
            f"{r('avg(greatest(q * (sales - yhat_q), (q - 1) * (sales - yhat_q)))')} "
            f"FROM qf JOIN {TEST_ROWS} t USING (id, d)) END AS mean_pinball FROM wr WHERE level = 'overall'",
            QUANTILE_CTE,
            *score_ctes(LAST_FOLD),
        ),
    ),
    "me_holdout": entry(
        lambda s, sf: holdout(panel_table(s, sf), MODELS, TRAIN_END, HORIZON),
        with_forecasts(f"SELECT model, {rr('wrmsse')} FROM wr WHERE level = 'overall'", *score_ctes(LAST_FOLD)),
    ),
}
