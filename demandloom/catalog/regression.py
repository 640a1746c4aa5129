"""Queries of fitted models on all folds; the SQL forms the same sums and solves the same system."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
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
    fold_values,
    r,
    rr,
    with_forecasts,
    with_panel,
)
from demandloom.catalog.features import DATE_PARTS, FEATURE_CTES
from demandloom.catalog.forecast import QUANTILE_CTE, last_fold, model_table, quantiles, sales
from demandloom.catalog.metrics import score_ctes
from demandloom.operators import forecast as FC
from demandloom.operators import least_squares as LS
from demandloom.operators import regression as RG
from demandloom.plans.backtest import LINEAR, backtest, comparison_report, holdout, linear_forecasts
from demandloom.plans.features import FEATURE_COLS
from demandloom.plans.stages import feature_table, panel_table
from demandloom.session import scratch_path
from demandloom.sources import tables

INPUTS = ["sell_price", "snap", *FEATURE_COLS]


def _input(name: str) -> str:
    if name in DATE_PARTS:
        return f"CAST({DATE_PARTS[name]} AS BIGINT)"
    return "CAST(days_to_event = 0 AS BIGINT)" if name == "is_event" else name


_P = len(INPUTS)
_X = [f"x{i + 1}" for i in range(_P)]
_Z = [*_X, "y"]
_NUMBERS = ", ".join(f"coalesce(CAST({_input(c)} AS DOUBLE), 0) AS {x}" for c, x in zip(INPUTS, _X))
_MEANS = ", ".join(f"avg({z}) AS m{z}" for z in _Z)
_SUMS = ", ".join(f"sum(({a} - m{a}) * ({b} - m{b})) AS c_{a}_{b}" for i, a in enumerate(_X) for b in _Z[i:])


def _entry_of(i: int, j: int) -> str:
    low, high = sorted((i, j))
    return f"c_{_X[low]}_{_Z[high]}"


_MATRIX = ", ".join("[" + ", ".join(_entry_of(i, j) for j in range(_P + 1)) + "]" for i in range(_P))
LINEAR_CTES = (
    *FEATURE_CTES,
    f"""
feat AS MATERIALIZED (
  SELECT id, d, CAST(sales AS DOUBLE) AS y, {_NUMBERS} FROM joined
  WHERE d > {FOLDS[0].train_end - RG.LINEAR_TRAIN_DAYS} AND d <= {FOLDS[-1].test_end}
),
cut AS (SELECT * FROM (VALUES {fold_values(FOLDS)}) AS t(fold, cut)),
train AS MATERIALIZED (SELECT fold, feat.* FROM feat JOIN cut ON d > cut - {RG.LINEAR_TRAIN_DAYS} AND d <= cut),
means AS MATERIALIZED (SELECT fold, count(*) AS n, {_MEANS} FROM train GROUP BY fold),
sums AS MATERIALIZED (SELECT fold, {_SUMS} FROM train JOIN means USING (fold) GROUP BY fold),
spread AS (
  SELECT fold, n, my, [{", ".join(f"m{x}" for x in _X)}] AS m, [{_MATRIX}] AS c FROM sums JOIN means USING (fold)
),
scaled AS MATERIALIZED (
  SELECT *, list_transform(c, lambda v, i: v[i] / n > {LS.LEAST_VARIANCE} * m[i] * m[i]) AS varies,
         list_transform(c, lambda v, i: CASE WHEN v[i] / n > {LS.LEAST_VARIANCE} * m[i] * m[i] THEN sqrt(v[i]) ELSE 1 END) AS s
  FROM spread
),
sweep(fold, k, varies, a) AS (
  SELECT fold, 1, varies, list_transform(c, lambda v, i: list_transform(v, lambda e, j: e / s[i] / CASE WHEN j <= {_P} THEN s[j] ELSE 1 END))
  FROM scaled
  UNION ALL
  SELECT fold, k + 1, varies, CASE WHEN varies[k] AND a[k][k] > {LS.LEAST_PIVOT}
    THEN list_transform(a, lambda v, i: CASE WHEN i = k THEN list_transform(v, lambda e: e / a[k][k])
                                        ELSE list_transform(v, lambda e, j: e - v[k] * a[k][j] / a[k][k]) END)
    ELSE list_transform(a, lambda v, i: CASE WHEN i = k THEN list_transform(v, lambda e: 0.0::DOUBLE) ELSE v END) END
  FROM sweep WHERE k <= {_P}
),
slopes AS (
  SELECT fold, my, m, list_transform(a, lambda v, i: v[{_P + 1}] / s[i]) AS b
  FROM sweep JOIN scaled USING (fold) WHERE k = {_P + 1}
),
linear AS MATERIALIZED (
  SELECT fold, id, d, y AS sales,
         greatest(my - list_inner_product(b, m) + {" + ".join(f"{x} * b[{i + 1}]" for i, x in enumerate(_X))}, 0) AS yhat
  FROM slopes JOIN cut USING (fold) JOIN feat ON d > cut AND d <= cut + {HORIZON}
)""",
)

_POINT = (
    f"{r('avg(abs(yhat - sales))', 'mae')}, {r('sqrt(avg((yhat - sales) * (yhat - sales)))', 'rmse')}, "
    f"{r('sum(abs(yhat - sales)) / nullif(sum(sales), 0)', 'wape')}, {r('avg(yhat - sales)', 'bias')}, count(*) AS n"
)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _linear(spark, sf):
    return linear_forecasts(model_table(spark, sf)[0], FOLDS[-1:]).drop("fold")


# Small forests keep the catalog's queries short; the library's defaults are larger.
SMALL = {"tweedie_trees": {"rounds": 6, "depth": 4, "step": 0.3}, "boosted_trees": {"rounds": 6, "depth": 4, "step": 0.3}}


def _tweedie_forest(spark, sf):
    table, columns = model_table(spark, sf)
    return table, RG.fit_tweedie_trees(table, columns, TRAIN_END, rounds=20, depth=5, step=0.1)


def _tweedie_trees(spark, sf):
    table, forest = _tweedie_forest(spark, sf)
    return forest.predict(table, table.where(f"d > {TRAIN_END} AND d <= {TRAIN_END + HORIZON}"))


def _tweedie_importance(spark, sf):
    return _tweedie_forest(spark, sf)[1].importance(spark)


def _importance_store(spark, sf):
    """Importances of two folds written one after the other, one of them twice, and read back together."""
    table, columns = model_table(spark, sf)
    root = scratch_path(spark, "importances")
    for fold in (FOLDS[1], FOLDS[2], FOLDS[2]):
        forest = RG.fit_tweedie_trees(table, columns, fold.train_end, rounds=2, depth=4, train_days=180)
        named = forest.importance(spark).select(F.lit("tweedie_trees").alias("model"), F.lit(fold.fold_id).alias("fold"), "*")
        tables.write_importances(named, root)
    parts = [tables.read_runs(spark, root, "importances", "tweedie_trees", f.fold_id) for f in FOLDS[1:]]
    return reduce(DataFrame.unionByName, parts).select("model", "fold", "feature", "gain", "splits")


def _named_quantiles(spark, sf):
    """The plain quantiles under one model's name, those by weekday under another's."""
    plain = quantiles(spark, sf).withColumn("model", F.lit("moving_avg_28"))
    weekly = FC.quantile_forecast(sales(spark, sf), TRAIN_END, HORIZON, by_weekday=True)
    return plain.unionByName(weekly.withColumn("model", F.lit("seasonal_naive_7")))


def _holdout(spark, sf):
    return holdout(
        panel_table(spark, sf), [*MODELS, LINEAR], TRAIN_END, HORIZON, feature_table(spark, sf), quantiles=_named_quantiles(spark, sf)
    )


def _report(spark, sf):
    linear = linear_forecasts(feature_table(spark, sf), FOLDS[-1:]).drop("fold").withColumn("model", F.lit(LINEAR))
    forecasts = last_fold(spark, sf).unionByName(linear)
    return comparison_report(panel_table(spark, sf), forecasts, _named_quantiles(spark, sf), TRAIN_END, HORIZON, [*MODELS, LINEAR])


_LEVELS = list(FC.QUANTILE_LEVELS)
_SCORE_CTES = (
    *LINEAR_CTES,
    QUANTILE_CTE,
    f"""
everything AS (
  SELECT model, id, d, yhat FROM {LAST_FOLD}
  UNION ALL SELECT '{LINEAR}', id, d, yhat FROM linear WHERE fold = {FOLDS[-1].fold_id}
),
weekly_q AS (
  SELECT id, d % 7 AS w, unnest({_LEVELS}) AS q, unnest(quantile_cont(sales, {_LEVELS})) AS yhat_q
  FROM panel WHERE d > {TRAIN_END - FC.CONTEXT_DAYS} AND d <= {TRAIN_END} GROUP BY id, d % 7
),
qmodel AS (
  SELECT 'moving_avg_28' AS model, id, d, q, yhat_q FROM qf
  UNION ALL
  SELECT 'seasonal_naive_7', id, t.d, q, yhat_q FROM weekly_q JOIN range({TRAIN_END + 1}, {TRAIN_END + HORIZON + 1}) t(d) ON t.d % 7 = w
),
qreport AS (
  SELECT model, CAST(q AS DOUBLE) AS q, avg(greatest(q * (sales - yhat_q), (q - 1) * (sales - yhat_q))) AS pinball,
         avg(CASE WHEN sales <= yhat_q THEN 1.0 ELSE 0.0 END) AS coverage
  FROM qmodel JOIN {TEST_ROWS} t USING (id, d) GROUP BY model, q
)""",
    *score_ctes("everything"),
)

ENTRIES: dict[str, Entry] = {
    "fc_linear_reg": entry(
        _linear,
        recursive(with_panel(f"SELECT id, {big('d')}, {rr('yhat')} FROM linear WHERE fold = {FOLDS[-1].fold_id}", *LINEAR_CTES)),
    ),
    "fc_linear_folds": entry(
        lambda s, sf: linear_forecasts(feature_table(s, sf), FOLDS),
        recursive(with_panel(f"SELECT {big('fold')}, id, {big('d')}, {rr('yhat')} FROM linear", *LINEAR_CTES)),
    ),
    "me_backtest_linear": entry(
        lambda s, sf: backtest(panel_table(s, sf), FOLDS, [LINEAR], feature_table(s, sf)),
        recursive(with_panel(f"SELECT '{LINEAR}' AS model, {big('fold')}, {_POINT} FROM linear GROUP BY fold", *LINEAR_CTES)),
    ),
    "me_backtest_fitted": entry(
        lambda s, sf: backtest(panel_table(s, sf), FOLDS, [*MODELS, LINEAR], feature_table(s, sf)),
        recursive(
            with_forecasts(
                f"SELECT model, {big('fold')}, {_POINT} FROM (SELECT model, fold, sales, yhat FROM fc JOIN panel USING (id, d) "
                f"UNION ALL SELECT '{LINEAR}', fold, sales, yhat FROM linear) GROUP BY model, fold",
                *LINEAR_CTES,
            )
        ),
    ),
    "me_holdout_fitted": entry(
        _holdout,
        recursive(
            with_forecasts(
                f"SELECT model, {rr('wrmsse')}, (SELECT {r('avg(pinball)')} FROM qreport x WHERE x.model = wr.model) AS mean_pinball "
                "FROM wr WHERE level = 'overall'",
                *_SCORE_CTES,
            )
        ),
    ),
    "me_comparison_report": entry(
        _report,
        recursive(
            with_forecasts(
                f"SELECT model, measure, part, {rr('value')} FROM ("
                "SELECT model, 'wrmsse' AS measure, level AS part, wrmsse AS value FROM wr "
                "UNION ALL SELECT model, 'pinball', CAST(q AS VARCHAR), pinball FROM qreport "
                "UNION ALL SELECT model, 'coverage', CAST(q AS VARCHAR), coverage FROM qreport "
                "UNION ALL SELECT model, 'mean_pinball', 'overall', avg(pinball) FROM qreport GROUP BY model)",
                *_SCORE_CTES,
            )
        ),
    ),
    "fc_tweedie_trees": entry(_tweedie_trees, None),
    "fc_tweedie_importance": entry(_tweedie_importance, None),
    "io_importance_store": entry(_importance_store, None),
    "me_backtest_trees": entry(
        lambda s, sf: backtest(panel_table(s, sf), FOLDS, ["tweedie", *SMALL], feature_table(s, sf), options=SMALL), None
    ),
    "me_holdout_trees": entry(
        lambda s, sf: holdout(panel_table(s, sf), ["tweedie", *SMALL], TRAIN_END, HORIZON, feature_table(s, sf), options=SMALL), None
    ),
}
