"""Backtests: baselines of all folds in one job, scored by fold, level and quantile."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators import forecast as FC
from demandloom.operators import hierarchy as H
from demandloom.operators import least_squares as LS
from demandloom.operators import metrics as M
from demandloom.operators import regression as RG
from demandloom.operators.panel import ID_COLS, day_slice
from demandloom.plans.features import numeric_feature_columns

# The models that are fitted on the feature table, anew for every fold; LINEAR fits all folds at once.
LINEAR = "linear_reg"
FITTERS = {"boosted_trees": RG.fit_trees, "tweedie": RG.fit_tweedie, "tweedie_trees": RG.fit_tweedie_trees}


def baseline_forecasts(panel: DataFrame, folds: Sequence[M.Fold], models: Iterable[str]) -> DataFrame:
    """(model, fold, id, d, yhat) of every model on every fold, from one pass over the history."""
    horizons = {f.test_end - f.train_end for f in folds}
    if len(horizons) != 1:
        raise ValueError(f"folds of different lengths: {sorted(horizons)}")
    ends = {f.fold_id: f.train_end for f in folds}
    fitted = FC.fit(panel, ends, [FC.make_baseline(m) for m in models])
    return FC.predict(fitted, horizons.pop())


def linear_forecasts(features: DataFrame, folds: Sequence[M.Fold], columns: Sequence[str] | None = None) -> DataFrame:
    """(fold, id, d, yhat) of least squares on the last days before every fold: one scan to fit all, one to predict."""
    columns = list(columns or numeric_feature_columns(features))
    train = {f.fold_id: LS.Window(f.train_end - RG.LINEAR_TRAIN_DAYS + 1, f.train_end) for f in folds}
    ahead = {f.fold_id: LS.Window(f.test_start, f.test_end) for f in folds}
    return LS.predict_windows(features, columns, LS.fit_windows(features, columns, train), ahead)


def fitted_forecasts(
    features: DataFrame,
    folds: Sequence[M.Fold],
    models: Iterable[str],
    columns: Sequence[str] | None = None,
    options: Mapping[str, dict] | None = None,
) -> DataFrame:
    """(model, fold, id, d, yhat) of regressions, each fitted on the days up to the fold's cutoff.

    ``features`` should be a stored table: every fit of trees and Tweedie reads its training days from it.
    ``options`` holds further arguments of a model's fitter under its name.
    """
    options = options or {}
    columns = list(columns or numeric_feature_columns(features))
    made = []
    for model in models:
        if model == LINEAR:
            made.append(linear_forecasts(features, folds, columns).select(F.lit(model).alias("model"), "fold", "id", "d", "yhat"))
            continue
        for fold in folds:
            future = day_slice(features, fold.test_start, fold.test_end)
            preds = FITTERS[model](features, columns, fold.train_end, **options.get(model, {})).predict(future, future)
            made.append(preds.select(F.lit(model).alias("model"), F.lit(fold.fold_id).alias("fold"), "id", "d", "yhat"))
    return reduce(DataFrame.unionByName, made)


def all_forecasts(
    panel: DataFrame,
    folds: Sequence[M.Fold],
    models: Iterable[str],
    features: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    options: Mapping[str, dict] | None = None,
) -> DataFrame:
    """(model, fold, id, d, yhat) of baselines and fitted models alike; the latter need ``features``."""
    models = list(models)
    fitted = [m for m in models if m == LINEAR or m in FITTERS]
    simple = [m for m in models if m not in fitted]
    if fitted and features is None:
        raise ValueError(f"{', '.join(fitted)}: fitted models need the feature table")
    parts = [baseline_forecasts(panel, folds, simple)] if simple else []
    parts += [fitted_forecasts(features, folds, fitted, columns, options)] if fitted else []
    return reduce(DataFrame.unionByName, parts)


def backtest(
    panel: DataFrame,
    folds: Sequence[M.Fold],
    models: Iterable[str],
    features: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    options: Mapping[str, dict] | None = None,
) -> DataFrame:
    """(model, fold, mae, rmse, wape, bias, n)."""
    first, last = min(f.test_start for f in folds), max(f.test_end for f in folds)
    actuals = day_slice(panel, first, last, ["id", "d", "sales"])
    return M.point_metrics(all_forecasts(panel, folds, models, features, columns, options), actuals, ("model", "fold"))


def score_levels(
    panel: DataFrame,
    forecasts: DataFrame,
    train_end: int,
    horizon: int,
    by: Sequence[str] = ("model",),
    runs: Sequence[tuple] | None = None,
    levels: Sequence[H.Level] = H.LEVELS,
) -> DataFrame:
    """(*by, level, wrmsse): forecasts summed up all levels against the actuals.

    Scales come from the whole training history, weights from the revenue of its
    last days. ``forecasts`` has ``by``, id, d and yhat. Every run is scored on
    every actual, and what it does not forecast counts as 0. ``runs`` lists the
    values of ``by``; without it they are read from the forecasts first.
    """
    history = day_slice(panel, None, train_end, [*ID_COLS, "d", "sales"])
    scales = M.naive_scale(H.aggregate(history, ["sales"], ("d",), levels))
    weights = M.level_weights(M.leaf_revenue(panel, train_end, keys=ID_COLS), levels)
    actuals = day_slice(panel, train_end + 1, train_end + horizon, [*ID_COLS, "d", "sales"])
    if runs is None:
        known = forecasts.agg(F.collect_set(F.struct(*by))).scalar()
    else:
        known = F.array(*[F.struct(*[F.lit(v).alias(name) for name, v in zip(by, run)]) for run in runs])
    wanted = actuals.withColumn("_run", F.explode(known)).select(*ID_COLS, "d", "sales", "_run.*")
    leaves = wanted.join(forecasts, [*by, "id", "d"], "left")
    return M.weighted_rmsse(M.node_rmsse(leaves, scales, by, levels), weights, by, levels)


def compare_models(
    panel: DataFrame,
    forecasts: DataFrame,
    quantiles: DataFrame,
    train_end: int,
    horizon: int,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """(model, wrmsse, mean_pinball): one row per model; no pinball without quantiles."""
    runs = [(m,) for m in models] if models else None
    overall = score_levels(panel, forecasts, train_end, horizon, runs=runs).where(F.col("level") == "overall")
    actuals = day_slice(panel, train_end + 1, train_end + horizon)
    pinball = M.mean_pinball(M.quantile_report(quantiles, actuals, ("model",)), ("model",))
    return overall.select("model", "wrmsse").join(pinball, "model", "left")


def comparison_report(
    panel: DataFrame,
    forecasts: DataFrame,
    quantiles: DataFrame,
    train_end: int,
    horizon: int,
    models: Sequence[str] | None = None,
    levels: Sequence[H.Level] = H.LEVELS,
) -> DataFrame:
    """(model, measure, part, value): everything one window says of every model.

    measure is wrmsse (part: a level, or ``overall``), pinball and coverage (part: a quantile level), or mean_pinball
    (part: ``overall``). A model without quantiles has the first only.
    """
    runs = [(m,) for m in models] if models else None
    scores = score_levels(panel, forecasts, train_end, horizon, runs=runs, levels=levels)
    actuals = day_slice(panel, train_end + 1, train_end + horizon)
    report = M.quantile_report(quantiles, actuals, ("model",))
    by_level = report.withColumnRenamed("q", "part").unpivot(["model", "part"], ["pinball", "coverage"], "measure", "value")
    mean = M.mean_pinball(report, ("model",))
    rows = [
        scores.select("model", F.lit("wrmsse").alias("measure"), F.col("level").alias("part"), F.col("wrmsse").alias("value")),
        by_level.select("model", "measure", F.col("part").cast("string").alias("part"), "value"),
        mean.select("model", F.lit("mean_pinball").alias("measure"), F.lit("overall").alias("part"), F.col("mean_pinball").alias("value")),
    ]
    return reduce(DataFrame.unionByName, rows)


def holdout(
    panel: DataFrame,
    models: Iterable[str],
    train_end: int,
    horizon: int,
    features: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    quantiles: DataFrame | None = None,
    options: Mapping[str, dict] | None = None,
) -> DataFrame:
    """(model, wrmsse) on the days after ``train_end``, forecast once from all days before.

    With ``quantiles`` (model, id, d, q, yhat_q) also mean_pinball, null for a model without them.
    """
    models = list(models)
    fold = M.Fold(1, train_end, train_end + 1, train_end + horizon)
    forecasts = all_forecasts(panel, [fold], models, features, columns, options).drop("fold")
    if quantiles is not None:
        return compare_models(panel, forecasts, quantiles, train_end, horizon, models)
    scores = score_levels(panel, forecasts, train_end, horizon, runs=[(m,) for m in models])
    return scores.where(F.col("level") == "overall").select("model", "wrmsse")
