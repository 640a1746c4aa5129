"""Promotion, event, failure-regime and model-winner analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.windows import ratio, share

# Regimes and their thresholds.
TAIL_DAYS = 28
COLD_START_DAYS = 90
SPARSE_ZERO_FRAC = 0.85
SHOCK_MIN_LEVEL = 0.2
SHOCK_RISE = 2.0
SHOCK_FALL = 0.5
EVENT_REACH = 7


def _error() -> Column:
    return F.col("yhat") - F.col("sales")


def segment_metrics(preds: DataFrame, truth: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, segment, wape, bias, mean_actual, n) where ``flag`` is 1 (on) and 0 (off)."""
    joined = preds.join(truth, ["id", "d"]).where(F.col(flag).isin(0, 1))
    segment = F.when(F.col(flag) == 1, "on").otherwise("off")
    return joined.groupBy(*by, segment.alias("segment")).agg(
        ratio(F.sum(F.abs(_error())), F.sum("sales")).alias("wape"),
        F.avg(_error()).alias("bias"),
        F.avg("sales").alias("mean_actual"),
        F.count("*").alias("n"),
    )


def event_distance_error(preds: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, days_to_event, mean_err, mean_actual, n) on the days 0..7 before an event."""
    joined = preds.join(truth, ["id", "d"]).where(F.col("days_to_event") <= EVENT_REACH)
    return joined.groupBy(*by, "days_to_event").agg(
        F.avg(_error()).alias("mean_err"), F.avg("sales").alias("mean_actual"), F.count("*").alias("n")
    )


def mean_event_error(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the folds' means, folds counting equally."""
    return per_fold.groupBy(*by, "days_to_event").agg(
        F.avg("mean_err").alias("mean_err"), F.avg("mean_actual").alias("mean_actual")
    )


def promo_elasticity(features: DataFrame) -> DataFrame:
    """Lift of sales on promotion days and the implied elasticity, per category.

    One pass. Categories without promotion or without other days drop out.
    """
    on, off = F.col("is_promo") == 1, F.col("is_promo") == 0
    sums = features.groupBy("cat_id").agg(
        F.avg(F.when(off, F.col("sales"))).alias("_off"),
        F.avg(F.when(on, F.col("sales"))).alias("_on"),
        F.avg(F.when(on, F.col("price_rel_med"))).alias("_price"),
        F.count_if(on).alias("promo_days"),
        F.count_if(off).alias("_other_days"),
    )
    lift = ratio(F.col("_on"), F.col("_off"))
    made = sums.where((F.col("promo_days") > 0) & (F.col("_other_days") > 0)).withColumn("_lift", lift)
    return made.select(
        "cat_id",
        F.round("_off", 3).alias("mean_off"),
        F.round("_on", 3).alias("mean_on"),
        F.round("_lift", 3).alias("lift"),
        F.round("_price", 3).alias("mean_price_ratio"),
        F.round(ratio(F.col("_lift") - 1, F.col("_price") - 1), 2).alias("elasticity"),
        "promo_days",
    ).orderBy("cat_id")


def training_profile(history: DataFrame, train_end: int, tail_days: int = TAIL_DAYS) -> DataFrame:
    """Per series: non-zero days, recent sum and mean, first sale, age, zero fraction.

    A series that never sold has age 0 and zero fraction 1.
    """
    sold = F.col("sales") > 0
    recent = F.col("d") > train_end - tail_days
    sums = history.where(F.col("d") <= train_end).groupBy("id").agg(
        F.count_if(sold).alias("nonzero"),
        F.coalesce(F.sum(F.when(recent, F.col("sales"))), F.lit(0)).alias("tail_sum"),
        F.coalesce(F.min(F.when(sold, F.col("d"))), F.lit(train_end + 1)).alias("first_sale"),
    )
    age = F.greatest(F.lit(train_end + 1) - F.col("first_sale"), F.lit(0))
    return sums.withColumn("hist_days", age).withColumns(
        {
            "zero_frac": 1 - F.col("nonzero") / F.greatest("hist_days", F.lit(1)).cast("double"),
            "recent_mean": F.col("tail_sum") / F.lit(float(tail_days)),
        }
    )


def classify(profile: DataFrame, test_means: DataFrame) -> DataFrame:
    """(id, category): the failure regime, first match in priority order.

    ``test_means`` (id, test_mean) is the level actually seen, so demand_shock
    is a diagnosis made afterwards, not known when forecasting.
    """
    level, seen = F.col("recent_mean"), F.coalesce("test_mean", F.lit(0.0))
    category = (
        F.when(F.col("hist_days") < COLD_START_DAYS, "cold_start")
        .when((F.col("tail_sum") == 0) & (F.col("nonzero") > 0), "dormant")
        .when(F.col("zero_frac") >= SPARSE_ZERO_FRAC, "sparse")
        .when((level > SHOCK_MIN_LEVEL) & ((seen > SHOCK_RISE * level) | (seen < SHOCK_FALL * level)), "demand_shock")
        .otherwise("dense_stable")
    )
    return profile.join(test_means, "id", "left").select("id", category.alias("category"))


def test_means(actuals: DataFrame) -> DataFrame:
    return actuals.groupBy("id").agg(F.avg("sales").alias("test_mean"))


def category_counts(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.count("*").alias("n_series"))


def _series_errors(preds: DataFrame, actuals: DataFrame) -> DataFrame:
    """(id, abs_err, actual, fc, rows): everything later reports need, once per series."""
    return preds.join(actuals, ["id", "d"]).groupBy("id").agg(
        F.sum(F.abs(_error())).alias("abs_err"),
        F.sum("sales").alias("actual"),
        F.sum("yhat").alias("fc"),
        F.count("*").alias("rows"),
    )


def error_taxonomy(preds: DataFrame, actuals: DataFrame, categories: DataFrame) -> DataFrame:
    """Where the error sits, per regime, largest share first, ties by category."""
    sums = _series_errors(preds, actuals).join(categories, "id", "left").groupBy("category").agg(
        F.count("*").alias("n_series"),
        F.sum("abs_err").alias("_err"),
        F.sum("actual").alias("_sales"),
        F.sum("rows").alias("_rows"),
    )
    # at most one row per regime, so the totals are a scalar
    whole = sums.agg(
        F.struct(F.sum("n_series").alias("n"), F.sum("_err").alias("err"), F.sum("_sales").alias("sales"))
    ).scalar()
    sums = sums.withColumn("_whole", whole).where(F.col("category").isNotNull())
    return sums.select(
        "category",
        "n_series",
        F.round(share(F.col("n_series"), F.col("_whole.n"), 100), 1).alias("series_pct"),
        F.round("_err", 0).alias("abs_err"),
        F.round(share(F.col("_err"), F.col("_whole.err"), 100), 1).alias("err_share_pct"),
        F.round(share(F.col("_sales"), F.col("_whole.sales"), 100), 1).alias("sales_share_pct"),
        F.round(F.col("_err") / F.greatest(F.col("_sales"), F.lit(1)), 3).alias("wape"),
        F.round(F.col("_sales") / F.col("_rows"), 3).alias("mean_actual"),
    ).orderBy(F.desc("err_share_pct"), "category")


def worst_series(preds: DataFrame, actuals: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` series with the largest total absolute error, ties by id."""
    top = _series_errors(preds, actuals).select("id", "abs_err", "actual", "fc")
    top = top.orderBy(F.desc("abs_err"), "id").limit(n)
    return top.join(categories, "id", "left").orderBy(F.desc("abs_err"), "id")


def align_models(preds: DataFrame, actuals: DataFrame, models: Sequence[str]) -> DataFrame:
    """(id, d, sales, one column per model); a missing forecast is null."""
    wide = preds.where(F.col("model").isin(*models)).groupBy("id", "d").pivot("model", list(models)).agg(F.max("yhat"))
    return actuals.select("id", "d", "sales").join(wide, ["id", "d"], "left")


def regime_wape(preds: DataFrame, actuals: DataFrame, categories: DataFrame, models: Sequence[str]) -> DataFrame:
    """(regime, n, one WAPE column per model)."""
    aligned = align_models(preds, actuals, models)
    per_series = aligned.groupBy("id").agg(
        F.count("*").alias("n"),
        F.sum("sales").alias("_sales"),
        *[F.sum(F.abs(F.col(m) - F.col("sales"))).alias(m) for m in models],
    )
    sums = per_series.join(categories, "id").groupBy(F.col("category").alias("regime")).agg(
        F.sum("n").alias("n"), F.sum("_sales").alias("_sales"), *[F.sum(m).alias(m) for m in models]
    )
    return sums.select("regime", "n", *[F.round(ratio(F.col(m), F.col("_sales")), 3).alias(m) for m in models])


def series_winners(preds: DataFrame, actuals: DataFrame, models: Sequence[str]) -> DataFrame:
    """(id, abs_winner, sq_winner): the model with the least summed error; ties by model order.

    Every model must forecast every row: a missing forecast would sum to no
    error and win, so the job fails instead.
    """
    aligned = align_models(preds, actuals, models)

    def miss(model: str) -> Column:
        absent = F.raise_error(F.lit(f"model {model} lacks a forecast for some (id, d)"))
        return F.when(F.col(model).isNull(), absent.cast("double")).otherwise(F.col(model) - F.col("sales"))

    sums = aligned.groupBy("id").agg(
        *[F.sum(F.abs(miss(m))).alias(f"_a{i}") for i, m in enumerate(models)],
        *[F.sum(miss(m) * miss(m)).alias(f"_s{i}") for i, m in enumerate(models)],
    )

    def least(prefix: str) -> Column:
        scored = [
            F.struct(F.col(f"{prefix}{i}").alias("err"), F.lit(i).alias("no"), F.lit(m).alias("model"))
            for i, m in enumerate(models)
        ]
        return F.array_min(F.array(*scored))["model"]

    return sums.select("id", least("_a").alias("abs_winner"), least("_s").alias("sq_winner"))


def winner_share(winners: DataFrame) -> DataFrame:
    """(metric, model, pct): how often each model wins, by absolute and by squared error."""
    counted = winners.unpivot("id", ["abs_winner", "sq_winner"], "metric", "model").groupBy("metric", "model").agg(
        F.count("*").alias("_n")
    )
    return _percent(counted, "metric")


def winner_share_by_regime(winners: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, model, pct) by squared error."""
    counted = winners.join(categories, "id").groupBy("category", F.col("sq_winner").alias("model")).agg(
        F.count("*").alias("_n")
    )
    return _percent(counted, "category")


def _percent(counted: DataFrame, group: str) -> DataFrame:
    whole = counted.groupBy(group).agg(F.sum("_n").alias("_all"))
    joined = counted.join(whole, group)
    return joined.select(group, "model", F.round(share(F.col("_n"), F.col("_all"), 100), 1).alias("pct"))
