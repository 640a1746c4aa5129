"""Forecast queries: baselines, quantiles, functionals and MLlib models."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.base import (
    FOLDS,
    HORIZON,
    MODELS,
    TRAIN_END,
    Entry,
    big,
    entry,
    r,
    with_forecasts,
    with_panel,
)
from demandloom.operators import forecast as FC
from demandloom.operators import panel as P
from demandloom.operators import regression as RG
from demandloom.plans import retail
from demandloom.plans.backtest import baseline_forecasts
from demandloom.plans.features import numeric_feature_columns
from demandloom.plans.stages import feature_table, panel_table


def sales(spark, sf):
    return retail.panel(spark, sf).select("id", "d", "sales")


def _single(model):
    def build(spark, sf):
        history, _, future = P.split_at(retail.panel(spark, sf), TRAIN_END, HORIZON)
        return FC.forecast(model, history, future, TRAIN_END)

    sql = with_forecasts(
        f"SELECT id, {big('d')}, {r('yhat', 'yhat')} FROM fc WHERE fold = {FOLDS[-1].fold_id} AND model = '{model}'"
    )
    return entry(build, sql)


def _shifted_week(spark, sf):
    """Last week against the month's mean: often negative, so clipping shows."""
    history, _, _ = P.split_at(retail.panel(spark, sf), TRAIN_END, HORIZON)
    raw = history.where(F.col("d") > TRAIN_END - 28).withColumn(
        "guess", (F.col("sales") - 3).cast("string")
    )
    return FC.finish(raw, "guess")


def last_fold(spark, sf):
    """(model, id, d, yhat) of all baselines on the last fold."""
    return baseline_forecasts(panel_table(spark, sf), FOLDS[-1:], MODELS).drop("fold")


def quantiles(spark, sf):
    return FC.quantile_forecast(sales(spark, sf), TRAIN_END, HORIZON)


def _paths(spark, sf):
    """Twelve sample paths: the same weekday 1 to 12 weeks before the cutoff."""
    recent = sales(spark, sf).where(F.col("d").between(TRAIN_END - 83, TRAIN_END))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(HORIZON // 7 - 1)))
    week = F.floor((F.lit(TRAIN_END) - F.col("d")) / 7)
    return (
        recent.withColumn("_block", ahead)
        .select("id", (F.col("d") + 7 * (week + 1) + 7 * F.col("_block")).cast("int").alias("d"), week.alias("sample"), F.col("sales").alias("value"))
    )


def _crossing(spark, sf):
    """Levels estimated on different spans cross; some go below zero."""
    history = sales(spark, sf)
    spans = {0.05: 84, 0.5: 56, 0.95: 28}
    parts = None
    for q, days in spans.items():
        made = FC.quantile_forecast(history, TRAIN_END, HORIZON, (q,), days)
        parts = made if parts is None else parts.unionByName(made)
    wide = FC.widen_quantiles(parts, tuple(spans)).withColumn("q0.5", F.col("`q0.5`") * 2 - 1)
    return FC.repair_crossing(wide, [f"q{q}" for q in spans]).withColumnsRenamed(
        {"q0.05": "q_low", "q0.5": "q_mid", "q0.95": "q_high"}
    )


def _sorted_three(a: str, b: str, c: str) -> str:
    return f"list_sort([greatest({a}, 0.0), greatest({b}, 0.0), greatest({c}, 0.0)])"


def _quantile_cte(days: int = FC.CONTEXT_DAYS) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT id, CAST({q} AS DOUBLE) AS q, quantile_cont(sales, {q}) AS yhat_q FROM panel "
        f"WHERE d > {TRAIN_END - days} AND d <= {TRAIN_END} GROUP BY id"
        for q in FC.QUANTILE_LEVELS
    )
    return f"""qlevel AS ({pairs}),
qf AS (SELECT id, {TRAIN_END} + h AS d, q, yhat_q FROM qlevel CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, {HORIZON + 1})))"""


QUANTILE_CTE = _quantile_cte()


def model_table(spark, sf):
    """The feature table from the earliest training day on, with its input columns."""
    first = TRAIN_END - RG.lookback_days("boosted_trees") + 1
    table = P.day_slice(feature_table(spark, sf), first)
    return table, numeric_feature_columns(table)


def _future(table):
    return P.day_slice(table, TRAIN_END + 1, TRAIN_END + HORIZON, ["id", "d"])


def fitted_trees(table, columns):
    return RG.fit_trees(table, columns, TRAIN_END)


def _trees(spark, sf):
    table, columns = model_table(spark, sf)
    return fitted_trees(table, columns).predict(table, _future(table))


def _importance(spark, sf):
    table, columns = model_table(spark, sf)
    return fitted_trees(table, columns).importance()


def _tweedie(spark, sf):
    table, columns = model_table(spark, sf)
    return RG.fit_tweedie(table, columns, TRAIN_END).predict(table, _future(table))


def _training_rows(spark, sf):
    made = RG.training_rows(sales(spark, sf), TRAIN_END, RG.TREE_TRAIN_DAYS, RG.VALID_DAYS)
    return made.groupBy("is_valid").agg(
        F.count("*").alias("rows"), F.min("d").alias("first"), F.max("d").alias("last"), F.sum("sales").alias("units")
    )


_PATH_CTE = f"""
path AS (
  SELECT id, d + 7 * ((({TRAIN_END} - d) // 7) + 1) + 7 * block AS d, sales AS value
  FROM panel CROSS JOIN (SELECT CAST(range AS INTEGER) AS block FROM range(0, {HORIZON // 7}))
  WHERE d > {TRAIN_END - 84} AND d <= {TRAIN_END}
)"""


def _renamed_paths(spark, sf):
    made = FC.summarise_paths(_paths(spark, sf))
    return made.withColumnsRenamed({f"q{q}": f"q{int(q * 1000):03d}" for q in FC.QUANTILE_LEVELS})


_RECENT = f"FROM panel WHERE d > {TRAIN_END - FC.CONTEXT_DAYS} AND d <= {TRAIN_END} GROUP BY id"
_STEPS = f"(SELECT CAST(range AS BIGINT) AS d FROM range({TRAIN_END + 1}, {TRAIN_END + HORIZON + 1}))"

ENTRIES: dict[str, Entry] = {
    **{f"fc_{model}": _single(model) for model in MODELS},
    "fc_all_baselines": entry(
        lambda s, sf: baseline_forecasts(retail.panel(s, sf), FOLDS, MODELS),
        with_forecasts(f"SELECT model, {big('fold', 'd')}, id, {r('yhat', 'yhat')} FROM fc"),
    ),
    "fc_finish": entry(
        _shifted_week,
        with_panel(
            f"SELECT id, {big('d')}, {r('greatest(sales - 3, 0)', 'yhat')} FROM panel WHERE d > {TRAIN_END - 28} AND d <= {TRAIN_END}"
        ),
    ),
    "fc_quantiles": entry(
        quantiles, with_panel(f"SELECT id, {big('d')}, {r('q', 'q')}, {r('yhat_q', 'yhat_q')} FROM qf", QUANTILE_CTE)
    ),
    "fc_quantiles_by_weekday": entry(
        lambda s, sf: FC.quantile_forecast(sales(s, sf), TRAIN_END, HORIZON, by_weekday=True),
        with_panel(
            f"SELECT id, d, {r('q', 'q')}, {r('yhat_q', 'yhat_q')} FROM (SELECT id, d % 7 AS w, unnest("
            f"{list(FC.QUANTILE_LEVELS)}) AS q, unnest(quantile_cont(sales, {list(FC.QUANTILE_LEVELS)})) AS yhat_q "
            f"{_RECENT}, d % 7) JOIN {_STEPS} t ON t.d % 7 = w"
        ),
    ),
    "fc_mean_and_median": entry(
        lambda s, sf: FC.point_functionals(sales(s, sf), TRAIN_END, HORIZON),
        with_panel(
            f"SELECT model, id, d, {r('yhat', 'yhat')} FROM (SELECT 'mean' AS model, id, avg(sales) AS yhat {_RECENT} "
            f"UNION ALL SELECT 'median', id, median(sales) {_RECENT}) CROSS JOIN {_STEPS} t"
        ),
    ),
    "fc_sample_paths": entry(
        _renamed_paths,
        with_panel(
            f"SELECT id, {big('d')}, {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, "
            + ", ".join(r(f"quantile_cont(value, {q})", f"q{int(q * 1000):03d}") for q in FC.QUANTILE_LEVELS)
            + " FROM path GROUP BY id, d",
            _PATH_CTE,
        ),
    ),
    "fc_repair_crossing": entry(
        _crossing,
        with_panel(
            f"SELECT id, d, {r('v[1]', 'q_low')}, {r('v[2]', 'q_mid')}, {r('v[3]', 'q_high')} FROM ("
            f"SELECT id, {_sorted_three('a', '2 * b - 1', 'c')} AS v FROM ("
            f"SELECT id, quantile_cont(sales, 0.05) FILTER (d > {TRAIN_END - 84}) AS a, "
            f"quantile_cont(sales, 0.5) FILTER (d > {TRAIN_END - 56}) AS b, "
            f"quantile_cont(sales, 0.95) FILTER (d > {TRAIN_END - 28}) AS c "
            f"FROM panel WHERE d <= {TRAIN_END} GROUP BY id)) CROSS JOIN {_STEPS} t"
        ),
    ),
    "fc_training_rows": entry(
        _training_rows,
        with_panel(
            f"SELECT CAST(d > {TRAIN_END - RG.VALID_DAYS} AS BIGINT) AS is_valid, count(*) AS rows, "
            "CAST(min(d) AS BIGINT) AS first, CAST(max(d) AS BIGINT) AS last, CAST(sum(sales) AS BIGINT) AS units "
            f"FROM panel WHERE d > {TRAIN_END - RG.TREE_TRAIN_DAYS} AND d <= {TRAIN_END} GROUP BY 1"
        ),
    ),
    "fc_boosted_trees": entry(_trees, None),
    "fc_feature_importance": entry(_importance, None),
    "fc_tweedie_reg": entry(_tweedie, None),
}
