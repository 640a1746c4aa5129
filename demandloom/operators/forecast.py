"""Baseline forecasts and distribution summaries, as per-series aggregates.

A fitted baseline is a short repeating pattern per series: one value for a flat
forecast, seven for a weekly one. All models and all folds are fitted in a
single pass over the history, with one group per series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.panel import day_slice

# Fixed values.
QUANTILE_LEVELS = (0.05, 0.165, 0.25, 0.5, 0.75, 0.835, 0.95)
CONTEXT_DAYS = 84
POINT_COLS = ["id", "d", "yhat"]


@dataclass(frozen=True)
class Baseline:
    """``pattern(train_end)`` aggregates a series' history into the repeating values.

    ``lookback`` is how many days before the cutoff it reads; None means all.
    """

    name: str
    lookback: int | None
    pattern: Callable[[int], Column]


def _on(day: int) -> Column:
    return F.max(F.when(F.col("d") == day, F.col("sales"))).cast("double")


def naive() -> Baseline:
    """The last training day, repeated; null for a series without that day."""
    return Baseline("naive", 1, lambda end: F.array(_on(end)))


def seasonal_naive(period: int = 7) -> Baseline:
    """The last ``period`` days, repeated."""
    return Baseline(
        f"seasonal_naive_{period}",
        period,
        lambda end: F.array(*[_on(end - period + step) for step in range(1, period + 1)]),
    )


def moving_average(window: int = 28) -> Baseline:
    """The mean of the last ``window`` days, flat."""
    return Baseline(
        f"moving_avg_{window}",
        window,
        lambda end: F.array(F.avg(F.when(F.col("d").between(end - window + 1, end), F.col("sales")))),
    )


def exponential_smoothing(alpha: float = 0.2) -> Baseline:
    """The final exponentially weighted level, flat.

    Weights are relative to the cutoff, so old days fade to zero and nothing
    can overflow however long the series.
    """

    def pattern(end: int) -> Column:
        weight = F.when(
            (F.col("d") <= end) & F.col("sales").isNotNull(), F.pow(F.lit(1.0 - alpha), F.lit(end) - F.col("d"))
        )
        return F.array(F.sum(weight * F.col("sales")) / F.nullif(F.sum(weight), F.lit(0.0)))

    return Baseline("exp_smoothing", None, pattern)


REGISTRY: dict[str, Callable[[], Baseline]] = {
    "naive": naive,
    "seasonal_naive_7": seasonal_naive,
    "moving_avg_28": moving_average,
    "exp_smoothing": exponential_smoothing,
}


def make_baseline(name: str) -> Baseline:
    if name not in REGISTRY:
        raise KeyError(f"no baseline named {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()


def last_day(history: DataFrame) -> int:
    return history.agg(F.max("d")).first()[0]


def fit(history: DataFrame, train_ends: dict[int, int], models: Iterable[Baseline]) -> DataFrame:
    """(id, model, fold, train_end, pattern) of every model at every cutoff.

    ``train_ends`` maps fold to its last training day. When every model looks
    back a known number of days, older rows are filtered at the scan.
    """
    models = list(models)
    reach = [m.lookback for m in models]
    first = None if None in reach else min(train_ends.values()) - max(reach) + 1
    rows = day_slice(history, first, max(train_ends.values()))
    fits = [(m, fold, end) for fold, end in train_ends.items() for m in models]
    per_series = rows.groupBy("id").agg(*[m.pattern(end).alias(f"_p{i}") for i, (m, _, end) in enumerate(fits)])
    entries = [
        F.struct(
            F.lit(m.name).alias("model"),
            F.lit(fold).alias("fold"),
            F.lit(end).alias("train_end"),
            F.col(f"_p{i}").alias("pattern"),
        )
        for i, (m, fold, end) in enumerate(fits)
    ]
    return per_series.select("id", F.inline(F.array(*entries)))


def not_negative(value: Column) -> Column:
    """Demand is a count: negatives become 0, null stays null."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def finish(df: DataFrame, value: str = "yhat") -> DataFrame:
    """Any numeric or numeric-text forecast as (id, d, yhat >= 0)."""
    return df.withColumn("yhat", not_negative(F.expr(f"try_cast({value} AS double)"))).select(*POINT_COLS)


def _step_value(step: Column) -> Column:
    return not_negative(F.element_at("pattern", F.pmod(step - 1, F.size("pattern")) + 1))


def predict(fitted: DataFrame, horizon: int) -> DataFrame:
    """(model, fold, id, d, yhat) for the ``horizon`` days after each cutoff, without a join."""
    steps = fitted.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(
        "model", "fold", "id", (F.col("train_end") + F.col("_h")).alias("d"), _step_value(F.col("_h")).alias("yhat")
    )


def predict_rows(fitted: DataFrame, future: DataFrame) -> DataFrame:
    """(id, d, yhat) for given rows and one fitted model; unknown series give null."""
    joined = future.select("id", "d").join(fitted, "id", "left")
    return joined.select("id", "d", _step_value(F.col("d") - F.col("train_end")).alias("yhat"))


def forecast(model: str | Baseline, history: DataFrame, future: DataFrame, train_end: int | None = None) -> DataFrame:
    """Fit one baseline on ``history`` and predict the rows of ``future``."""
    baseline = make_baseline(model) if isinstance(model, str) else model
    end = last_day(history) if train_end is None else train_end
    return predict_rows(fit(history, {1: end}, [baseline]), future)


def _recent(history: DataFrame, train_end: int, days: int) -> DataFrame:
    return day_slice(history, train_end - days + 1, train_end)


def _levels(levels: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(q)) for q in levels])


def quantile_forecast(
    history: DataFrame,
    train_end: int,
    horizon: int,
    levels: Iterable[float] = QUANTILE_LEVELS,
    days: int = CONTEXT_DAYS,
    by_weekday: bool = False,
) -> DataFrame:
    """(id, d, q, yhat_q): empirical quantiles of each series' last ``days`` days.

    A group holds at most ``days`` rows. With ``by_weekday`` a day is forecast
    from the same weekday only.
    """
    levels = tuple(levels)
    recent = _recent(history, train_end, days)
    steps = F.sequence(F.lit(train_end + 1), F.lit(train_end + horizon))
    if by_weekday:
        recent = recent.withColumn("_weekday", F.pmod(F.col("d"), F.lit(7)))
        steps = F.filter(steps, lambda d: F.pmod(d, F.lit(7)) == F.col("_weekday"))
    keys = ["id", "_weekday"] if by_weekday else ["id"]
    pairs = F.arrays_zip(_levels(levels).alias("q"), F.percentile("sales", _levels(levels)).alias("yhat_q"))
    return (
        recent.groupBy(*keys)
        .agg(pairs.alias("_pairs"))
        .select(*keys, F.inline("_pairs"))
        .select("id", F.explode(steps).alias("d"), "q", not_negative(F.col("yhat_q")).alias("yhat_q"))
    )


def point_functionals(history: DataFrame, train_end: int, horizon: int, days: int = CONTEXT_DAYS) -> DataFrame:
    """(model, id, d, yhat) with the mean and the median of the same recent days."""
    both = _recent(history, train_end, days).groupBy("id").agg(
        F.avg("sales").alias("mean"), F.percentile("sales", 0.5).alias("median")
    )
    steps = F.sequence(F.lit(train_end + 1), F.lit(train_end + horizon))
    return both.unpivot("id", ["mean", "median"], "model", "yhat").select(
        "model", "id", F.explode(steps).alias("d"), "yhat"
    )


def summarise_paths(paths: DataFrame, levels: Iterable[float] = QUANTILE_LEVELS, value: str = "value") -> DataFrame:
    """Sample paths (id, d, value) to their mean and quantiles per (id, d).

    Columns ``mean``, ``median`` and one ``q<level>`` per level.
    """
    levels = tuple(levels)
    made = paths.groupBy("id", "d").agg(
        F.avg(value).alias("mean"),
        F.percentile(value, 0.5).alias("median"),
        F.percentile(value, _levels(levels)).alias("_q"),
    )
    return made.select("id", "d", "mean", "median", *[F.col("_q")[i].alias(f"q{q}") for i, q in enumerate(levels)])


def repair_crossing(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Clip the quantile columns at 0 and put each row's values in rising order."""
    ordered = F.array_sort(F.array(*[not_negative(F.col(f"`{c}`")) for c in columns]))
    return (
        wide.withColumn("_ordered", ordered)
        .withColumns({c: F.col("_ordered")[i] for i, c in enumerate(columns)})
        .drop("_ordered")
    )


def widen_quantiles(long: DataFrame, levels: Iterable[float] = QUANTILE_LEVELS) -> DataFrame:
    """(id, d, q, yhat_q) to one ``q<level>`` column per level."""
    picked = [F.max(F.when(F.col("q") == q, F.col("yhat_q"))).alias(f"q{q}") for q in levels]
    return long.groupBy("id", "d").agg(*picked)


def lengthen_quantiles(wide: DataFrame, levels: Iterable[float] = QUANTILE_LEVELS) -> DataFrame:
    """The inverse of ``widen_quantiles``."""
    pairs = [F.struct(F.lit(float(q)).alias("q"), F.col(f"`q{q}`").alias("yhat_q")) for q in levels]
    return wide.select("id", "d", F.inline(F.array(*pairs)))
