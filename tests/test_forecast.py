from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.operators import forecast as FC


def _history(spark, values, name="a"):
    return spark.createDataFrame([(name, d, int(v)) for d, v in enumerate(values, 1)], "id string, d int, sales long")


def _future(spark, first, count, name="a"):
    return spark.createDataFrame([(name, first + k) for k in range(count)], "id string, d int")


def _yhat(df):
    return [r.yhat for r in df.orderBy("id", "d").collect()]


def test_naive_repeats_the_last_day(spark):
    assert _yhat(FC.forecast("naive", _history(spark, [12, 0, 31, 8, 44, 17]), _future(spark, 7, 5))) == [17] * 5


def test_naive_without_the_last_day_is_null(spark):
    both = _history(spark, [1, 2, 3]).union(_history(spark, [4, 5], "b"))
    future = _future(spark, 4, 1).union(_future(spark, 4, 1, "b")).union(_future(spark, 4, 1, "new"))
    assert _yhat(FC.forecast("naive", both, future)) == [3, None, None]


def test_seasonal_naive_tiles_the_last_week(spark):
    values = np.random.default_rng(21).poisson(30, 23)
    made = FC.forecast("seasonal_naive_7", _history(spark, values), _future(spark, 24, 17))
    assert _yhat(made) == [values[-7:][k % 7] for k in range(17)]


def test_moving_average_window(spark):
    values = np.random.default_rng(22).poisson(11, 50)
    made = FC.forecast(FC.moving_average(9), _history(spark, values), _future(spark, 51, 3))
    assert _yhat(made) == pytest.approx([values[-9:].mean()] * 3)


def test_exponential_smoothing_is_the_last_ewm(spark):
    values = np.random.default_rng(23).poisson(6, 31)
    made = FC.forecast(FC.exponential_smoothing(0.35), _history(spark, values), _future(spark, 32, 1))
    assert _yhat(made)[0] == pytest.approx(pd.Series(values.astype(float)).ewm(alpha=0.35).mean().iloc[-1])


def test_smoothing_of_a_very_long_series(spark):
    values = (np.arange(9000) % 5).astype(int)
    made = FC.forecast("exp_smoothing", _history(spark, values), _future(spark, 9001, 1))
    assert _yhat(made)[0] == pytest.approx(pd.Series(values.astype(float)).ewm(alpha=0.2).mean().iloc[-1])


def test_unknown_model_lists_the_known(spark):
    with pytest.raises(KeyError, match="moving_avg_28"):
        FC.make_baseline("oracle")


def test_finish_clips_coerces_and_keeps_null(spark):
    raw = spark.createDataFrame([("a", 1, "-3"), ("a", 2, "2.5"), ("a", 3, "n/a"), ("a", 4, None)], "id string, d int, guess string")
    assert _yhat(FC.finish(raw, "guess")) == [0.0, 2.5, None, None]


def test_many_folds_equal_single_fits(spark):
    rng = np.random.default_rng(1)
    history = _history(spark, rng.poisson(2, 120)).union(_history(spark, rng.poisson(5, 120), "b"))
    ends = {1: 64, 2: 92}
    models = [FC.make_baseline(m) for m in FC.REGISTRY]
    joint = FC.predict(FC.fit(history, ends, models), 28)
    for fold, end in ends.items():
        for model in FC.REGISTRY:
            cut = history.where(F.col("d") <= end)
            future = _future(spark, end + 1, 28).union(_future(spark, end + 1, 28, "b"))
            single = _yhat(FC.forecast(model, cut, future))
            assert _yhat(joint.where((F.col("fold") == fold) & (F.col("model") == model))) == pytest.approx(single)


def test_short_lookback_reaches_the_scan(spark, tmp_path):
    _history(spark, range(200)).write.parquet(str(tmp_path / "h"))
    made = FC.fit(spark.read.parquet(str(tmp_path / "h")), {1: 200}, [FC.naive(), FC.moving_average()])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,173)" in plan


def test_quantiles_match_numpy_and_rise(spark):
    rng = np.random.default_rng(2)
    values = rng.poisson(4, 150)
    made = FC.quantile_forecast(_history(spark, values), 150, 2).where("d = 151").orderBy("q").collect()
    got = [r.yhat_q for r in made]
    np.testing.assert_allclose(got, np.quantile(values[-84:], FC.QUANTILE_LEVELS))
    assert got == sorted(got)


def test_weekday_quantiles(spark):
    values = [(d % 7) * 10 for d in range(1, 141)]
    made = FC.quantile_forecast(_history(spark, values), 140, 7, (0.5,), by_weekday=True)
    assert {r.d: r.yhat_q for r in made.collect()} == {d: (d % 7) * 10.0 for d in range(141, 148)}


def test_mean_and_median_differ_on_skew(spark):
    values = [0] * 60 + [30] * 24
    made = {r.model: r.yhat for r in FC.point_functionals(_history(spark, values), 84, 1).collect()}
    assert made == {"mean": pytest.approx(30 * 24 / 84), "median": 0.0}


def test_paths_summary(spark):
    rng = np.random.default_rng(5)
    draws = rng.normal(10, 3, 200)
    paths = spark.createDataFrame([("a", 1, float(v)) for v in draws], "id string, d int, value double")
    row = FC.summarise_paths(paths).first()
    assert row["mean"] == pytest.approx(draws.mean()) and row["median"] == pytest.approx(np.median(draws))
    assert row["q0.835"] == pytest.approx(np.quantile(draws, 0.835))


def test_crossing_is_repaired(spark):
    wide = spark.createDataFrame([("a", 1, 5.0, -2.0, 3.0)], "id string, d int, `q0.05` double, `q0.5` double, `q0.95` double")
    row = FC.repair_crossing(wide, ["q0.05", "q0.5", "q0.95"]).first()
    assert row[2:] == (0.0, 3.0, 5.0)


def test_quantile_layouts_round_trip(spark, rows):
    long = FC.quantile_forecast(_history(spark, range(100)), 100, 3)
    assert rows(FC.lengthen_quantiles(FC.widen_quantiles(long))) == rows(long)
