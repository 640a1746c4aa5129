from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.operators import analysis as A
from demandloom.operators import explore as X

END = 200
PRED = "model string, id string, d int, yhat double"
TRUE = "id string, d int, sales int"


@pytest.fixture(scope="module")
def history(spark):
    """One series per regime, and one that never sold."""
    rows = []
    for d in range(1, END + 1):
        rows += [
            ("dense", d, 5),
            ("shock", d, 4),
            ("sparse", d, 3 if d % 10 == 0 else 0),
            ("dormant", d, 6 if d <= 150 else 0),
            ("cold", d, 7 if d > 150 else 0),
            ("never", d, 0),
        ]
    return spark.createDataFrame(rows, TRUE).cache()


@pytest.fixture(scope="module")
def actuals(spark):
    levels = {"dense": 5, "shock": 20, "sparse": 0, "dormant": 0, "cold": 7, "never": 0}
    return spark.createDataFrame([(i, END + k, v) for i, v in levels.items() for k in (1, 2)], TRUE).cache()


@pytest.fixture(scope="module")
def categories(history, actuals):
    return A.classify(A.training_profile(history, END), A.test_means(actuals)).cache()


def test_profile(history):
    got = {r.id: r for r in A.training_profile(history, END).collect()}
    assert (got["cold"].first_sale, got["cold"].hist_days, got["cold"].zero_frac) == (151, 50, 0.0)
    assert (got["sparse"].nonzero, got["sparse"].hist_days) == (20, 191)
    assert (got["never"].first_sale, got["never"].hist_days, got["never"].zero_frac) == (END + 1, 0, 1.0)
    assert got["dormant"].tail_sum == 0 and got["dense"].recent_mean == 5.0


def test_regimes(categories):
    got = {r.id: r.category for r in categories.collect()}
    assert got == {
        "dense": "dense_stable", "shock": "demand_shock", "sparse": "sparse", "dormant": "dormant",
        "cold": "cold_start", "never": "cold_start",
    }


def test_regime_priority(spark):
    """A series that fits several regimes takes the first."""
    schema = "id string, nonzero long, tail_sum long, first_sale int, hist_days int, zero_frac double, recent_mean double"
    rows = [("young", 1, 0, 150, 50, 0.99, 0.0), ("quiet", 1, 0, 1, 200, 0.99, 0.0), ("rare", 5, 28, 1, 200, 0.9, 1.0)]
    means = spark.createDataFrame([("rare", 9.0)], "id string, test_mean double")
    got = {r.id: r.category for r in A.classify(spark.createDataFrame(rows, schema), means).collect()}
    assert got == {"young": "cold_start", "quiet": "dormant", "rare": "sparse"}


def test_taxonomy_shares(spark, actuals, categories):
    preds = actuals.select("id", "d", F.lit(5.0).alias("yhat"))
    rows = A.error_taxonomy(preds, actuals, categories).collect()
    assert rows[0].category == "demand_shock" and rows[0].abs_err == 30.0
    assert sum(r.err_share_pct for r in rows) == pytest.approx(100, abs=0.5)
    cold = next(r for r in rows if r.category == "cold_start")
    assert (cold.n_series, cold.series_pct, cold.mean_actual) == (2, 33.3, 3.5)
    sparse = next(r for r in rows if r.category == "sparse")
    assert sparse.wape == 10.0


def test_worst_series_break_ties_by_id(actuals, categories):
    preds = actuals.select("id", "d", F.lit(5.0).alias("yhat"))
    got = [(r.id, r.abs_err, r.category) for r in A.worst_series(preds, actuals, categories, 3).collect()]
    assert got == [("shock", 30.0, "demand_shock"), ("dormant", 10.0, "dormant"), ("never", 10.0, "cold_start")]


def test_winners_and_ties(spark):
    truth = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("b", 1, 3), ("b", 2, 3)], TRUE)
    # a: x errs (0, 10), y errs (5, 5): equal in sum, y better in squares; b: both perfect
    rows = [("x", "a", 1, 0.0), ("x", "a", 2, 0.0), ("y", "a", 1, 5.0), ("y", "a", 2, 5.0)]
    rows += [(m, "b", d, 3.0) for m in ("x", "y") for d in (1, 2)]
    preds = spark.createDataFrame(rows, PRED)
    got = {r.id: (r.abs_winner, r.sq_winner) for r in A.series_winners(preds, truth, ["x", "y"]).collect()}
    assert got == {"a": ("x", "y"), "b": ("x", "x")}
    assert {r.id: r.abs_winner for r in A.series_winners(preds, truth, ["y", "x"]).collect()} == {"a": "y", "b": "y"}
    share = {(r.metric, r.model): r.pct for r in A.winner_share(A.series_winners(preds, truth, ["x", "y"])).collect()}
    assert share == {("abs_winner", "x"): 100.0, ("sq_winner", "x"): 50.0, ("sq_winner", "y"): 50.0}


def test_missing_forecast_does_not_win(spark):
    truth = spark.createDataFrame([("a", 1, 4), ("a", 2, 4)], TRUE)
    preds = spark.createDataFrame([("x", "a", 1, 4.0), ("y", "a", 1, 5.0), ("y", "a", 2, 5.0)], PRED)
    with pytest.raises(Exception, match="model x lacks a forecast"):
        A.series_winners(preds, truth, ["x", "y"]).collect()


def test_segments_and_elasticity(spark):
    truth = spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 5, 0), ("a", 3, 0, 0)], TRUE + ", is_promo int")
    preds = spark.createDataFrame([("m", "a", d, 6.0) for d in (1, 2, 3)], PRED)
    got = {r.segment: r for r in A.segment_metrics(preds, truth, "is_promo", ("model",)).collect()}
    assert (got["on"].wape, got["on"].bias, got["on"].n) == (0.4, -4.0, 1)
    assert (got["off"].wape, got["off"].bias, got["off"].mean_actual) == (1.4, 3.5, 2.5)

    rows = [("F", 1, 0.8, 6), ("F", 1, 0.7, 2), ("F", 0, 1.0, 2), ("G", 0, 1.0, 3), ("H", 1, 0.5, 3)]
    made = A.promo_elasticity(spark.createDataFrame(rows, "cat_id string, is_promo int, price_rel_med double, sales int")).collect()
    assert [tuple(r) for r in made] == [("F", 2.0, 4.0, 2.0, 0.75, -4.0, 2)]


def test_event_errors_and_their_mean(spark):
    truth = spark.createDataFrame([("a", 1, 2, 0), ("a", 2, 2, 7), ("a", 3, 2, 8), ("b", 1, 4, 0)], TRUE + ", days_to_event int")
    rows = [(m, f, i, d, 5.0) for m in ("m",) for f in (1, 2) for i, d in (("a", 1), ("a", 2), ("a", 3), ("b", 1)) if f == 1 or i == "a"]
    preds = spark.createDataFrame(rows, "model string, fold int, id string, d int, yhat double")
    per_fold = A.event_distance_error(preds, truth, ("model", "fold"))
    got = {(r.fold, r.days_to_event): (r.mean_err, r.n) for r in per_fold.collect()}
    assert got == {(1, 0): (2.0, 2), (1, 7): (3.0, 1), (2, 0): (3.0, 1), (2, 7): (3.0, 1)}
    assert {r.days_to_event: r.mean_err for r in A.mean_event_error(per_fold).collect()} == {0: 2.5, 7: 3.0}


@pytest.fixture(scope="module")
def daily_panel(spark):
    rows = []
    for k in range(60):
        day = dt.date(2011, 12, 1) + dt.timedelta(days=k)
        name = "Christmas" if (day.month, day.day) == (12, 25) else "Late" if k == 57 else None
        rows.append(("a", k + 1, day, k, name, 4.0 if k % 2 else 2.0))
    return spark.createDataFrame(rows, "id string, d int, date date, sales int, event_name_1 string, sell_price double").cache()


def test_centred_mean_needs_a_full_window(daily_panel):
    import pandas as pd

    made = X.smoothed_totals(X.daily_totals(daily_panel)).orderBy("date").toPandas()
    expected = pd.Series(range(60), dtype=float).rolling(28, center=True).mean()
    pd.testing.assert_series_equal(made.centred_mean, expected, check_names=False)
    assert list(made.date[made.is_christmas == 1]) == [dt.date(2011, 12, 25)]


def test_event_windows_drop_cut_ones(daily_panel):
    made = X.event_windows(daily_panel, X.daily_totals(daily_panel), ["Christmas", "Late"])
    got = {(r.event_name, r.offset): r.mean_sales for r in made.collect()}
    assert got == {("Christmas", k): 24.0 + k for k in range(-7, 8)}


def test_histogram_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    values = rng.random(500)
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "id string, zero_frac double")
    got = {r.bin: r.n_series for r in X.zero_histogram(df).collect()}
    assert got == {i: int(n) for i, n in enumerate(np.histogram(values, bins=40)[0]) if n}


def test_series_view(daily_panel):
    import pandas as pd

    view = X.series_view(daily_panel, daily_panel.select("id").distinct()).orderBy("date").toPandas()
    expected = pd.Series(range(60), dtype=float).rolling(7, center=True).mean()
    pd.testing.assert_series_equal(view.centred_mean, expected, check_names=False)


def test_promo_exemplar(spark):
    rows = []
    for name, lift in (("a", 3), ("b", 5)):
        for d in range(1, 201):
            cheap = d % 4 == 0
            rows.append((name, d, 2 * lift if cheap else 2, 3.0 if cheap else 4.0))
    panel = spark.createDataFrame(rows, "id string, d int, sales int, sell_price double")
    row = X.promo_exemplar(panel).first()
    assert (row.id, row.promo_days, row.lift, row.median_price) == ("b", 50, 5.0, 4.0)
