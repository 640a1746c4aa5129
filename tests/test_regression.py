"""MLlib models on 30 series with a weekend effect."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import forecast as FC
from demandloom.operators import metrics as M
from demandloom.operators import regression as RG
from demandloom.plans.backtest import backtest

END = 192
COLUMNS = ["dow", "base_level", "sales_lag_28"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(30):
        level = 2 + (i % 5) * 3
        sales = [int(rng.poisson(level * (1.6 if d % 7 in (0, 6) else 1.0))) for d in range(220)]
        for d in range(220):
            lag = float(sales[d - 28]) if d >= 28 else None
            rows.append((f"id{i}", d + 1, sales[d], d % 7, float(level), lag, "D1", "C1", f"S{i % 3}", "ST"))
    schema = "id string, d int, sales int, dow int, base_level double, sales_lag_28 double, dept_id string, cat_id string, store_id string, state_id string"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def future(table):
    return table.where(F.col("d") > END).select("id", "d")


def _wape(preds, table):
    return M.point_metrics(preds, table.select("id", "d", "sales")).first().wape


@pytest.fixture(scope="module")
def naive(table, future):
    return _wape(FC.forecast("naive", table.where(F.col("d") <= END), future), table)


def test_backtest_fits_anew_on_every_fold(table):
    """Each fold's rows equal a fit by hand up to its own cutoff; baselines come along in one table."""
    folds = M.expanding_folds(2, 14, 220)
    got = {(r.model, r.fold): r for r in backtest(table, folds, ["naive", "linear_reg"], table, COLUMNS).collect()}
    assert set(got) == {(m, f.fold_id) for m in ("naive", "linear_reg") for f in folds}
    for fold in folds:
        ahead = table.where(F.col("d").between(fold.test_start, fold.test_end))
        single = RG.fit_linear(table, COLUMNS, fold.train_end).predict(table, ahead)
        assert got[("linear_reg", fold.fold_id)].wape == pytest.approx(_wape(single, table))
        assert got[("linear_reg", fold.fold_id)].n == 30 * 14
    with pytest.raises(ValueError, match="feature table"):
        backtest(table, folds, ["tweedie"])


def test_trees_take_more_stores_than_the_least_bins(table):
    many = table.where("d > 180").withColumn("store_id", F.concat("id", (F.col("d") % 4).cast("string")))
    fitted = RG.fit_trees(many, COLUMNS, 220, categories=("store_id",), train_days=40, valid_days=5, rounds=2, depth=2)
    assert many.select("store_id").distinct().count() == 120
    assert fitted.predict(many, many.where("d = 220")).count() == 30


def _weekend_ratio(preds):
    means = preds.groupBy(((F.col("d") - 1) % 7).isin(0, 6).alias("weekend")).agg(F.avg("yhat").alias("m"))
    got = {r.weekend: r.m for r in means.collect()}
    return got[True] / got[False]


def test_training_rows_mark_the_stop_slice(table):
    rows = RG.training_rows(table, END, 100, 28).groupBy("is_valid").agg(F.min("d"), F.max("d")).collect()
    assert {r.is_valid: (r[1], r[2]) for r in rows} == {False: (93, 164), True: (165, 192)}


def test_linear_beats_naive_and_matches_lstsq(table, future, naive):
    fitted = RG.fit_linear(table, COLUMNS, END, 100)
    preds = fitted.predict(table, future)
    assert _wape(preds, table) < naive and preds.agg(F.min("yhat")).first()[0] >= 0
    rows = table.where(F.col("d").between(93, 192)).toPandas()
    X = np.column_stack([np.ones(len(rows)), rows[COLUMNS].fillna(0.0)])
    expected = np.linalg.lstsq(X, rows.sales.to_numpy(dtype=float), rcond=None)[0]
    model = fitted.model.stages[-1]
    np.testing.assert_allclose([model.intercept, *model.coefficients], expected, rtol=1e-6, atol=1e-8)


def test_trees_learn_the_weekend(table, future, naive):
    fitted = RG.fit_trees(table, COLUMNS, END, train_days=120, rounds=15, depth=4, step=0.3)
    preds = fitted.predict(table, future)
    assert preds.agg(F.min("yhat")).first()[0] >= 0 and _wape(preds, table) < naive
    assert _weekend_ratio(preds) > 1.2
    nodes, gains = fitted.nodes(), fitted.importance().collect()
    inner = nodes.where("feature IS NOT NULL")
    assert sum(g.splits for g in gains) == inner.count() == (nodes.count() - nodes.select("tree").distinct().count()) // 2 > 0
    assert {g.feature for g in gains if g.splits} == {r.feature for r in inner.select("feature").distinct().collect()}
    assert len(gains) == len(COLUMNS) + len(RG.CATEGORIES)
    assert [g.gain for g in gains] == sorted((g.gain for g in gains), reverse=True)


def test_tweedie_is_positive_and_useful(table, future, naive):
    weekend = table.withColumn("weekend", F.col("dow").isin(0, 6).cast("int"))
    preds = RG.fit_tweedie(weekend, [*COLUMNS, "weekend"], END, 120).predict(weekend, future)
    assert preds.agg(F.min("yhat")).first()[0] > 0 and _wape(preds, table) < naive
    assert _weekend_ratio(preds) > 1.2


def test_tweedie_trees_learn_the_weekend(table, future, naive):
    fitted = RG.fit_tweedie_trees(table, COLUMNS, END, train_days=120, rounds=15, depth=4, step=0.3)
    preds = fitted.predict(table, future)
    assert preds.agg(F.min("yhat")).first()[0] > 0 and _wape(preds, table) < naive
    assert _weekend_ratio(preds) > 1.2
    assert fitted.history[len(fitted.trees)][1] < fitted.history[0][1]


def test_lookbacks():
    assert RG.lookback_days("linear_reg") == 200
    assert RG.lookback_days("boosted_trees", 150) == 160
    assert RG.lookback_days("moving_avg_28") is None
